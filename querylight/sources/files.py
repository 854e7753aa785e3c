"""File sources and sinks with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylight.functions.strings import strip_blank
from querylight.operators.numbering import number_rows
from querylight.session import SLICE_ROWS

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
CHAT_ROW = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("conversations", T.ArrayType(MESSAGE)),
        T.StructField("sql_type", T.StringType()),
        T.StructField("db_name", T.StringType()),
    ]
)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that each hold one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON record per line; shards may be named by a glob."""
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.option("ignoreNullFields", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_json_arrays(df: DataFrame, path: str, key: str, file_bytes: int = 32 << 20) -> None:
    """JSON array files of about `file_bytes` bytes at most, in one folder; the files' names follow the order of `key`.

    Records are range-sorted by `key`, and a task fills one array at a time, so neither a hot key nor many equal ones
    gather in memory. A record larger than `file_bytes` is a file of its own; a table without rows gives no array.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            for record in batch.column(0).to_pylist():
                length = len(record.encode())
                if records and size + length > file_bytes:
                    yield json_array(records)
                    records, size = [], 0
                records.append(record)
                size += length
        if records:
            yield json_array(records)

    record = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    ranged = df.select(record.alias("record"), F.col(key).alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    # The writer begins a file with each row, and a row is a whole array.
    ranged.select("record").mapInArrow(fill, "value string").write.option("maxRecordsPerFile", 1).text(path)


def json_array(records: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"value": ["[" + ",\n".join(records) + "]"]})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines, stripped of blanks of every kind."""
    return spark.read.text(path).select(strip_blank(F.col("value")).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    """A table with one text column, one line per row."""
    df.write.text(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its whole text; no file gives one empty text."""
    try:
        return spark.read.text(path, wholetext=True)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.range(1).select(F.lit("").alias("value"))


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """`key TAB v1、v2` lines to `(alias, canonical)` rows; a key is an alias of itself."""
    parts = F.split("value", "\t")
    aliases = F.array_append(F.split(parts[1], "、"), parts[0])
    return read_lines(spark, path).select(F.explode(aliases).alias("alias"), parts[0].alias("canonical"))


def head_by(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first `n` rows by a key; a distributed file has no first rows of its own."""
    return df.orderBy(order).limit(n)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """`vocab(id, token)`: the 0-based line number of each stripped line; several files count on in the order of their paths."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        strip_blank(F.col("value")).alias("token"),
    )
    return number_rows(lines, [], ["file", "block", "at"], out="id").select("id", "token")


def read_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`merges(left, right, rank)` and `vocab(id, token)` of a tokenizer's JSON file; merges are pairs, or texts with a blank between."""
    parsed = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    merges = parsed.select(F.try_variant_get("v", "$.model.merges", "array<array<string>>").alias("pairs"), F.try_variant_get("v", "$.model.merges", "array<string>").alias("texts"))
    listed = F.coalesce("pairs", F.transform("texts", lambda t: F.split(t, " ")))
    ranked = merges.select(F.posexplode(listed).alias("rank", "pair"))
    vocab = parsed.select(F.variant_get("v", "$.model.vocab", "map<string,bigint>").alias("m")).select(F.explode("m").alias("token", "id"))
    return ranked.select(F.get("pair", F.lit(0)).alias("left"), F.get("pair", F.lit(1)).alias("right"), "rank"), vocab.select("id", "token")
