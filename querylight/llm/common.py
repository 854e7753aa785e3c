"""Words, keys and joins shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# A table with fewer bytes than this may go to every executor; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lower_az(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. Texts of ASCII alone take the quick way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of digits, lower-cased letters and all characters beyond ASCII; null has none."""
    return F.array_remove(F.split(lower_az(text_or_empty(text)), NOT_WORD), "")


def text_key(text: Column) -> Column:
    """128 bits of a text as 32 hex digits; null counts as empty."""
    return F.md5(text_or_empty(text))


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): rows that agree in id and text are one and the same document."""
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.lit(7), text_or_empty(F.col(text_col))).alias("h"), F.col(text_col).alias("text")
    )


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition over the keys of `with_row_key`, null ids included."""
    return left["id"].eqNullSafe(right["id"]) & (left["h"] == right["h"])


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint when its counted rows fit the limit, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of an ASCII text."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split({text}, ''),
      lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end))"""
