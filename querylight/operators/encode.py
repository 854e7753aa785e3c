"""Label masks, truncation, padding, batches, packing offsets, per-dialect caps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from querylight.operators.numbering import number_rows
from querylight.session import stage

# Fixed values.
IGNORE = -100
DIALECT_IDS = {"postgresql": 0, "mysql": 1, "cypher": 2, "ngql": 3}
LABEL_SEP = "[sep]"


def truncate(ids: Column, max_len: int) -> Column:
    return F.slice(ids, 1, max_len)


def label_mask(ids: Column, n_prompt: Column) -> Column:
    """Labels: prompt positions ignored, the rest keep their id. Two runs, as a function per id would be interpreted for each."""
    ignored = F.greatest(F.least(F.coalesce(n_prompt, F.lit(0)), F.size(ids)), F.lit(0)).cast("int")
    return F.concat(F.array_repeat(F.lit(IGNORE).cast("long"), ignored), F.slice(ids, ignored + 1, F.size(ids)))


def mask_rows(encoded: DataFrame, max_len: int) -> DataFrame:
    """Truncate `ids` and add `labels`; `too_long` marks rows whose prompt alone fills the limit."""
    return (
        encoded.withColumn("full_len", F.size("ids"))
        .withColumn("ids", truncate(F.col("ids"), max_len))
        .withColumn("labels", label_mask(F.col("ids"), F.col("n_prompt")))
        .withColumn("too_long", F.col("n_prompt") > F.size("ids"))
    )


def dialect_id(sql_type: Column) -> Column:
    lower = F.lower(sql_type)
    out = None
    for name, number in DIALECT_IDS.items():
        value = F.lit(number).cast("long")
        out = F.when(lower == name, value) if out is None else out.when(lower == name, value)
    return out


def dialect_slot(labels: Column, sql_type: Column) -> Column:
    """Dialect id in place of label 0; labels of other dialects stay as they are."""
    number = dialect_id(sql_type)
    changed = F.concat(F.array(number), F.slice(labels, F.lit(2), F.size(labels)))
    return F.when(number.isNull() | (F.size(labels) == 0), labels).otherwise(changed)


def sep_label(db_name: Column, sql_type: Column, target: Column) -> Column:
    return F.concat_ws(LABEL_SEP, db_name, sql_type, target)


def split_label(label: Column) -> list[Column]:
    """Database, dialect and target of a packed label: its parts 0, 1 and last."""
    parts = F.split(label, r"\[sep\]")
    return [parts[0].alias("db_name"), parts[1].alias("sql_type"), F.element_at(parts, -1).alias("target")]


def batches(rows: DataFrame, order: list[str], size: int, widest: str | None = None) -> DataFrame:
    """Consecutive batches of `size` rows in `order`, the last one short; with `widest`, the batch's largest size of that
    array as `width`.

    `order` is unique and not null. Only the keys are numbered and measured; the rows then meet their key once. Rows without
    arrays are numbered as they are.
    """
    place = [F.floor(F.col("_at") / size).alias("batch_id"), (F.col("_at") % size).alias("slot")]
    if widest is None and not any(isinstance(f.dataType, ArrayType) for f in rows.schema):
        return number_rows(rows, [], order, out="_at").select(*rows.columns, *place)
    measure = [F.size(widest).alias("_size")] if widest else []
    keys = number_rows(rows.select(*order, *measure), [], order, out="_at").select(*order, *place, *(["_size"] if widest else []))
    if widest:
        keys = stage(keys, "batch-keys")
        keys = keys.join(keys.groupBy("batch_id").agg(F.max("_size").alias("width")), "batch_id").drop("_size")
    return rows.join(keys, order)


def _fill(values: Column, width: Column, filler: int, left: bool) -> Column:
    pad = F.array_repeat(F.lit(filler).cast("long"), width - F.size(values))
    return F.concat(pad, values) if left else F.concat(values, pad)


def pad_batches(rows: DataFrame, pad_id: int = 0, left: bool = True) -> DataFrame:
    """Pad `ids`, `labels` and a new `mask` to the longest `ids` of each batch: `width` when the rows have it."""
    ones = F.array_repeat(F.lit(1).cast("long"), F.size("ids"))
    if "width" not in rows.columns:
        rows = rows.withColumn("width", F.max(F.size("ids")).over(Window.partitionBy("batch_id")))
    return (
        rows.withColumn("mask", _fill(ones, F.col("width"), 0, left))
        .withColumn("ids", _fill(F.col("ids"), F.col("width"), pad_id, left))
        .withColumn("labels", _fill(F.col("labels"), F.col("width"), IGNORE, left))
    )


def positions(mask: Column, length: Column) -> Column:
    """Position ids: the running sum of the mask minus one, 1 where the mask is 0. Padding is on one side, so the
    `length` ones stand in a row and count up from 0."""
    lead = F.greatest(F.array_position(mask, F.lit(1).cast("long")) - 1, F.lit(0)).cast("int")
    filler = F.lit(1).cast("long")
    count = F.when(length > 0, F.sequence(F.lit(0).cast("long"), length - 1)).otherwise(F.array().cast("array<bigint>"))
    tail = F.size(mask) - lead - length.cast("int")
    return F.concat(F.array_repeat(filler, lead), count, F.array_repeat(filler, tail))


def pack_offsets(padded: DataFrame) -> DataFrame:
    """Valid length, start offset within the batch, batch maximum and position ids of each row."""
    batch = Window.partitionBy("batch_id")
    before = batch.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    length = F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m)
    return (
        padded.withColumn("length", length)
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .withColumn("max_length", F.max("length").over(batch))
        .withColumn("position_ids", positions(F.col("mask"), F.col("length")))
    )


def without_prompt(pred: Column, prompt: Column) -> Column:
    """Generated text behind the prompt, cut by the prompt's length."""
    return F.substr(pred, F.length(prompt) + 1)


def replace_ignored(ids: Column, pad_id: int = 0) -> Column:
    return F.transform(ids, lambda x: F.when(x == IGNORE, F.lit(pad_id).cast("long")).otherwise(x))


def attach_predictions(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold query (turn 1 of the conversation) next to the trimmed prediction of the same id."""
    trimmed = predictions.select("id", without_prompt(F.col("pred"), F.col("prompt")).alias("pred_sql"))
    gold = F.get("conversations", F.lit(1))["content"]
    return rows.select("id", "sql_type", "db_name", gold.alias("sql")).join(trimmed, "id")


def sample_by_dialect(rows: DataFrame, caps: Mapping[str, int] | None, order: str = "id") -> DataFrame:
    """The first `cap` rows of each dialect in the map, with the dialect's place in the map; no map keeps all.

    Only the keys are numbered, in range chunks, to find the last key each dialect keeps; whole rows
    are then filtered where they lie. `order` is unique within a dialect.
    """
    if not caps:
        return rows.withColumn("part", F.lit(0))
    if not any(caps.values()):
        return rows.filter(F.lit(False)).withColumn("part", F.lit(0))
    part, cap = None, None
    for i, (name, n) in enumerate(caps.items()):
        hit = F.col("sql_type") == name
        part = F.when(hit, i) if part is None else part.when(hit, i)
        cap = F.when(hit, n) if cap is None else cap.when(hit, n)
    wanted = rows.filter(F.col("sql_type").isin(*caps))
    numbered = number_rows(wanted.select("sql_type", order), ["sql_type"], [order], out="_at", below=max(caps.values()))
    last = numbered.filter(F.col("_at") < cap).groupBy("sql_type").agg(F.max(order).alias("_last"))
    # One row per dialect in the map, whatever the data.
    kept = wanted.join(F.broadcast(last), "sql_type").filter(F.col(order) <= F.col("_last"))
    return kept.withColumn("part", part).drop("_last")
