"""Row numbers per group that never put one whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylight.session import stage


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    out: str = "row_idx",
    total: str | None = None,
    below: int | None = None,
) -> DataFrame:
    """Add the 0-based rank of each row inside its group, and optionally the group size.

    The rows are cut into range chunks over (group, order), so a group of any size spreads over
    many chunks; a chunk is numbered alone and shifted by the rows in the chunks before it. The
    chunk column is written down before use, so both readers see the same cut. `order` must be
    unique inside a group and `group` not null. With `below`, only ranks under it are kept, and
    chunks that start beyond it are dropped before the per-chunk sort. Without it, the rows before a chunk
    are only counted for groups that lie in several chunks: at most one per border of two chunks.
    """
    chunked = stage(
        df.repartitionByRange(*group, *order).withColumn("_chunk", F.spark_partition_id()),
        "numbering",
    )
    per_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = per_group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counted = chunked
    if group and below is None:
        ends = chunked.groupBy(*group).agg(F.min("_chunk").alias("_lo"), F.max("_chunk").alias("_hi"))
        counted = chunked.join(F.broadcast(ends.filter("_lo < _hi").select(*group)), list(group), "left_semi")
    offsets = (
        counted.groupBy(*group, "_chunk")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    kept = ["_before"]
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(per_group))
        kept.append(total)
    if below is not None:
        offsets = offsets.filter(F.col("_before") < below)
    keys = [*group, "_chunk"]
    in_chunk = Window.partitionBy(*keys).orderBy(*order)
    if group and below is None:
        whole = chunked.join(F.broadcast(offsets.select(*keys, *kept)), keys, "left")
        whole = whole.withColumn("_before", F.coalesce("_before", F.lit(0)))
        if total:
            whole = whole.withColumn(total, F.coalesce(total, F.count("*").over(Window.partitionBy(*keys))))
    else:
        whole = chunked.join(offsets.select(*keys, *kept), keys)
    numbered = (
        whole
        .withColumn(out, F.row_number().over(in_chunk) - 1 + F.col("_before"))
        .drop("_chunk", "_before")
    )
    return numbered if below is None else numbered.filter(F.col(out) < below)
