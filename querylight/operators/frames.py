"""Frame comparison: normal form and subset match with extra predicted columns allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylight.operators.cells import as_rows, column_prints
from querylight.operators.match import for_all_pairs, mapped_by_rank, permuted
from querylight.operators.numbering import number_rows
from querylight.session import stage


def by_column_name(vals: Column) -> Column:
    """Cells in the order of the frame's column names col_1, col_2, … read as text."""
    named = F.transform(vals, lambda v, i: F.struct(F.concat(F.lit("col_"), (i + 1).cast("string")), v.alias("v")))
    return F.transform(F.array_sort(named), lambda c: c["v"])


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows of each side with the place of their first occurrence."""
    return rows.groupBy("pair_id", "side", "vals").agg(F.min("row_idx").alias("first_idx"))


def normalize(cells: DataFrame, ordered_pairs: Column) -> DataFrame:
    """Normal form of every result: distinct rows, columns by name, rows by value.

    Where `ordered_pairs` holds (a condition on pair_id), rows keep their order of first occurrence.
    """
    rows = as_rows(cells).withColumn("vals", by_column_name(F.col("vals")))
    keyed = distinct_rows(rows).withColumn("place", F.when(ordered_pairs, F.col("first_idx")).otherwise(0))
    return number_rows(keyed, ["pair_id", "side"], ["place", "vals"], out="new_idx").select(
        "pair_id", "side", "new_idx", "vals"
    )


def rounded_cell(cell: Column, digits: int = 6) -> Column:
    """A number rounded to significant digits, so that values within float tolerance share one join key."""
    number = F.substr(cell, F.lit(5)).try_cast("double")
    shift = digits - 1 - F.floor(F.log10(F.abs(number)))
    up, down = F.pow(F.lit(10.0), shift), F.pow(F.lit(10.0), -shift)
    near = F.when(shift >= 0, F.rint(number * up) / up).otherwise(F.rint(number / down) * down)
    key = F.concat(F.lit("num:"), (F.coalesce(near, number) + 0.0).cast("string"))
    return F.when(cell.startswith("num:"), key).otherwise(cell)


def rounded(vals: Column, digits: int = 6) -> Column:
    return F.transform(vals, lambda cell: rounded_cell(cell, digits))


def subset_match(cells: DataFrame, pairs: DataFrame, ordered: bool = False) -> DataFrame:
    """`subset`: every gold column has a predicted column of equal values, and the matched frames agree.

    A gold column takes the first unused predicted column with the same values. Equality splits the
    columns into classes, so that is the k-th gold column of a class with the k-th predicted one. Ordered
    frames whose distinct rows first occur at the same places agree; only the others are ranked.
    """
    rows = as_rows(cells)
    # Exploded cells are rounded in compiled code, a lambda's are not.
    mapped = mapped_by_rank(column_prints(rows, key=rounded_cell)).join(pairs.select("pair_id"), "pair_id", "left_semi")
    firsts = [F.min(F.when(F.col("side") == side, F.col("row_idx"))).alias(side) for side in ("gold", "pred")]
    places = permuted(rows.withColumn("vals", rounded(F.col("vals"))), stage(mapped, "perms")).groupBy("pair_id", "vals").agg(*firsts).select("pair_id", "gold", "pred")
    places = stage(places, "places") if ordered else places
    on_both = F.bool_and(F.col("gold").isNotNull() & F.col("pred").isNotNull())
    verdict = places.groupBy("pair_id").agg(on_both.alias("subset"), F.bool_and(F.equal_null("gold", "pred")).alias("in_place"))
    if ordered:
        verdict = stage(verdict, "verdict")
        ranked = places.join(verdict.filter("subset and not in_place"), "pair_id", "left_semi")
        for side in ("gold", "pred"):
            ranked = number_rows(ranked, ["pair_id"], [side], out=f"{side}_at")
        listed = ranked.groupBy("pair_id").agg(F.bool_and(F.col("gold_at") == F.col("pred_at")).alias("listed"))
        verdict = verdict.join(listed, "pair_id", "left").withColumn("subset", F.coalesce("listed", "subset"))
    return for_all_pairs(verdict, pairs, "subset", False)
