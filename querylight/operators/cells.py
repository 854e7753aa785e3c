"""The long cell table of result tables, and its building blocks.

`cells(pair_id, side, row_idx, col_idx, cell)` holds every gold and predicted result table at once;
`cell` is the canonical text `tag:value`. Two cells are equal when their texts are equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE = ("tinyint", "smallint", "int", "bigint")
FLOATING = ("float", "double")


def _plain(decimal: Column) -> Column:
    """Plain digits of a decimal text: no zeros at the end but one behind the point."""
    pointed = F.when(F.contains(decimal, F.lit(".")), decimal).otherwise(F.concat(decimal, F.lit(".0")))
    short = F.regexp_replace(F.regexp_replace(pointed, "0+$", ""), r"\.$", ".0")
    return F.when(short == "-0.0", "0.0").otherwise(short)


def number_text(kind: Column, raw: Column) -> Column:
    """Exact plain text of a number or boolean, the same for equal values of any numeric type; null for other values."""
    value = raw.try_cast("double")
    size = F.abs(value)
    whole = (value == F.floor(value)) & (size < 1e37)
    small = _plain(value.try_cast("decimal(38,30)").cast("string"))
    floating = (
        F.when(whole, F.concat(value.try_cast("decimal(38,0)").cast("string"), F.lit(".0")))
        .when((size < 1e-3) & (small != "0.0"), small)
        .when((size >= 1e7) & (size < 1e20), _plain(value.try_cast("decimal(38,15)").cast("string")))
        .otherwise(value.cast("string"))
    )
    scaled = F.when(F.contains(raw, F.lit("E")), raw.try_cast("decimal(38,30)").cast("string")).otherwise(raw)
    return (
        F.when(kind == "boolean", F.when(F.lower(raw) == "true", "1.0").when(F.lower(raw) == "false", "0.0"))
        .when(kind.isin(*WHOLE), F.concat(raw, F.lit(".0")))
        .when(kind == "decimal", _plain(scaled))
        .when(kind.isin(*FLOATING), floating)
    )


def canonical_cell(kind: Column, raw: Column) -> Column:
    """Canonical text of one value: numbers and booleans by their exact value, strings stay strings."""
    number = number_text(F.regexp_extract(F.lower(kind), "^[a-z]+", 0), raw)
    return (
        F.when(raw.isNull(), F.lit("null:"))
        .when(number.isNotNull(), F.concat(F.lit("num:"), number))
        .when(F.lower(kind).isin("string", "text", "varchar"), F.concat(F.lit("str:"), raw))
        .otherwise(F.concat(F.lit("other:"), raw))
    )


def canonical_cells(raw_cells: DataFrame) -> DataFrame:
    """`(pair_id, side, row_idx, col_idx, kind, raw)` to the canonical cell table."""
    return raw_cells.select(
        "pair_id", "side", "row_idx", "col_idx", canonical_cell(F.col("kind"), F.col("raw")).alias("cell")
    )


def melt(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide rows to raw cells with one explode, so the source is read once."""
    kinds = dict(rows.dtypes)
    cell = [
        F.struct(F.lit(i).alias("col_idx"), F.lit(kinds[c]).alias("kind"), F.col(f"`{c}`").cast("string").alias("raw"))
        for i, c in enumerate(columns)
    ]
    return rows.select(*keys, F.explode(F.array(*cell)).alias("c")).select(*keys, "c.*")


def row_form(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide rows straight to the row form `(keys, vals)`: nothing is exploded or shuffled."""
    kinds = dict(rows.dtypes)
    vals = F.array(*[canonical_cell(F.lit(kinds[c]), F.col(f"`{c}`").cast("string")) for c in columns])
    return rows.select(*keys, vals.alias("vals"))


def result_rows(cells: DataFrame) -> DataFrame:
    """One row per result row with its cells in column order; an array is as wide as the result."""
    pairs = F.array_sort(F.collect_list(F.struct("col_idx", "cell")))
    return cells.groupBy("pair_id", "side", "row_idx").agg(F.transform(pairs, lambda c: c["cell"]).alias("vals"))


def bag_print(*columns: Column | str) -> list[Column]:
    """Order-free fingerprint of a bag of values: sums of hash slices.

    Sums combine before the shuffle, so a column of any length is never collected. The slices are
    24 bits wide, which leaves room for 2**39 values per bag.
    """
    slices = []
    for seed in ("a", "b"):
        h = F.xxhash64(F.lit(seed), *columns)
        slices += [F.shiftrightunsigned(h, 40), F.shiftrightunsigned(h, 16).bitwiseAND(0xFFFFFF)]
    return [F.sum(s).alias(f"_h{i}") for i, s in enumerate(slices)]


BAG = ["_h0", "_h1", "_h2", "_h3"]


def as_rows(table: DataFrame) -> DataFrame:
    """The row form of a cell table; a table already in row form passes through.

    Operators take either form, so a caller that compares in several ways assembles rows once.
    """
    return table if "vals" in table.columns else result_rows(table)


def column_prints(rows: DataFrame, ordered: bool = False, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """Fingerprint `fp` of the value bag (or, ordered, of the value list) of every column; with `key`, of what it makes of the cells."""
    values = ["row_idx", "cell"] if ordered else ["cell"]
    cells = rows.select("pair_id", "side", "row_idx", F.posexplode("vals").alias("col_idx", "cell"))
    cells = cells.withColumn("cell", key(F.col("cell"))) if key else cells
    return (
        cells.groupBy("pair_id", "side", "col_idx")
        .agg(*bag_print(*values), F.count("*").alias("_n"))
        .select("pair_id", "side", "col_idx", F.struct("_n", *BAG).alias("fp"))
    )


def both_prints(rows: DataFrame) -> DataFrame:
    """Bag and list fingerprints `fp` and `list_fp` of every column in one pass."""
    cells = rows.select("pair_id", "side", "row_idx", F.posexplode("vals").alias("col_idx", "cell"))
    lists = [c.alias(f"_l{i}") for i, c in enumerate(bag_print("row_idx", "cell"))]
    sums = cells.groupBy("pair_id", "side", "col_idx").agg(*bag_print("cell"), *lists, F.count("*").alias("_n"))
    return sums.select(
        "pair_id",
        "side",
        "col_idx",
        F.struct("_n", *BAG).alias("fp"),
        F.struct("_n", *[f"_l{i}" for i in range(len(BAG))]).alias("list_fp"),
    )


def shapes(rows: DataFrame) -> DataFrame:
    """Row and column counts of both sides per pair."""
    gold, pred = F.col("side") == "gold", F.col("side") == "pred"
    width = F.size("vals")
    return rows.groupBy("pair_id").agg(
        F.count_if(gold).alias("gold_rows"),
        F.count_if(pred).alias("pred_rows"),
        F.coalesce(F.max(F.when(gold, width)), F.lit(0)).alias("gold_cols"),
        F.coalesce(F.max(F.when(pred, width)), F.lit(0)).alias("pred_cols"),
    )
