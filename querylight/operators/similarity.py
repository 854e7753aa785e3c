"""Row and frame similarity, and the similarity of query texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from querylight.operators.cells import as_rows
from querylight.operators.fuzzy import fuzzy_join, fuzzy_pairs, text_similarity  # noqa: F401
from querylight.operators.match import bags_equal, side_bit
from querylight.operators.numbering import number_rows
from querylight.operators.replay import shared_values
from querylight.session import fan_out, stage


def row_sets(cells: DataFrame) -> DataFrame:
    """Every row as its sorted set of values."""
    return as_rows(cells).withColumn("vals", F.array_sort(F.array_distinct("vals")))


def jaccard(left: Column, right: Column) -> Column:
    """Shared values over all values; two empty sets are alike."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / union)


def row_jaccard(cells: DataFrame) -> DataFrame:
    """`sim` of the gold and the predicted row at the same place."""
    sets = row_sets(cells)
    gold = sets.filter("side = 'gold'").select("pair_id", "row_idx", F.col("vals").alias("l"))
    pred = sets.filter("side = 'pred'").select("pair_id", "row_idx", F.col("vals").alias("r"))
    return gold.join(pred, ["pair_id", "row_idx"]).select(
        "pair_id", "row_idx", jaccard(F.col("l"), F.col("r")).alias("sim")
    )


def sim_listview(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """`sim`: Jaccard of the (place, value) sets; two empty results give 1."""
    each = as_rows(cells).select("pair_id", "side", "row_idx", F.explode("vals").alias("cell"))
    both = (
        each.groupBy("pair_id", "row_idx", "cell")
        .agg(F.bit_or(side_bit()).alias("sides"))
        .groupBy("pair_id")
        .agg((F.count_if(F.col("sides") == 3) / F.count("*")).alias("sim"))
    )
    return pairs.select("pair_id").join(both, "pair_id", "left").select(
        "pair_id", F.coalesce("sim", F.lit(1.0)).alias("sim")
    )


def df_sim_is_one(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """`same`: the frame similarity of a pair is exactly 1.

    With an `order by` in either text that means equal (place, value) sets. Without one it means
    equal bags of row value sets, since the greedy alignment reaches 1 just then.
    """
    text = F.lower(F.concat_ws(" ", "gold_sql", "pred_sql"))
    marked = pairs.select("pair_id", F.contains(text, F.lit("order by")).alias("in_order"))
    split = as_rows(cells).join(marked, "pair_id")
    listed = (
        split.filter("in_order")
        .select("pair_id", "side", "row_idx", F.explode("vals").alias("cell"))
        .groupBy("pair_id", "row_idx", "cell")
        .agg(F.bit_or(side_bit()).alias("sides"))
        .groupBy("pair_id")
        .agg((F.min("sides") == 3).alias("same"))
    )
    bagged = bags_equal(row_sets(split.filter(~F.col("in_order"))), ["vals"]).withColumnRenamed("same", "same_bag")
    return (
        pairs.select("pair_id")
        .join(listed, "pair_id", "left")
        .join(bagged, "pair_id", "left")
        .select("pair_id", F.coalesce("same", "same_bag", F.lit(True)).alias("same"))
    )


def align_score(cells: DataFrame, pairs: DataFrame, small: int = 256, at_once: int = 1_000_000) -> DataFrame:
    """`score`: frame similarity after greedy row alignment.

    The shorter side drives; its row i takes the most similar of the rows still open at places
    i and up (the first of equals), which swaps places with row i. The choice at i depends on all
    choices before it, so a pair is walked in order: results of at most `small` rows as one array
    per pair, those of at most `at_once` values as one group per pair, on postings; only what would not
    fit a task goes one place per round, each round a distributed search over the
    open rows of all such pairs together. All give the same score.
    """
    # Places are ranks from 0, whatever numbers the rows came with.
    placed = number_rows(row_sets(cells), ["pair_id", "side"], ["row_idx"], out="place")
    sets = stage(placed.withColumn("row_idx", F.col("place").cast("long")).drop("place"), "sets")
    counts = sets.groupBy("pair_id").agg(
        F.count_if(F.col("side") == "gold").alias("gold_n"),
        F.count_if(F.col("side") == "pred").alias("pred_n"),
        F.sum(F.size("vals")).alias("total"),
    )
    counts = stage(counts, "counts")
    driver = F.when(F.col("gold_n") > F.col("pred_n"), "pred").otherwise("gold")
    sided = sets.join(counts, "pair_id").withColumn("drives", F.col("side") == driver)
    is_small = F.greatest("gold_n", "pred_n") <= small
    fits = ~is_small & (F.col("total") + F.col("gold_n") + F.col("pred_n") <= at_once)
    by_array = _align_small(sided.filter(is_small)).withColumnRenamed("shared", "by_array")
    by_postings = _align_on_postings(sided.filter(fits)).withColumnRenamed("shared", "by_postings")
    by_rounds = _align_large(sided.filter(~is_small & ~fits), counts.filter(~is_small & ~fits)).withColumnRenamed("shared", "by_rounds")
    shared = F.coalesce("by_array", "by_postings", "by_rounds", F.lit(0))
    scored = (
        counts.join(by_array, "pair_id", "left")
        .join(by_postings, "pair_id", "left")
        .join(by_rounds, "pair_id", "left")
        .select("pair_id", (shared / (F.col("total") - shared)).alias("score"))
    )
    return pairs.select("pair_id").join(scored, "pair_id", "left").select(
        "pair_id", F.coalesce("score", F.lit(1.0)).alias("score")
    )


def _align_on_postings(sided: DataFrame) -> DataFrame:
    """Shared values after alignment; both sides of a pair fit one task."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_idx", kind="stable")
        sizes = part["vals"].map(len).to_numpy()
        codes, known = pd.factorize(np.concatenate(part["vals"].to_list()), sort=True)
        rows = [np.sort(own) for own in np.split(codes, np.cumsum(sizes)[:-1])]
        short, long = ([r for r, drives in zip(rows, part["drives"]) if drives == side] for side in (True, False))
        return pd.DataFrame({"pair_id": part["pair_id"].iloc[:1], "shared": [shared_values(short, long, len(known))]})

    kind = sided.schema["pair_id"].dataType.simpleString()
    rows = sided.select("pair_id", "drives", "row_idx", "vals")
    return rows.groupBy("pair_id").applyInPandas(solve, f"pair_id {kind}, shared long")


def _align_small(sided: DataFrame) -> DataFrame:
    """Shared values after alignment; both sides of a pair have a bounded number of rows."""

    def side(drives: bool) -> Column:
        rows = F.collect_list(F.when(F.col("drives") == drives, F.struct("row_idx", "vals")))
        return F.transform(F.array_sort(rows), lambda r: r["vals"])

    both = fan_out(sided.groupBy("pair_id").agg(side(True).alias("short"), side(False).alias("long")))

    return both.select("pair_id", align_shared("short", "long").alias("shared"))


@F.pandas_udf(LongType())
def align_shared(short: pd.Series, long: pd.Series) -> pd.Series:
    """Values shared by the two row lists after greedy alignment; the lists hold value sets."""
    return pd.Series([_shared_after_swaps(s, o) for s, o in zip(short, long)], dtype="int64")


def _shared_after_swaps(short: list, long: list) -> int:
    open_rows = [frozenset(r) for r in long]
    shared = 0
    for i, row in enumerate(frozenset(r) for r in short):
        # max keeps the first of equals
        best = max(range(i, len(open_rows)), key=lambda j: _set_jaccard(row, open_rows[j]))
        open_rows[i], open_rows[best] = open_rows[best], open_rows[i]
        shared += len(row & open_rows[i])
    return shared


def _set_jaccard(left: frozenset, right: frozenset) -> float:
    both = len(left & right)
    every = len(left) + len(right) - both
    return both / every if every else 1.0


def _align_large(sided: DataFrame, counts: DataFrame) -> DataFrame:
    """Shared values after alignment, one place per round for all pairs."""
    spark = sided.sparkSession
    empty = spark.createDataFrame([], "pair_id long, shared long").select(
        F.col("pair_id").cast(dict(sided.dtypes)["pair_id"]), "shared"
    )
    rounds = counts.agg(F.max(F.least("gold_n", "pred_n"))).first()[0]
    if not rounds:
        return empty
    short = stage(sided.filter("drives").select("pair_id", F.col("row_idx").alias("i"), F.col("vals").alias("row")))
    open_rows = stage(sided.filter(~F.col("drives")).select("pair_id", F.col("row_idx").alias("j"), "vals"))
    gains = empty
    for i in range(rounds):
        here = short.filter(F.col("i") == i).select("pair_id", "row")
        best = (
            open_rows.filter(F.col("j") >= i)
            .join(here, "pair_id")
            .groupBy("pair_id")
            .agg(
                F.max(
                    F.struct(
                        jaccard(F.col("row"), F.col("vals")).alias("sim"),
                        (-F.col("j")).alias("near"),
                        F.size(F.array_intersect("row", "vals")).alias("gain"),
                    )
                ).alias("b")
            )
            .select("pair_id", (-F.col("b.near")).alias("taken"), F.col("b.gain").cast("long").alias("shared"))
        )
        best = stage(best, "best")
        gains = gains.unionByName(best.select("pair_id", "shared"))
        moved = F.when(F.col("j") == F.col("taken"), F.lit(i)).when(F.col("j") == i, F.col("taken")).otherwise(F.col("j"))
        open_rows = open_rows.join(best.select("pair_id", "taken"), "pair_id").select(
            "pair_id", moved.cast(dict(open_rows.dtypes)["j"]).alias("j"), "vals"
        )
        open_rows = stage(open_rows.filter(F.col("j") > i), "open")
    return gains.groupBy("pair_id").agg(F.sum("shared").alias("shared"))
