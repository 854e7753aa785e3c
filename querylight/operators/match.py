"""Result-table equality for all pairs at once: order-free rejects, bags, column permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylight.operators.cells import BAG, as_rows, bag_print, both_prints, column_prints, shapes
from querylight.session import stage


def side_bit() -> Column:
    return F.when(F.col("side") == "gold", 1).otherwise(2)


def side_sign() -> Column:
    return F.when(F.col("side") == "gold", 1).otherwise(-1)


def for_all_pairs(verdicts: DataFrame, pairs: DataFrame, column: str, when_absent: bool) -> DataFrame:
    """Give the pairs that have no cells on either side the verdict of two empty results."""
    return (
        pairs.select("pair_id")
        .join(verdicts.select("pair_id", column), "pair_id", "left")
        .select("pair_id", F.coalesce(column, F.lit(when_absent)).alias(column))
    )


def unordered_rows(cells: DataFrame) -> DataFrame:
    """Every row with its cells sorted by value, so column order no longer matters."""
    return as_rows(cells).withColumn("vals", F.array_sort("vals"))


def quick_reject(cells: DataFrame, pairs: DataFrame, ordered: bool = False) -> DataFrame:
    """`may_match`: the sets (ordered: the lists) of order-free rows are the same."""
    keys = ["pair_id", "vals", "row_idx"] if ordered else ["pair_id", "vals"]
    verdict = (
        unordered_rows(cells)
        .groupBy(*keys)
        .agg(F.bit_or(side_bit()).alias("sides"))
        .groupBy("pair_id")
        .agg((F.min("sides") == 3).alias("may_match"))
    )
    return for_all_pairs(verdict, pairs, "may_match", True)


def bags_equal(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`same` per pair: every distinct row occurs equally often on both sides."""
    return (
        rows.groupBy("pair_id", *keys)
        .agg(F.sum(side_sign()).alias("balance"))
        .groupBy("pair_id")
        .agg(F.bool_and(F.col("balance") == 0).alias("same"))
    )


def multiset_eq(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """`same_bag`: both results hold the same rows with the same counts, columns in place."""
    verdict = bags_equal(as_rows(cells), ["vals"]).withColumnRenamed("same", "same_bag")
    return for_all_pairs(verdict, pairs, "same_bag", True)


def column_candidates(cells: DataFrame) -> DataFrame:
    """Gold and predicted columns that hold the same value bag: the only possible partners."""
    prints = column_prints(as_rows(cells))
    gold = prints.filter("side = 'gold'").select("pair_id", "fp", F.col("col_idx").alias("gold_col"))
    pred = prints.filter("side = 'pred'").select("pair_id", "fp", F.col("col_idx").alias("pred_col"))
    return gold.join(pred, ["pair_id", "fp"]).select("pair_id", "gold_col", "pred_col")


def mapped_by_rank(prints: DataFrame) -> DataFrame:
    """`perm`: the predicted column for each gold column, in gold order, of the pairs where every gold column has one.

    The k-th gold column of a class of equal columns goes with its k-th predicted column. The prints of a pair, one per
    column, meet in one task and are read once.
    """
    rank = F.row_number().over(Window.partitionBy("pair_id", "side", "fp").orderBy("col_idx"))
    of_side = [F.max(F.when(F.col("side") == s, F.col("col_idx"))).alias(f"{s}_col") for s in ("gold", "pred")]
    classes = prints.repartition("pair_id").withColumn("k", rank).groupBy("pair_id", "fp", "k").agg(*of_side)
    ordered = F.array_sort(F.collect_list(F.when(F.col("pred_col").isNotNull(), F.struct("gold_col", "pred_col"))))
    mapped = classes.filter("gold_col is not null").groupBy("pair_id").agg(F.count("*").alias("width"), ordered.alias("perm"))
    return mapped.filter(F.size("perm") == F.col("width")).select("pair_id", F.transform("perm", lambda c: c["pred_col"]).alias("perm"))


def permuted(rows: DataFrame, perms: DataFrame) -> DataFrame:
    """Rows of the pairs in `perms`, predicted rows rearranged into gold column order."""
    joined = rows.join(perms.select("pair_id", "perm"), "pair_id")
    moved = F.transform("perm", lambda p: F.get("vals", p))
    return joined.withColumn("vals", F.when(F.col("side") == "pred", moved).otherwise(F.col("vals"))).drop("perm")


def result_eq(cells: DataFrame, pairs: DataFrame, ordered: bool = False, beam: int = 16) -> DataFrame:
    """`match`: some order of the predicted columns makes the two results equal.

    Unordered results compare as bags of rows, ordered ones as lists. Cheap counts and column
    fingerprints decide most pairs; a search over column orders runs only for the pairs where
    different columns of one result hold equal bags, and an exact comparison of whole rows has the
    last word for every surviving column order.
    """
    rows = as_rows(cells)
    shape = stage(shapes(rows), "shape")
    gated = shape.filter("gold_rows = pred_rows and gold_cols = pred_cols and gold_rows > 0")
    gated = gated.join(pairs.select("pair_id"), "pair_id", "left_semi").select("pair_id", F.col("gold_cols").alias("width"))

    # The prints are small where the rows are not, so it is them that meet the pairs.
    prints = stage(both_prints(rows), "prints")
    mapped = mapped_by_rank(prints.withColumn("fp", F.col("list_fp")) if ordered else prints)
    perms = mapped.join(gated.select("pair_id"), "pair_id", "left_semi")

    if not ordered:
        loose = (
            prints.filter("side = 'pred'")
            .groupBy("pair_id", "fp")
            .agg(F.min("list_fp").alias("lo"), F.max("list_fp").alias("hi"))
            .filter("lo <> hi")
            .join(perms, "pair_id", "left_semi")
            .select("pair_id")
            .distinct()
        )
        if not loose.isEmpty():
            loose = stage(loose, "loose")
            found = search_permutations(
                stage(rows.join(loose, "pair_id", "left_semi"), "rows"),
                prints.join(loose, "pair_id", "left_semi"),
                gated.join(loose, "pair_id", "left_semi"),
                beam,
            )
            perms = perms.join(loose, "pair_id", "left_anti").unionByName(found)

    same = bags_equal(permuted(rows, stage(perms, "perms")), ["vals", "row_idx"] if ordered else ["vals"])
    both_empty = F.col("gold_rows") + F.col("pred_rows") == 0
    known = shape.join(same, "pair_id", "left").select("pair_id", F.coalesce("same", both_empty).alias("match"))
    return for_all_pairs(known, pairs, "match", True)


def search_permutations(rows: DataFrame, prints: DataFrame, widths: DataFrame, beam: int) -> DataFrame:
    """`(pair_id, perm)` for the pairs that have a column order with equal row bags.

    A partial order lives only while the rows cut to its columns form equal bags, which one
    aggregation per round checks for all pairs. At most `beam` partial orders of a pair, the
    longest first, are extended per round; the others wait in the frontier and are taken up when
    those die out, so no order is ever dropped unseen. Among predicted columns that are equal row
    by row only the first unused one is tried, as they are interchangeable.
    """
    twins = Window.partitionBy("pair_id", "list_fp").orderBy("col_idx")
    pred = (
        prints.filter("side = 'pred'")
        .withColumn("twin", F.coalesce(F.lag("col_idx").over(twins), F.lit(-1)))
        .select("pair_id", "fp", F.col("col_idx").alias("pred_col"), "twin")
    )
    gold = prints.filter("side = 'gold'").select("pair_id", "fp", F.col("col_idx").alias("depth"))
    edges = stage(gold.join(pred, ["pair_id", "fp"]).select("pair_id", "depth", "pred_col", "twin"), "edges")

    frontier = widths.select("pair_id", "width", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path"))
    found: DataFrame | None = None
    pick = Window.partitionBy("pair_id").orderBy(F.desc("depth"), "path")
    while True:
        frontier = stage(frontier.withColumn("turn", F.row_number().over(pick)), "frontier")
        if frontier.isEmpty():
            break
        waiting = frontier.filter(F.col("turn") > beam).drop("turn")
        longer = (
            frontier.filter(F.col("turn") <= beam)
            .join(edges, ["pair_id", "depth"])
            .filter(~F.expr("array_contains(path, pred_col)"))
            .filter("twin = -1 or array_contains(path, twin)")
            .select(
                "pair_id", "width", (F.col("depth") + 1).alias("depth"),
                F.array_append("path", F.col("pred_col")).alias("path"),
            )
        )
        longer = stage(longer, "longer")
        cut = F.transform("path", lambda p: F.get("vals", p))
        pred_bags = (
            rows.filter("side = 'pred'")
            .join(longer, "pair_id")
            .groupBy("pair_id", "width", "depth", "path")
            .agg(*bag_print(cut))
        )
        gold_bags = (
            rows.filter("side = 'gold'")
            .join(longer.select("pair_id", "depth").distinct(), "pair_id")
            .groupBy("pair_id", "depth")
            .agg(*bag_print(F.slice("vals", F.lit(1), F.col("depth"))))
        )
        alive = stage(
            pred_bags.join(gold_bags, ["pair_id", "depth", *BAG]).select("pair_id", "width", "depth", "path"), "alive"
        )
        done = stage(alive.filter("depth = width").groupBy("pair_id").agg(F.min("path").alias("perm")), "done")
        found = done if found is None else found.unionByName(done)
        frontier = waiting.unionByName(alive.filter("depth < width")).join(done, "pair_id", "left_anti")
    return found
