"""Expert routing as a data operator: gate scores, top-k choice, dispatch, group routing.

Token rows are `(seq, pos, …, expert_logits, dialect_logits)`. There are E experts and D dialect
groups of g = E / D experts each; expert e belongs to group e div g. Everything per token is an
array expression without a shuffle; only what is pooled or counted is aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylight.functions.vectors import argmax, dot, let, softmax, top_k, total


def gate_matrix(gates: DataFrame) -> Column:
    """Gate rows `(e, g)` as one array of vectors, evaluated once per query as a scalar subquery.

    The gates are parameters of a model; their number does not follow the data.
    """
    rows = F.array_sort(F.collect_list(F.struct("e", "g")))
    return gates.agg(F.transform(rows, lambda r: r["g"])).scalar()


def gate_logits(tokens: DataFrame, gates: DataFrame, vector: str, out: str) -> DataFrame:
    """Add the dot products of each token vector with every gate."""
    x = F.col(vector).cast("array<double>")
    scored = tokens.withColumn("_gates", gate_matrix(gates))
    return scored.withColumn(out, F.transform("_gates", lambda g: dot(x, g))).drop("_gates")


def dialect_weighted(experts: Column, dialects: Column, per_group: int) -> Column:
    """Expert weights times the weight of their dialect group."""
    both = F.struct(experts.alias("e"), dialects.alias("d"))
    return let(
        both, lambda s: F.transform(s["e"], lambda w, e: w * F.get(s["d"], F.floor(e / per_group).cast("int")))
    )


def soft_weights(per_group: int) -> Column:
    """Softmax over experts times softmax over dialects."""
    return dialect_weighted(softmax("expert_logits"), softmax("dialect_logits"), per_group)


def renormalised(chosen: Column) -> Column:
    """Top-k weights that sum to 1."""
    summed = F.struct(chosen.alias("c"), (total(F.transform(chosen, lambda c: c["w"])) + 1e-20).alias("t"))
    return let(
        summed, lambda s: F.transform(s["c"], lambda c: F.struct(c["e"].alias("e"), (c["w"] / s["t"]).alias("w")))
    )


def scaled(chosen: Column, factor: float) -> Column:
    return F.transform(chosen, lambda c: F.struct(c["e"].alias("e"), (c["w"] * factor).alias("w")))


def mean_vector(rows: DataFrame, keys: list[str], column: str, size: int, out: str) -> DataFrame:
    """Element-wise mean of an array column; each element is one average that combines before the shuffle."""
    means = [F.avg(F.get(column, F.lit(i))).alias(f"_m{i}") for i in range(size)]
    return rows.groupBy(*keys).agg(*means).select(*keys, F.array(*[f"_m{i}" for i in range(size)]).alias(out))


def hard_group(rows: DataFrame, groups: int, per_group: int, k: int) -> DataFrame:
    """One group per sequence by pooled dialect logits; experts outside it weigh 0; then top-k."""
    pooled = mean_vector(rows, ["seq"], "dialect_logits", groups, "pooled")
    picked = pooled.select("seq", argmax(F.col("pooled")).alias("group"))
    inside = F.transform(
        softmax("expert_logits"),
        lambda w, e: F.when(F.floor(e / per_group) == F.col("group"), w).otherwise(0.0),
    )
    return rows.join(picked, "seq").withColumn("chosen", top_k(inside, k))


def group_limited(scores: Column, groups: int, per_group: int, keep_groups: int, k: int) -> Column:
    """Keep the groups with the best single scores, zero the others, then top-k."""
    best = F.transform(
        F.sequence(F.lit(0), F.lit(groups - 1)),
        lambda g: F.array_max(F.slice(scores, g * per_group + 1, per_group)),
    )
    kept = F.transform(top_k(best, keep_groups), lambda c: c["e"])
    inside = let(
        kept,
        lambda groups_kept: F.transform(
            scores,
            lambda s, e: F.when(F.array_contains(groups_kept, F.floor(e / per_group).cast("int")), s).otherwise(0.0),
        ),
    )
    return top_k(inside, k)


def sequence_groups(rows: DataFrame, column: str, size: int) -> DataFrame:
    """Group label of each sequence by pooled argmax, with the size of its group."""
    labels = mean_vector(rows, ["seq"], column, size, "pooled").select("seq", argmax(F.col("pooled")).alias("label"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("group_size"))
    return labels.join(sizes, "label").select("seq", "label", "group_size")


def long_choice(rows: DataFrame, chosen: Column) -> DataFrame:
    """`(seq, pos, rank, e, w)`: one row per chosen expert."""
    return rows.select("seq", "pos", F.posexplode(chosen).alias("rank", "c")).select("seq", "pos", "rank", "c.e", "c.w")


def dispatch_plan(choice: DataFrame) -> DataFrame:
    """Tokens per expert with start and end offsets after sorting by expert; idle experts do not occur."""
    counts = choice.groupBy("e").agg(F.count("*").alias("n_tokens"))
    # One row per expert, so the window is as small as the model's expert count.
    upto = Window.partitionBy(F.lit(0)).orderBy("e").rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("end_at", F.sum("n_tokens").over(upto))
    return ends.withColumn("start_at", F.col("end_at") - F.col("n_tokens"))


def assemble_log(steps: DataFrame) -> DataFrame:
    """Generation steps `(layer, seq, step, at, …)` joined along the tokens: `pos` counts on over the steps.

    Offsets come from the step lengths, so no sequence is numbered row by row.
    """
    lengths = steps.groupBy("layer", "seq", "step").agg(F.count("*").alias("n"))
    before = Window.partitionBy("layer", "seq").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select("layer", "seq", "step", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = steps.join(offsets, ["layer", "seq", "step"])
    return joined.withColumn("pos", F.col("before") + F.col("at")).drop("before", "step", "at")
