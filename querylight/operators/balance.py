"""Load balance scores, dialect losses and router reports over router logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylight.functions.vectors import argmax, let, log_softmax, softmax, top_k, total
from querylight.operators.routing import dialect_weighted, mean_vector, soft_weights


def expert_shares(rows: DataFrame, logits: Column, k: int, keys: list[str] | None = None) -> DataFrame:
    """`(keys, e, hits, score)`: how often an expert is in the top-k, and its summed softmax score."""
    keys = keys or []
    scored = rows.select(*keys, softmax(logits).alias("s"))
    chosen = F.transform(top_k(F.col("s"), k), lambda c: c["e"])
    marked = let(
        chosen,
        lambda c: F.transform("s", lambda p, e: F.struct(p.alias("p"), F.array_contains(c, e).cast("int").alias("hit"))),
    )
    each = scored.select(*keys, F.posexplode(marked).alias("e", "m"))
    return each.groupBy(*keys, "e").agg(
        F.sum("m.hit").alias("hits"), F.sum("m.p").alias("score"), F.count("*").alias("n")
    )


def balance_loss(rows: DataFrame, experts: int, k: int, logits: Column | None = None) -> DataFrame:
    """E · Σ share of tokens per expert · mean score per expert."""
    logits = F.col("expert_logits") if logits is None else logits
    per_expert = expert_shares(rows, logits, k)
    return per_expert.agg(
        (experts * F.sum(F.col("hits") / F.col("n") * F.col("score") / F.col("n"))).alias("loss")
    )


def balance_loss_masked(rows: DataFrame, experts: int, k: int) -> DataFrame:
    """The same over the tokens that are not padding."""
    return balance_loss(rows.filter("mask = 1"), experts, k)


def balance_loss_in_group(rows: DataFrame, per_group: int, k: int) -> DataFrame:
    """The same with the logits cut into one row per dialect group."""
    starts = F.sequence(F.lit(0), F.size("expert_logits") - per_group, F.lit(per_group))
    cut = F.explode(F.transform(starts, lambda i: F.slice("expert_logits", i + 1, per_group)))
    return balance_loss(rows.select(cut.alias("cut")), per_group, k, F.col("cut"))


def balance_loss_seq(rows: DataFrame, experts: int, k: int, alpha: float) -> DataFrame:
    """`seq_loss` from per-sequence shares, and `global_loss` from shares over all tokens."""
    per_seq = expert_shares(rows, F.col("expert_logits"), k, ["seq"])
    ce = F.col("hits") * experts / (F.col("n") * k)
    by_seq = per_seq.groupBy("seq").agg(F.sum(ce * F.col("score") / F.col("n")).alias("v"))
    sums = per_seq.groupBy("e").agg(F.sum("hits").alias("hits"), F.sum("score").alias("score"), F.sum("n").alias("n"))
    whole = sums.agg((alpha * experts * F.sum(F.col("hits") / (F.col("n") * k) * F.col("score") / F.col("n"))).alias("g"))
    return by_seq.agg((alpha * F.avg("v")).alias("seq_loss")).withColumn("global_loss", whole.scalar())


def dialect_losses(log: DataFrame, labels: DataFrame, groups: int, smooth: float = 0.1) -> DataFrame:
    """Cross-entropy of the pooled dialect logits against the dialect id, plain and label-smoothed, per batch.

    `labels(seq, batch, label)`; a batch with a row of no dialect id is left out.
    """
    pooled = mean_vector(log, ["seq"], "dialect_logits", groups, "pooled")
    rows = labels.join(pooled, "seq").withColumn("logp", log_softmax(F.col("pooled")))
    smoothed = total(
        F.transform("logp", lambda p, i: p * (F.when(i == F.col("label"), 1.0 - smooth).otherwise(0.0) + smooth / groups))
    )
    return (
        rows.groupBy("batch")
        .agg(
            F.avg(-F.get("logp", F.col("label"))).alias("cross_entropy"),
            F.avg(-smoothed).alias("smoothed"),
            F.count_if(F.col("label").isNull()).alias("unknown"),
        )
        .filter("unknown = 0")
        .drop("unknown")
    )


def report_expert_weights(log: DataFrame, experts: int, groups: int) -> DataFrame:
    """`(e, weight)`: softmax of the mean expert logits times the group's softmax weight."""
    means = [F.avg(F.get("expert_logits", F.lit(i))) for i in range(experts)]
    dialects = [F.avg(F.get("dialect_logits", F.lit(i))) for i in range(groups)]
    both = log.agg(F.array(*means).alias("m"), F.array(*dialects).alias("d"))
    weights = dialect_weighted(softmax("m"), softmax("d"), experts // groups)
    return both.select(F.posexplode(weights).alias("e", "weight"))


def report_dialect_votes(log: DataFrame, groups: int) -> DataFrame:
    """`(dialect, votes, share)`: tokens won per dialect with layers averaged, and the softmax of the counts."""
    per_token = mean_vector(log, ["seq", "pos"], "dialect_logits", groups, "mean")
    won = argmax(softmax("mean"))
    counts = per_token.agg(F.array(*[F.count_if(won == i) for i in range(groups)]).alias("votes"))
    shares = softmax(F.col("votes").cast("array<double>"))
    both = F.arrays_zip(F.col("votes"), shares.alias("share"))
    return counts.select(F.posexplode(both).alias("dialect", "b")).select("dialect", "b.votes", "b.share")


def report_layer_weights(log: DataFrame, layer: int, experts: int, per_group: int) -> DataFrame:
    """`(e, weight)`: mean combined expert weight in one layer."""
    weighted = log.filter(F.col("layer") == layer).select(soft_weights(per_group).alias("w"))
    means = weighted.agg(F.array(*[F.avg(F.get("w", F.lit(i))) for i in range(experts)]).alias("m"))
    return means.select(F.posexplode("m").alias("e", "weight"))


def report_expert_hits(log: DataFrame, per_group: int, k: int = 2) -> DataFrame:
    """`(e, hits)`: how often each expert is among the k best over all layers and tokens."""
    best = F.transform(top_k(soft_weights(per_group), k), lambda c: c["e"])
    return log.select(F.explode(best).alias("e")).groupBy("e").agg(F.count("*").alias("hits"))
