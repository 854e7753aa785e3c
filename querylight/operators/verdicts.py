"""Verdict codes per pair, and their roll-up to scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylight.operators.cells import as_rows
from querylight.operators.frames import subset_match
from querylight.operators.match import result_eq
from querylight.operators.similarity import df_sim_is_one, text_similarity
from querylight.session import stage

RELATIONAL = ["postgresql", "mysql", "sqlite"]
GRAPH = ["cypher", "ngql"]
DIALECTS = ["postgresql", "mysql", "cypher", "sqlite", "ngql"]
METRICS = ["ex", "df_ex", "executable", "similarity"]


def valid_gold(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """`valid`: the gold result has rows and no null cell."""
    clean = (
        as_rows(cells)
        .filter("side = 'gold'")
        .groupBy("pair_id")
        .agg((F.count_if(F.array_contains("vals", "null:")) == 0).alias("valid"))
    )
    return pairs.select("pair_id").join(clean, "pair_id", "left").na.fill(False, ["valid"])


def relational_verdicts(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """`execution_match`, `df_match`: -2 gold unusable, -1 prediction failed, else 1 or 0."""
    pairs = pairs.filter(F.col("sql_type").isin(RELATIONAL))
    valid = valid_gold(cells, pairs)
    usable = stage(pairs.join(valid.filter("valid"), "pair_id", "left_semi").filter("err is null"), "usable")
    match = result_eq(cells, usable)
    subset = subset_match(cells, usable)

    def code(verdict: Column) -> Column:
        bit = F.coalesce(verdict, F.lit(False)).cast("int")
        return F.when(~F.col("valid"), -2).when(F.col("err").isNotNull(), -1).otherwise(bit)

    return (
        pairs.join(valid, "pair_id")
        .join(match, "pair_id", "left")
        .join(subset, "pair_id", "left")
        .select(
            *pairs.columns,
            "valid",
            code(F.col("match")).alias("execution_match"),
            code(F.col("subset")).alias("df_match"),
        )
        .withColumn("error", F.when(F.col("execution_match") == -1, F.col("err")).otherwise(""))
    )


def graph_verdicts(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Graph dialects: every gold is valid; -1 when the prediction failed, else similarity is 1 or not.

    Only the failed predictions carry a `df_match`; it is -1 there and 0 elsewhere.
    """
    pairs = pairs.filter(F.col("sql_type").isin(GRAPH))
    usable = pairs.filter("err is null")
    same = df_sim_is_one(cells, usable)
    failed = F.col("err").isNotNull()
    return pairs.join(same, "pair_id", "left").select(
        *pairs.columns,
        F.lit(True).alias("valid"),
        F.when(failed, -1).otherwise(F.coalesce("same", F.lit(False)).cast("int")).alias("execution_match"),
        F.when(failed, -1).otherwise(0).alias("df_match"),
        F.when(failed, F.col("err")).otherwise("").alias("error"),
    )


def verdicts(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both verdict paths, with the similarity of the two query texts."""
    cells = cells if "vals" in cells.columns else stage(as_rows(cells), "rows")
    relational = stage(relational_verdicts(cells, pairs), "relational")
    graph = stage(graph_verdicts(cells, pairs), "graph")
    return text_similarity(relational.unionByName(graph), "gold_sql", "pred_sql")


def tally(coded: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of valid, matching and failed pairs and the summed similarity."""
    valid = F.col("execution_match") != -2
    return coded.groupBy(*keys).agg(
        F.count_if(valid).alias("valid_count"),
        F.count_if(F.col("execution_match") == 1).alias("match_count"),
        F.count_if(F.col("df_match") == 1).alias("df_match_count"),
        F.count_if(F.col("execution_match") == -1).alias("sql_error_count"),
        F.sum(F.when(valid, F.col("similarity")).otherwise(0.0)).alias("similarity_sum"),
    )


def scores() -> list[Column]:
    """Percent scores from the counts of `tally`; null where nothing is valid."""

    def percent(part: str) -> Column:
        return 100 * F.round(F.expr(f"try_divide({part}, valid_count)"), 5)

    return [
        percent("match_count").alias("ex"),
        percent("df_match_count").alias("df_ex"),
        percent("(valid_count - sql_error_count)").alias("executable"),
        percent("similarity_sum").alias("similarity"),
    ]


def metric_by_dialect(coded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Scores per dialect (or other keys); keys without a valid pair are left out."""
    keys = keys or ["sql_type"]
    counts = tally(coded, keys).filter("valid_count > 0")
    return counts.select(*keys, "valid_count", "match_count", "df_match_count", "sql_error_count", *scores())


def metric_overall(coded: DataFrame) -> DataFrame:
    """Scores over all pairs."""
    return tally(coded, []).select("valid_count", "match_count", "df_match_count", "sql_error_count", *scores())


def metric_wide(by_dialect: DataFrame) -> DataFrame:
    """One row with a column `eval_{dialect}_{metric}` for each dialect and metric."""
    cells = [
        F.max(F.when(F.col("sql_type") == d, F.col(m))).alias(f"eval_{d}_{m}") for d in DIALECTS for m in METRICS
    ]
    return by_dialect.agg(*cells)


def metric_history(coded: DataFrame, call: str, eval_steps: int) -> DataFrame:
    """Scores per evaluation step, the step being the call number times the evaluation interval."""
    stepped = coded.withColumn("step", F.col(call) * eval_steps)
    return metric_by_dialect(stepped, ["step", "sql_type"])


def verdict_counts(coded: DataFrame) -> DataFrame:
    """How often each code and error text occurs, with totals per dialect and over all."""
    return (
        coded.rollup("sql_type", "execution_match", "error")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
        .select(
            F.coalesce("sql_type", F.lit("*")).alias("sql_type"),
            F.coalesce(F.col("execution_match").cast("string"), F.lit("*")).alias("execution_match"),
            F.coalesce("error", F.lit("*")).alias("error"),
            "level",
            "n",
        )
    )
