"""Step log and running scores, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylight.plans.eval_queries import CODED_CTE, SCORES, TALLY, coded, tidy
from querylight.plans.registry import query, table
from querylight.session import stage_path
from querylight.streaming import jobs


INTERVAL_SQL = """with log as (select event_id + 1 as step, user_id % 4 as process, value as loss,
        cast(length(event_type) as double) as aux from events),
    p as (select cast(floor((step - 1) / 100) as bigint) as "interval", process, max(step) as last, sum(loss) as loss,
        sum(aux) as aux from log group by 1, 2)
    select "interval", max(last) as step, round(avg(loss) / (max(last) - "interval" * 100), 6) as loss,
      round(avg(aux) / (max(last) - "interval" * 100), 6) as aux from p group by "interval" """


# Batches in which the step log arrives.
ARRIVALS = 4


def step_log(events):
    return events.selectExpr(
        "event_id + 1 as step",
        "user_id % 4 as process",
        "value as loss",
        "cast(length(event_type) as double) as aux",
    )


@query("steplog_interval_mean", INTERVAL_SQL)
def steplog_interval_mean(spark, sf_dir):
    return jobs.interval_means(step_log(table(spark, sf_dir, "events")), ["loss", "aux"], 100, digits=6)


@query("steplog_interval_stream", INTERVAL_SQL)
def steplog_interval_stream(spark, sf_dir):
    """The log arrives in four batches, the rows dealt to their files by hash, so that most intervals span several batches.

    The number of batches does not grow with the table: each one reads and writes the whole state.
    """
    log = step_log(table(spark, sf_dir, "events"))
    files = max(ARRIVALS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = stage_path(spark, "step-log")
    log.repartition(files, F.xxhash64("step")).write.parquet(path)
    stream = jobs.file_stream(spark, path, log.schema, per_batch=-(-files // ARRIVALS))
    return jobs.drain_interval_means(stream, ["loss", "aux"], 100, digits=6)


@query(
    "steplog_stream",
    """select cast(date_trunc('day', ts) as date) as day, event_type, round(avg(value), 6) as mean_value, count(*) as n
    from events group by 1, 2""",
)
def steplog_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = jobs.window_means(jobs.file_stream(spark, sf_dir, schema, "events.parquet"))
    means = jobs.drain_update(stream, "window-means", ["window_start", "event_type"])
    return means.select(
        F.to_date("window_start").alias("day"), "event_type", F.round("mean_value", 6).alias("mean_value"), "n"
    )


@query(
    "metric_stream",
    f"{CODED_CTE}, t as (select sql_type, {TALLY} from coded group by all) select sql_type, {SCORES} from t",
)
def metric_stream(spark, sf_dir):
    """Verdict files arrive in one folder per shard; the scores follow them."""
    path = stage_path(spark, "verdicts")
    rows = coded(spark, sf_dir).select("pair_id", "sql_type", "execution_match", "df_match", "similarity")
    rows.withColumn("shard", F.col("pair_id") % 4).write.partitionBy("shard").parquet(path)
    stream = jobs.running_scores(jobs.file_stream(spark, f"{path}/shard=*", rows.schema))
    return tidy(jobs.drain_update(stream, "scores", ["sql_type"]))
