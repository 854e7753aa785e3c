"""Structured Streaming forms of the step log and the running scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylight.operators.verdicts import scores, tally
from querylight.session import stage_path


def process_sums(log: DataFrame, losses: list[str], interval: int) -> DataFrame:
    """Sums of the losses and the last step per logging interval and process, batch or streaming."""
    keyed = log.withColumn("interval", F.floor((F.col("step") - 1) / interval))
    return keyed.groupBy("interval", "process").agg(F.max("step").alias("last"), *[F.sum(c).alias(c) for c in losses])


def means_of(sums: DataFrame, losses: list[str], interval: int, digits: int) -> DataFrame:
    steps = F.max("last") - F.col("interval") * interval
    means = [F.round(F.avg(c) / steps, digits).alias(c) for c in losses]
    return sums.groupBy("interval").agg(F.max("last").alias("step"), *means)


def interval_means(log: DataFrame, losses: list[str], interval: int, digits: int = 4) -> DataFrame:
    """Mean of each loss per logging interval of a step log `(step, process, …)`.

    Per interval the losses are summed within each process, averaged over the processes and divided
    by the number of steps since the last log, which is smaller in the last interval.
    """
    return means_of(process_sums(log, losses, interval), losses, interval, digits)


def drain_interval_means(
    stream: DataFrame, losses: list[str], interval: int, digits: int = 4, folder: str | None = None
) -> DataFrame:
    """`interval_means` over the step-log files at hand, which may come in any order and any number of batches.

    The state holds one row per interval and process, so its size follows the log's intervals and not its steps, and a
    late step still meets the sums of its interval. Each batch writes the sums that changed; the means are taken over the
    newest of each. With a `folder` of the caller's, the next call goes on where the last one ended.
    """
    sums = process_sums(stream, losses, interval)
    return means_of(drain_update(sums, "interval-sums", ["interval", "process"], folder), losses, interval, digits)


def window_means(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling-window mean of `value` per event type, batch or streaming.

    Times without a zone are read as UTC, and window starts are given the same way.
    """
    here, utc = F.current_timezone(), F.lit("UTC")
    ts = F.col("ts")
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        ts = F.convert_timezone(utc, here, ts).cast("timestamp")
    timed = events.withColumn("ts", ts).withWatermark("ts", late)
    sums = timed.groupBy(F.window("ts", every), "event_type").agg(
        F.avg("value").alias("mean_value"), F.count("*").alias("n")
    )
    start = F.convert_timezone(here, utc, F.col("window.start").cast("timestamp_ntz"))
    return sums.select(start.alias("window_start"), "event_type", "mean_value", "n")


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, per_batch: int | None = None
) -> DataFrame:
    """Parquet files as they arrive, at most `per_batch` of them in a batch."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def drain_update(stream: DataFrame, name: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """Run over the files at hand in update mode: each batch adds only the rows that changed, and the
    newest row of each key is the result. State older than the watermark is dropped. A `folder` of the
    caller's keeps rows and progress for a later call; else both are staged."""
    spark = stream.sparkSession
    out = f"{folder}/rows" if folder else stage_path(spark, name)
    state = f"{folder}/state" if folder else stage_path(spark, f"{name}-state")
    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(lambda batch, at: batch.write.mode("overwrite").parquet(f"{out}/batch={at}"))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    changes = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"row.{c}") for c in stream.columns])


def drain_append(stream: DataFrame, name: str) -> DataFrame:
    """Run over the files at hand in append mode: a window is written once the watermark passes its end."""
    spark = stream.sparkSession
    out = stage_path(spark, name)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", stage_path(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def running_scores(verdicts: DataFrame) -> DataFrame:
    """Scores per dialect over arriving verdict rows."""
    counts = tally(verdicts, ["sql_type"]).filter("valid_count > 0")
    return counts.select("sql_type", "valid_count", "match_count", "df_match_count", "sql_error_count", *scores())
