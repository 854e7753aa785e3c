"""Query results as a source: run each distinct read-only query once, keep failures as rows."""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import batched

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylight.operators.cells import canonical_cells, melt
from querylight.operators.numbering import number_rows
from querylight.session import scratch, stage, stage_path

CELLS = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("col_idx", T.IntegerType()),
        T.StructField("cell", T.StringType()),
    ]
)
ERRORS = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("err", T.StringType())])
# Plan nodes that change something or run a program. Data-changing statements are commands or parsed statements.
REFUSED = (
    "org.apache.spark.sql.catalyst.plans.logical.Command",
    "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement",
    "org.apache.spark.sql.catalyst.plans.logical.ScriptTransformation",
    "org.apache.spark.sql.catalyst.plans.logical.CompoundPlanStatement",
)


def run_queries(
    spark: SparkSession, queries: DataFrame, seconds: float | None = None, at_once: int = 4, batch: int = 256
) -> tuple[DataFrame, DataFrame]:
    """`queries(sql)` to result cells `(query_id, row_idx, col_idx, cell)` and errors `(query_id, err)`.

    A query id is the md5 of the text. The driver walks the distinct texts in batches, keeps `at_once` of them running,
    and sees no result rows: each result is numbered, melted and written by the executors, and its staged tables go
    when it is written. A query that fails, is not done after `seconds` (waits for cores included) or is not read-only ends as
    an error row; the error rows of a batch are appended to a table, so the driver holds one batch of texts whatever
    their number.
    """
    found, failed = stage_path(spark, "results"), stage_path(spark, "errors")
    spark.createDataFrame([], CELLS).write.parquet(f"{found}/none")
    spark.createDataFrame([], ERRORS).write.parquet(failed)
    texts = queries.select("sql").distinct().withColumn("query_id", F.md5("sql"))

    @inheritable_thread_target(spark)
    def run(row: Row) -> tuple[str, str | None]:
        return row["query_id"], _run_one(spark, row["sql"], row["query_id"], found, seconds)

    with ThreadPoolExecutor(at_once, "query") as pool:
        for some in batched(texts.filter("sql is not null").toLocalIterator(), batch):
            errors = [(query_id, error) for query_id, error in pool.map(run, some) if error is not None]
            if errors:
                spark.createDataFrame(errors, ERRORS).write.mode("append").parquet(failed)
    return spark.read.schema(CELLS).parquet(f"{found}/*"), spark.read.schema(ERRORS).parquet(failed)


def is_read_only(spark: SparkSession, sql: str) -> bool:
    """The session's own parse of the text holds no node that writes, configures or runs a program, at any depth."""
    open_nodes = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    kinds = [spark._jvm.java.lang.Class.forName(name) for name in REFUSED]
    while open_nodes:
        node = open_nodes.pop()
        if any(kind.isInstance(node) for kind in kinds):
            return False
        for below in (node.children(), node.innerChildren()):
            open_nodes += [below.apply(i) for i in range(below.size())]
    return True


def _run_one(spark: SparkSession, sql: str, query_id: str, path: str, seconds: float | None) -> str | None:
    """Write the result cells of one query, or return its error text."""
    try:
        if not is_read_only(spark, sql):
            return "not a read-only query"
    except Exception as error:  # noqa: BLE001
        return str(error).split("\n")[0]
    context = spark.sparkContext
    tag = f"query-{uuid.uuid4().hex}"
    context.addJobTag(tag)
    timer = threading.Timer(seconds, context.cancelJobsWithTag, [tag]) if seconds else None
    try:
        if timer:
            timer.start()
        with scratch(spark):
            result = spark.sql(sql)
            named = result.toDF(*[f"col_{i + 1}" for i in range(len(result.columns))])
            # The written table keeps the result order as a column before anything is shuffled again.
            placed = stage(named.withColumn("_at", F.monotonically_increasing_id()), "result")
            numbered = number_rows(placed, [], ["_at"])
            raw = melt(numbered, ["row_idx"], named.columns)
            keyed = raw.withColumn("pair_id", F.lit(query_id)).withColumn("side", F.lit(""))
            cells = canonical_cells(keyed).select(F.col("pair_id").alias("query_id"), "row_idx", "col_idx", "cell")
            cells.write.parquet(f"{path}/{query_id}")
        return None
    except Exception as error:  # noqa: BLE001
        return str(error).split("\n")[0]
    finally:
        if timer:
            timer.cancel()
        context.removeJobTag(tag)


def run_pairs(
    spark: SparkSession, pairs: DataFrame, seconds: float | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`pairs(pair_id, gold_sql, pred_sql)` to results per distinct text pair.

    Gives `cases(pair_id, case_id)`, `cells(case_id, side, …)` and `errors(case_id, side, err)`. A
    text shared by many pairs runs once, and results are laid out once per distinct text pair, so
    compare the cases and join the verdicts back to the pairs.
    """
    cases = stage(pairs.withColumn("case_id", F.md5(F.concat_ws("\0", "gold_sql", "pred_sql"))), "cases")
    sides = F.array(
        F.struct(F.lit("gold").alias("side"), F.col("gold_sql").alias("sql")),
        F.struct(F.lit("pred").alias("side"), F.col("pred_sql").alias("sql")),
    )
    distinct = cases.select("case_id", "gold_sql", "pred_sql").distinct()
    asked = stage(distinct.select("case_id", F.explode(sides).alias("s")).select("case_id", "s.*"), "asked")
    cells, errors = run_queries(spark, asked, seconds)
    keyed = asked.withColumn("query_id", F.md5("sql")).select("case_id", "side", "query_id")
    return (
        cases.select("pair_id", "case_id"),
        keyed.join(cells, "query_id").drop("query_id"),
        keyed.join(errors, "query_id").drop("query_id"),
    )
