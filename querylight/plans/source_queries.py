"""Files written from the tables and read back, and query results as a source."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylight.operators.cells import result_rows, shapes
from querylight.plans.example_inputs import EXAMPLE_CTE, examples
from querylight.plans.registry import query, table
from querylight.session import stage_path
from querylight.sources import files
from querylight.sources.runner import run_pairs

EXAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("db_id", T.StringType()),
        T.StructField("sql_type", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("rewrite", T.StringType()),
        T.StructField("sql", T.StringType()),
    ]
)
COLUMNS = "id, db_id, sql_type, question, coalesce(rewrite, '(none)') as rewrite, sql"


def written(spark, sf_dir):
    return examples(spark, sf_dir).select(*EXAMPLE_SCHEMA.names)


def shown(df):
    return df.withColumn("rewrite", F.coalesce("rewrite", F.lit("(none)")))


@query("src_json_array", f"with {EXAMPLE_CTE} select {COLUMNS} from examples")
def src_json_array(spark, sf_dir):
    path = stage_path(spark, "json-arrays")
    files.write_json_arrays(written(spark, sf_dir), path, "id")
    return shown(files.read_json_array(spark, path, EXAMPLE_SCHEMA))


@query("src_jsonl", f"with {EXAMPLE_CTE} select {COLUMNS} from examples")
def src_jsonl(spark, sf_dir):
    path = stage_path(spark, "jsonl")
    files.write_json_lines(written(spark, sf_dir), path)
    return shown(files.read_json_lines(spark, path, EXAMPLE_SCHEMA))


@query(
    "src_text_lines",
    r"""select regexp_replace(line, '^\s+|\s+$', '', 'g') as line, count(*) as n
    from (select unnest(string_split(text, chr(10))) as line from documents) group by 1""",
)
def src_text_lines(spark, sf_dir):
    path = stage_path(spark, "lines")
    files.write_lines(table(spark, sf_dir, "documents").select("text"), path)
    return files.read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(
    "src_synonyms",
    """with lines as (select 'part_' || p_partkey as key, p_name, p_brand from part)
    select p_name as alias, key as canonical from lines union all select p_brand, key from lines
    union all select key, key from lines""",
)
def src_synonyms(spark, sf_dir):
    path = stage_path(spark, "synonyms")
    key = F.concat(F.lit("part_"), F.col("p_partkey").cast("string"))
    line = F.concat(key, F.lit("\t"), "p_name", F.lit("、"), "p_brand")
    files.write_lines(table(spark, sf_dir, "part").select(line.alias("value")), path)
    return files.read_synonyms(spark, path)


@query("src_head_n", f"with {EXAMPLE_CTE} select {COLUMNS} from examples order by id limit 100")
def src_head_n(spark, sf_dir):
    path = stage_path(spark, "jsonl")
    files.write_json_lines(written(spark, sf_dir), path)
    return shown(files.head_by(files.read_json_lines(spark, path, EXAMPLE_SCHEMA), "id", 100))


@query("src_sharded_union", f"with {EXAMPLE_CTE} select {COLUMNS}, id % 4 as shard from examples")
def src_sharded_union(spark, sf_dir):
    path = stage_path(spark, "shards")
    files.write_json_lines(written(spark, sf_dir).withColumn("shard", F.col("id") % 4), path, ["shard"])
    schema = T.StructType([*EXAMPLE_SCHEMA.fields, T.StructField("shard", T.LongType())])
    shards = spark.read.schema(schema).option("basePath", path).json(f"{path}/shard=*")
    return shown(shards)


# Few distinct texts over many pairs, each over whole tables: good ones, a wrong column, a broken
# statement and one that would change data.
GOLD_SQL = """case cast(doc_id % 6 as int)
    when 0 then 'select count(*) as n from orders'
    when 1 then 'select o_orderkey, c_name from orders join customer on o_custkey = c_custkey order by o_orderkey'
    when 2 then 'select p_name from part where p_size > 10'
    when 3 then 'select n_name, n_regionkey from nation;'
    when 4 then 'select l_orderkey from lineitem order by l_orderkey limit 5'
    else 'selct * from events' end"""
PRED_SQL = """case cast(doc_id % 6 as int)
    when 0 then 'select count(*) as n from orders'
    when 1 then 'select c_name, o_orderkey from orders join customer on o_custkey = c_custkey'
    when 2 then 'select p_nam from part'
    when 3 then 'select n_name from nation'
    when 4 then 'delete from lineitem'
    else 'select event_type, count(*) as n from events group by event_type' end"""


@query(
    "eval_run_pairs",
    """with facts(k, side, n_rows, n_cols, failed) as (
      select 0, 'gold', 1, 1, false union all select 0, 'pred', 1, 1, false
      union all select 1, 'gold', (select count(*) from orders join customer on o_custkey = c_custkey), 2, false
      union all select 1, 'pred', (select count(*) from orders join customer on o_custkey = c_custkey), 2, false
      union all select 2, 'gold', (select count(*) from part where p_size > 10), 1, false
      union all select 2, 'pred', 0, 0, true
      union all select 3, 'gold', (select count(*) from nation), 2, false
      union all select 3, 'pred', (select count(*) from nation), 1, false
      union all select 4, 'gold', 5, 1, false union all select 4, 'pred', 0, 0, true
      union all select 5, 'gold', 0, 0, true
      union all select 5, 'pred', (select count(distinct event_type) from events), 2, false)
    select doc_id as pair_id, side, n_rows, n_cols, failed from documents join facts on k = doc_id % 6""",
)
def eval_run_pairs(spark, sf_dir):
    for name in ("orders", "customer", "part", "nation", "lineitem", "events"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    pairs = table(spark, sf_dir, "documents").selectExpr("doc_id as pair_id", f"{GOLD_SQL} as gold_sql", f"{PRED_SQL} as pred_sql")
    cases, cells, errors = run_pairs(spark, pairs, seconds=120)
    shape = shapes(result_rows(cells.withColumnRenamed("case_id", "pair_id"))).withColumnRenamed("pair_id", "case_id")
    failed = errors.groupBy("case_id").agg(F.collect_set("side").alias("failed"))

    def side(name):
        rows = F.coalesce(f"{name}_rows", F.lit(0)).alias("n_rows")
        cols = F.coalesce(f"{name}_cols", F.lit(0)).alias("n_cols")
        lost = F.coalesce(F.array_contains("failed", name), F.lit(False)).alias("failed")
        return F.struct(F.lit(name).alias("side"), rows, cols, lost)

    known = cases.join(shape, "case_id", "left").join(failed, "case_id", "left")
    return known.select("pair_id", F.explode(F.array(side("gold"), side("pred"))).alias("s")).select("pair_id", "s.*")
