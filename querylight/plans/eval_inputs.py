"""Gold and predicted result tables derived from `orders`: one pair per customer.

The predicted result differs from the gold one by `pair_id % 8`: same, two columns swapped, rows
reversed, last row missing, one number changed, extra column, first row repeated, query failed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylight.operators.cells import melt, row_form
from querylight.operators.numbering import number_rows
from querylight.plans.registry import table
from querylight.session import stage

SQL_TYPE = """case cast({key} % 5 as int) when 0 then 'mysql' when 1 then 'postgresql' when 2 then 'sqlite'
    when 3 then 'cypher' else 'ngql' end"""

PAIR_COLUMNS = {
    "sql_type": SQL_TYPE.format(key="pair_id"),
    "err": "case when pair_id % 8 = 7 then 'syntax error' end",
    "gold_sql": """concat('select o_orderstatus, o_orderpriority from orders where o_custkey = ',
        cast(pair_id as varchar(20)), case when pair_id % 4 = 0 then ' order by o_orderkey' else '' end)""",
    "pred_sql": """concat(case cast(pair_id % 8 as int)
            when 1 then 'select o_orderpriority, o_orderstatus from orders where o_custkey = '
            when 3 then 'select o_orderstatus, o_orderpriority from orders limit 3 -- '
            when 4 then 'select o_orderstatus, o_totalprice + 1 from orders where o_custkey = '
            when 7 then 'selct status form orders wher custkey = '
            else 'select o_orderstatus, o_orderpriority from orders where o_custkey = ' end,
        cast(pair_id as varchar(20)),
        case when pair_id % 4 = 0 then ' order by o_orderkey' when pair_id % 8 = 2 then ' order by 1 desc' else '' end)""",
}
PAIR_SELECT = [f"{sql} as {name}" for name, sql in PAIR_COLUMNS.items()]

EVAL_CTE = f"""
pairs as (
  select pair_id, {', '.join(PAIR_SELECT)} from (select distinct o_custkey as pair_id from orders)
),
gold_rows as (
  select o_custkey as pair_id,
    row_number() over (partition by o_custkey order by o_orderkey) - 1 as row_idx,
    count(*) over (partition by o_custkey) as n,
    o_orderstatus as c0, o_orderpriority as c1, cast(floor(o_totalprice) as bigint) as c2,
    case when o_custkey % 11 = 0 and o_orderkey % 2 = 0 then null else cast(year(o_orderdate) as bigint) end as c3
  from orders where o_custkey % 13 <> 0
),
pred_rows as (
  select pair_id, case when pair_id % 8 = 2 then n - 1 - row_idx else row_idx end as row_idx,
    case when pair_id % 8 = 1 then c1 else c0 end as c0, case when pair_id % 8 = 1 then c0 else c1 end as c1,
    case when pair_id % 8 = 4 and row_idx = 0 then c2 + 1 else c2 end as c2, c3
  from gold_rows where pair_id % 8 <> 7 and not (pair_id % 8 = 3 and row_idx = n - 1)
  union all
  select pair_id, n, c0, c1, c2, c3 from gold_rows where pair_id % 8 = 6 and row_idx = 0
),
sides as (
  select pair_id, 'gold' as side, row_idx, c0, c1, c2, c3 from gold_rows
  union all select pair_id, 'pred', row_idx, c0, c1, c2, c3 from pred_rows
),
cells as (
  select pair_id, side, row_idx, 0 as col_idx, 'str:' || c0 as cell from sides
  union all select pair_id, side, row_idx, 1, 'str:' || c1 from sides
  union all select pair_id, side, row_idx, 2, 'num:' || cast(cast(c2 as double) as varchar) from sides
  union all select pair_id, side, row_idx, 3, coalesce('num:' || cast(cast(c3 as double) as varchar), 'null:') from sides
  union all select pair_id, side, row_idx, 4, 'num:' || cast(cast(row_idx as double) as varchar) from sides
    where side = 'pred' and pair_id % 8 = 5
),
full_rows as (
  select pair_id, side, row_idx, array_to_string(list(cell order by col_idx), '|') as row_key,
    array_to_string(list_sort(list(cell)), '|') as bag_key,
    array_to_string(list_sort(list(distinct cell)), '|') as set_key
  from cells group by pair_id, side, row_idx
)"""


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pairs(pair_id, sql_type, err, gold_sql, pred_sql)`."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair_id")).distinct()
    return keys.selectExpr("pair_id", *PAIR_SELECT)


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of both sides in columns c0 to c4; c4 counts only where `has_extra` holds."""
    orders = table(spark, sf_dir, "orders").filter("o_custkey % 13 <> 0")
    gold = number_rows(
        orders.selectExpr(
            "o_custkey as pair_id",
            "o_orderkey",
            "o_orderstatus as c0",
            "o_orderpriority as c1",
            "cast(floor(o_totalprice) as bigint) as c2",
            "case when o_custkey % 11 = 0 and o_orderkey % 2 = 0 then null else cast(year(o_orderdate) as bigint) end as c3",
        ),
        ["pair_id"],
        ["o_orderkey"],
        total="n",
    )
    kind = F.col("pair_id") % 8
    idx, n = F.col("row_idx"), F.col("n")
    places = (
        F.when((kind == 7) | ((kind == 3) & (idx == n - 1)), F.array().cast("array<bigint>"))
        .when(kind == 2, F.array(n - 1 - idx))
        .when((kind == 6) & (idx == 0), F.array(idx, n))
        .otherwise(F.array(idx))
    )
    pred = F.transform(places, lambda p: F.struct(F.lit("pred").alias("side"), p.alias("place")))
    both = F.concat(F.array(F.struct(F.lit("gold").alias("side"), idx.alias("place"))), pred)
    rows = gold.withColumn("v", F.explode(both)).withColumn("side", F.col("v.side")).withColumn("place", F.col("v.place"))
    is_pred = F.col("side") == "pred"
    swap = is_pred & (kind == 1)
    bump = F.when(is_pred & (kind == 4) & (idx == 0), 1).otherwise(0)
    price = F.col("c2") + bump
    return rows.select(
        "pair_id",
        "side",
        F.col("place").alias("row_idx"),
        F.when(swap, F.col("c1")).otherwise(F.col("c0")).alias("c0"),
        F.when(swap, F.col("c0")).otherwise(F.col("c1")).alias("c1"),
        price.alias("c2"),
        "c3",
        F.col("place").alias("c4"),
        (is_pred & (kind == 5)).alias("has_extra"),
    )


KEYS = ["pair_id", "side", "row_idx"]
COLUMNS = ["c0", "c1", "c2", "c3", "c4"]


def eval_raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cells of both sides; predicted prices arrive as doubles, gold ones as integers."""
    raw = melt(wide_rows(spark, sf_dir), [*KEYS, "has_extra"], COLUMNS)
    raw = raw.filter((F.col("col_idx") < 4) | F.col("has_extra")).drop("has_extra")
    double_price = (F.col("side") == "pred") & (F.col("col_idx") == 2)
    return raw.withColumn("kind", F.when(double_price, "double").otherwise(F.col("kind"))).withColumn(
        "raw", F.when(double_price, F.concat("raw", F.lit(".0"))).otherwise(F.col("raw"))
    )


def eval_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The result rows of both sides and the pairs, both written once."""
    rows = row_form(wide_rows(spark, sf_dir), [*KEYS, "has_extra"], COLUMNS)
    vals = F.when(F.col("has_extra"), F.col("vals")).otherwise(F.slice("vals", 1, 4))
    return stage(rows.select(*KEYS, vals.alias("vals")), "rows"), stage(eval_pairs(spark, sf_dir), "pairs")
