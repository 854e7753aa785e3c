"""Questions, queries and model answers derived from `documents`: one example per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querylight.plans.eval_inputs import SQL_TYPE
from querylight.plans.registry import table

EXAMPLE_COLUMNS = {
    "id": "doc_id",
    "db_id": "'db_' || cast(cast(floor(doc_id * 1.6) as bigint) as varchar(20))",
    "sql_type": SQL_TYPE.format(key="doc_id"),
    "question": "text",
    "rewrite": "case when doc_id % 7 = 0 then 'Q: ' || text when doc_id % 7 = 1 then '' end",
    "evidence": "source",
    "qnum": "cast(doc_id % 3 + 1 as int)",
    "sql": """case cast(doc_id % 6 as int)
        when 0 then 'select count(*) from orders where o_orderkey > ' || cast(doc_id as varchar(20))
        when 1 then 'select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey'
        when 2 then 'select p_name from part where p_size > 10 and p_brand = ''Brand#' || cast(doc_id % 25 as varchar(20)) || ''''
        when 3 then 'SELECT n_name, count(*) FROM nation GROUP BY n_name;'
        when 4 then 'select l_orderkey from lineitem limit 5'
        else 'select * from events ; ' end""",
}
EXAMPLE_SELECT = ", ".join(f"{sql} as {name}" for name, sql in EXAMPLE_COLUMNS.items())

# A model's answer around the query: prose and a fence, two fences, no fence, an unclosed fence.
ANSWER = """case cast(id % 4 as int)
    when 0 then 'Here is the query:' || chr(10) || '```sql' || chr(10) || sql || chr(10) || '```' || chr(10) || 'Done.'
    when 1 then '```sql' || chr(10) || 'select 1' || chr(10) || '``` or better ```sql' || chr(10) || sql || '```'
    when 2 then sql
    else '```sql' || chr(10) || sql end"""

# A second writing of the query; the last variant is a different query.
VARIANT = """case cast(id % 5 as int)
    when 0 then sql
    when 1 then replace(sql, ' ', '  ')
    when 2 then '/* try */ ' || replace(sql, 'select', 'SELECT') || ' ;'
    when 3 then replace(sql, 'orders', '`orders`') || ' -- end'
    else replace(sql, 'from', 'frm') end"""

EXAMPLE_CTE = f"examples as (select {EXAMPLE_SELECT} from documents)"


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        *[f"{sql} as {name}" for name, sql in EXAMPLE_COLUMNS.items()]
    )
