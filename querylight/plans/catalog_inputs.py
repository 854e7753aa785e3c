"""Catalogues derived from the tables: every customer stands for one database with the same layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylight.plans.registry import table
from querylight.session import spread

LAYOUT = {
    "region": "r_regionkey:int r_name:text",
    "nation": "n_nationkey:int n_name:text n_regionkey:int",
    "customer": "c_custkey:bigint c_name:text c_nationkey:int c_acctbal:double c_mktsegment:text",
    "supplier": "s_suppkey:bigint s_name:text s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:text p_brand:text p_type:text p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:text o_totalprice:double o_orderdate:timestamp "
    "o_orderpriority:text",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double "
    "l_extendedprice:double l_discount:double l_tax:double l_returnflag:text l_linestatus:text l_shipdate:timestamp",
    "events": "event_id:bigint ts:timestamp user_id:bigint event_type:text value:double props:text",
    "documents": "doc_id:bigint text:text lang:text source:text n_chars:bigint",
    "embeddings": "vec_id:bigint embedding:vector label:int",
    "pages": "page_id:bigint url:text html:text",
    "benchmark": "item_id:bigint text:text",
    "labels": "doc_id:bigint quality:int toxic:int",
    "conversations": "conv_id:bigint turn:bigint role:text text:text",
}
# Position 0 is the `*` pseudo column, which belongs to no table.
COLUMNS = [(-1, "*", "*", "text")] + [
    (i, tab, *c.split(":")) for i, (tab, text) in enumerate(LAYOUT.items()) for c in text.split()
]
POSITION = {f"{tab}.{col}": i for i, (_, tab, col, _) in enumerate(COLUMNS)}
KEYS = [
    ("orders.o_custkey", "customer.c_custkey"),
    ("lineitem.l_orderkey", "orders.o_orderkey"),
    ("lineitem.l_partkey", "part.p_partkey"),
    ("lineitem.l_suppkey", "supplier.s_suppkey"),
    ("customer.c_nationkey", "nation.n_nationkey"),
    ("supplier.s_nationkey", "nation.n_nationkey"),
    ("nation.n_regionkey", "region.r_regionkey"),
    ("labels.doc_id", "documents.doc_id"),
]
ENUMERATED = {
    "region.r_name": "text", "nation.n_name": "text", "part.p_brand": "text", "orders.o_orderstatus": "text",
    "orders.o_orderpriority": "text", "lineitem.l_returnflag": "text", "customer.c_mktsegment": "text",
    "events.event_type": "text",
}
DESCRIBED = {"r_name": "one of AFRICA, AMERICA, ASIA, EUROPE, MIDDLE EAST", "o_orderstatus": "state F, O or P"}
TABLE_NOTES = {"orders": "customer orders", "lineitem": "lines of an order"}


def column_note(col: str) -> str:
    return DESCRIBED.get(col, col.replace("_", " "))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested form; every odd database has one key that points at the pseudo column."""
    keys = [F.array(F.lit(POSITION[a]), F.lit(POSITION[b])) for a, b in KEYS]
    loose = F.array(F.lit(POSITION["labels.doc_id"]), F.lit(0))
    odd = F.col("c_custkey") % 2 == 1
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(
        F.concat(F.lit("db_"), F.col("c_custkey").cast("string")).alias("db_id"),
        F.array(*[F.lit(t) for t in LAYOUT]).alias("table_names_original"),
        F.array(
            *[F.struct(F.lit(i).alias("table_idx"), F.lit(c).alias("name")) for i, _, c, _ in COLUMNS]
        ).alias("column_names_original"),
        F.array(*[F.lit(t) for *_, t in COLUMNS]).alias("column_types"),
        F.when(odd, F.array(*keys, loose)).otherwise(F.array(*keys)).alias("foreign_keys"),
    )


def with_notes(cols: DataFrame) -> DataFrame:
    """Column and table descriptions added to the flat form."""
    notes = F.create_map(*[F.lit(x) for col, note in DESCRIBED.items() for x in (col, note)])
    tables = F.create_map(*[F.lit(x) for tab, note in TABLE_NOTES.items() for x in (tab, note)])
    return cols.withColumn(
        "description", F.coalesce(notes[F.col("col")], F.replace("col", F.lit("_"), F.lit(" ")))
    ).withColumn("table_description", F.coalesce(tables[F.col("tab")], F.lit("")))


def enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(tab, col, value)`: the distinct values of the enumerated columns, from the whole tables."""
    parts = []
    for name in ENUMERATED:
        tab, col = name.split(".")
        values = table(spark, sf_dir, tab).select(F.col(col).alias("value")).distinct()
        parts.append(values.select(F.lit(tab).alias("tab"), F.lit(col).alias("col"), "value"))
    return reduce(DataFrame.unionByName, parts)


def enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that all databases share, with the description of the enumeration."""
    return enum_values(spark, sf_dir).withColumn("enum_desc", F.concat(F.lit("a code of "), "col"))


# Every other database has no types, every third no descriptions, every fifth an empty table, every seventh no keys.
TYPED, DESCRIBED_DB, EMPTY_TABLE, KEYED = "k % 2 = 0", "k % 3 <> 0", "events", "k % 7 <> 0"
EMPTIED = "k % 5 = 0"
LISTED = ["nation.n_name", "part.p_brand", "customer.c_mktsegment"]


def dict_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(db_id, catalog): the same databases as JSON objects, with optional parts left out here and there."""

    def listed(name: str) -> Column:
        tab, col = name.split(".")
        return table(spark, sf_dir, tab).select(F.sort_array(F.collect_set(col))).scalar()

    def when(rule: str, value: Column) -> Column:
        return F.when(F.expr(rule), value)

    fields = []
    for tab, text in LAYOUT.items():
        columns = [c.split(":") for c in text.split()]
        filled = f"not ({EMPTIED})" if tab == EMPTY_TABLE else "true"
        entries = []
        for name in ENUMERATED:
            if name.startswith(f"{tab}."):
                col = name.split(".")[1]
                whole = F.struct(listed(name).alias("values"), F.lit(f"a code of {col}").alias("desc"))
                entries.append((listed(name) if name in LISTED else whole).alias(col))
        parts = [
            when(filled, F.array(*[F.lit(c) for c, _ in columns])).alias("header"),
            when(f"{filled} and {TYPED}", F.array(*[F.lit(t) for _, t in columns])).alias("type"),
            when(f"{filled} and {DESCRIBED_DB}", F.array(*[F.lit(column_note(c)) for c, _ in columns])).alias("column_description"),
        ]
        if tab in TABLE_NOTES:
            parts.append(F.lit(TABLE_NOTES[tab]).alias("table_description"))
        if entries:
            parts.append(when(filled, F.struct(*entries)).alias("enumerations"))
        fields.append(F.struct(*parts).alias(tab))
    pairs = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in KEYS])
    fields.append(when(KEYED, pairs).alias("foreign_key_map"))
    dbs = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))
    return dbs.select(F.concat(F.lit("db_"), F.col("k").cast("string")).alias("db_id"), F.to_json(F.struct(*fields)).alias("catalog"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


CATALOG_CTE = f"""
layout(tab_idx, tab, col_idx, col, type, description, table_description) as (values {_values([
    (i, tab, POSITION[f"{tab}.{col}"], col, kind, column_note(col), TABLE_NOTES.get(tab, ""))
    for i, tab, col, kind in COLUMNS if i >= 0
])}),
layout_keys(fk_idx, t1, c1, t2, c2) as (values {_values([
    (i, *a.split("."), *b.split(".")) for i, (a, b) in enumerate(KEYS)
])}),
dbs as (select 'db_' || c_custkey as db_id from customer),
cols as (select db_id, layout.* from dbs, layout),
fks as (select db_id, layout_keys.* from dbs, layout_keys),
enum_values as ({" union all ".join(
    f"select distinct '{n.split('.')[0]}' as tab, '{n.split('.')[1]}' as col, {n.split('.')[1]} as value "
    f"from {n.split('.')[0]}" for n in ENUMERATED
)}),
plain_tables as (select db_id, tab_idx, '# Table: ' || tab || chr(10) || '[' || chr(10)
    || string_agg('  (' || col || ':' || type || '),' || chr(10), '' order by col_idx) || ']' || chr(10) as text
  from cols group by db_id, tab_idx, tab),
plain_schema as (select db_id, '【DB_ID】 ' || db_id || chr(10) || '【Schema】' || chr(10) || t || chr(10)
    || '【Foreign keys】' || chr(10) || k as schema_text
  from (select db_id, string_agg(text, '' order by tab_idx) as t from plain_tables group by db_id)
  join (select db_id, string_agg(t1 || '.' || c1 || '=' || t2 || '.' || c2 || chr(10), '' order by fk_idx) as k
        from fks group by db_id) using (db_id))"""


ENUMS_CTE = "enums as (select db_id, tab, col, value from cols join enum_values using (tab, col))"
DICT_CTE = f"""
dict_dbs as (select 'db_' || c_custkey as db_id, c_custkey as k from customer),
dict_cols as (select db_id, k, tab_idx, tab, col_idx - first_idx as col_idx, col,
    case when {TYPED} then type end as type, case when {DESCRIBED_DB} then description end as description, table_description
  from dict_dbs, (select *, min(col_idx) over (partition by tab) as first_idx from layout)
  where not (tab = '{EMPTY_TABLE}' and {EMPTIED})),
dict_fks as (select db_id, layout_keys.* from dict_dbs, layout_keys where {KEYED}),
dict_enums as (select db_id, tab, col, value,
    case when tab || '.' || col not in ({", ".join(f"'{n}'" for n in LISTED)}) then 'a code of ' || col end as enum_desc
  from dict_cols join enum_values using (tab, col))"""


def examples_cte(least: int, most: int, source: str = "enum_values", key: str = "tab, col", name: str = "examples") -> str:
    mark = " || '|' || ".join(key.split(", "))
    return f"""
{name}_ranked as (select {key}, value, row_number() over (partition by {key}
    order by md5('0|' || {mark} || '|' || value), value) as rn from {source}),
{name} as (select {key}, '[' || string_agg('''' || value || '''', ', ' order by rn) || ']' as examples
  from {name}_ranked where rn <= {least} + cast('0x' || substr(md5('0|' || {mark}), 1, 8) as bigint)
    % {most - least + 1}
  group by {key})"""
