"""Catalogue flattening, schema texts, parsing, foreign keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylight.operators import catalog as ops
from querylight.operators import catalog_dict
from querylight.plans.catalog_inputs import CATALOG_CTE, DICT_CTE, ENUMS_CTE, catalog, dict_catalogs, enums, examples_cte, with_notes
from querylight.plans.registry import query
from querylight.session import by_merge, stage

DB_TEXT = """'【DB_ID】 ' || db_id || chr(10) || '【Schema】' || chr(10) || t || chr(10)
    || '【Foreign keys】' || chr(10) || k as schema_text"""


def assembled(line: str, header: str, key_line: str) -> str:
    return f"""
    tables as (select db_id, tab_idx, '# Table: ' || {header} || chr(10) || '[' || chr(10)
        || string_agg({line}, ',' || chr(10) order by col_idx) || chr(10) || ']' as text
      from lines group by db_id, tab_idx, tab, table_description)
    select db_id, {DB_TEXT}
    from (select db_id, string_agg(text, chr(10) order by tab_idx) as t from tables group by db_id)
    join (select db_id, string_agg({key_line}, chr(10) order by fk_idx) as k from fks group by db_id) using (db_id)"""


TICKED = "t1 || '.`' || c1 || '` = ' || t2 || '.`' || c2 || '`'"
BARE = "t1 || '.' || c1 || ' = ' || t2 || '.' || c2"


def flat(spark, sf_dir):
    return ops.flatten(catalog(spark, sf_dir))


def keys(spark, sf_dir):
    return ops.resolve_fks(catalog(spark, sf_dir))


def plain_schema(spark, sf_dir):
    return ops.schema_text(flat(spark, sf_dir), keys(spark, sf_dir))


@query("cat_flatten", f"with {CATALOG_CTE} select db_id, tab_idx, tab, col_idx, col, type from cols")
def cat_flatten(spark, sf_dir):
    return flat(spark, sf_dir)


@query("cat_fk_resolve", f"with {CATALOG_CTE} select db_id, fk_idx, t1, c1, t2, c2 from fks")
def cat_fk_resolve(spark, sf_dir):
    return keys(spark, sf_dir)


@query("cat_schema_text", f"with {CATALOG_CTE} select db_id, schema_text from plain_schema")
def cat_schema_text(spark, sf_dir):
    return plain_schema(spark, sf_dir)


@query(
    "cat_schema_text_rich",
    f"""with {CATALOG_CTE}, {ENUMS_CTE}, {examples_cte(2, 8, "enums", "db_id, tab, col")},
    named as (select db_id, tab, col, bool_and(contains(description, value)) as all_named
              from enums join cols using (db_id, tab, col) group by all),
    lines as (
      select cols.*, '  (' || col || ':' || type || ', ' || description
          || case when all_named = false then ', a code of ' || col else '' end || '.'
          || coalesce(' Value examples: ' || examples || '.', '') || ')' as line
      from cols left join named using (db_id, tab, col) left join examples using (db_id, tab, col)),
    {assembled("line", "tab || case when table_description <> '' then ', ' || table_description else '' end", TICKED)}""",
)
def cat_schema_text_rich(spark, sf_dir):
    cols = with_notes(flat(spark, sf_dir))
    return ops.schema_text_rich(cols, keys(spark, sf_dir), enums(spark, sf_dir))


@query(
    "cat_schema_text_names",
    f"""with {CATALOG_CTE}, {ENUMS_CTE}, {examples_cte(1, 8, "enums", "db_id, tab, col")},
    known as (select cols.*, examples from cols left join examples using (db_id, tab, col)),
    lines as (select *, '  (' || col || coalesce(', Value examples: ' || examples || '.', '') || ')' as line from known),
    names_only as ({assembled("line", "tab", TICKED).replace("tables as", "with tables as", 1)}),
    lines2 as (select *, '  (' || col || ', ' || col || '.' || coalesce(' Value examples: ' || examples || '.', '')
        || ')' as line from known),
    described as ({assembled("line", "tab", TICKED).replace("tables as", "with tables as", 1).replace("lines", "lines2")})
    select 'names' as style, * from names_only union all select 'described', * from described""",
)
def cat_schema_text_names(spark, sf_dir):
    cols, fks = flat(spark, sf_dir), keys(spark, sf_dir)
    values = stage(enums(spark, sf_dir), "enums")
    names = ops.schema_text_names(cols, fks, values)
    described = ops.schema_text_names(cols, fks, values, describe=True)
    both = F.array(
        F.struct(F.lit("names").alias("style"), "schema_text"),
        F.struct(F.lit("described").alias("style"), F.col("described_text").alias("schema_text")),
    )
    joined = names.join(by_merge(described.withColumnRenamed("schema_text", "described_text")), "db_id")
    return joined.select("db_id", F.explode(both).alias("b")).select("db_id", "b.*")


@query(
    "cat_value_examples",
    f"""with {CATALOG_CTE}, {ENUMS_CTE}, {examples_cte(2, 8, "enums", "db_id, tab, col")}
    select db_id, tab, col, examples from examples""",
)
def cat_value_examples(spark, sf_dir):
    listed = ops.with_lists(flat(spark, sf_dir), enums(spark, sf_dir))
    return listed.select("db_id", "tab", "col", ops.list_examples(F.col("values")).alias("examples")).filter("examples is not null")


@query(
    "cat_schema_parse",
    f"""with {CATALOG_CTE}
    select db_id, tab as table_name, col_idx - min(col_idx) over (partition by db_id, tab) as col_idx, col,
      '(' || col || ':' || type || ')' as line from cols
    union all
    select db_id, '(key)', fk_idx, t1 || '.' || c1, t2 || '.' || c2 from fks""",
)
def cat_schema_parse(spark, sf_dir):
    texts = stage(plain_schema(spark, sf_dir), "schema")
    columns = ops.parse_columns(texts).select(
        "db_id", F.col("tab").alias("table_name"), F.col("col_idx").cast("bigint").alias("col_idx"), "col", "line"
    )
    fks = ops.parse_fks(texts).select(
        "db_id",
        F.lit("(key)").alias("table_name"),
        F.col("fk_idx").cast("bigint").alias("col_idx"),
        F.concat("t1", F.lit("."), "c1").alias("col"),
        F.concat("t2", F.lit("."), "c2").alias("line"),
    )
    return columns.unionByName(fks)


@query(
    "cat_schema_rerender",
    f"""with {CATALOG_CTE},
    lines as (select *, '  (' || col || ':' || type || ')' as line from cols where tab <> 'pages' and not starts_with(col, 'l_')),
    {assembled("line", "tab", BARE)}""",
)
def cat_schema_rerender(spark, sf_dir):
    texts = stage(plain_schema(spark, sf_dir), "schema")
    kept = ops.parse_columns(texts).filter("tab <> 'pages' and not startswith(col, 'l_')")
    return ops.rerender(kept, ops.parse_fks(texts))


@query(
    "cat_fk_normalise",
    f"""with {CATALOG_CTE},
    lines as (select *, '  (' || col || ')' as line from cols),
    {assembled("line", "tab", BARE)}""",
)
def cat_fk_normalise(spark, sf_dir):
    texts = ops.schema_text_names(flat(spark, sf_dir), keys(spark, sf_dir), None)
    return texts.select("db_id", ops.normalise_fk_section(F.col("schema_text")).alias("schema_text"))


@query(
    "cat_fk_filter",
    f"""with {CATALOG_CTE} select db_id, fk_idx, t1, c1, t2, c2 from fks
    where t1 <> 'supplier' and t2 <> 'supplier'""",
)
def cat_fk_filter(spark, sf_dir):
    given = flat(spark, sf_dir).filter("tab <> 'supplier'")
    return ops.filter_fks(keys(spark, sf_dir), given).select("db_id", "fk_idx", "t1", "c1", "t2", "c2")


@query(
    "cat_flatten_dict",
    f"""with {CATALOG_CTE}, {DICT_CTE},
    listed as (select db_id, tab, col, count(*) as n_values, any_value(enum_desc) as enum_desc,
        string_agg(value, '|' order by value) as enum_text from dict_enums group by db_id, tab, col)
    select db_id, tab_idx, tab, col_idx, col, type, description, table_description, coalesce(n_values, 0) as n_values, enum_desc, enum_text
    from dict_cols left join listed using (db_id, tab, col)
    union all select db_id, -1, t1, fk_idx, c1, t2, c2, '', 0, null, null from dict_fks""",
)
def cat_flatten_dict(spark, sf_dir):
    """Columns with their enumerations, and the keys as rows of their own."""
    rows = catalog_dict.flatten_all(dict_catalogs(spark, sf_dir))
    return rows.select(
        "db_id", "tab_idx", "tab", "col_idx", "col", "type", "description", "table_description", "n_values", "enum_desc", "enum_text"
    )


@query(
    "cat_schema_text_dict",
    f"""with {CATALOG_CTE}, {DICT_CTE}, {examples_cte(2, 8, "dict_enums", "db_id, tab, col")},
    named as (select db_id, tab, col, bool_and(contains(description, value)) as all_named, any_value(enum_desc) as enum_desc
              from dict_enums join dict_cols using (db_id, tab, col) group by all),
    lines as (
      select c.*, '  (' || col || coalesce(':' || type, '') || ',' || coalesce(' ' || description
          || case when all_named = false and enum_desc is not null then ', ' || enum_desc else '' end || '.', '')
          || coalesce(' Value examples: ' || examples || '.', '') || ')' as line
      from dict_cols c left join named using (db_id, tab, col) left join examples using (db_id, tab, col)),
    tables as (select db_id, tab_idx, '# Table: ' || tab || case when table_description <> '' then ', ' || table_description else '' end
        || chr(10) || '[' || chr(10) || string_agg(line, ',' || chr(10) order by col_idx) || chr(10) || ']' as text
      from lines group by db_id, tab_idx, tab, table_description)
    select db_id, {DB_TEXT.replace("|| k as", "|| coalesce(k, '') as")}
    from (select db_id, string_agg(text, chr(10) order by tab_idx) as t from tables group by db_id)
    left join (select db_id, string_agg({TICKED}, chr(10) order by fk_idx) as k from dict_fks group by db_id) using (db_id)""",
)
def cat_schema_text_dict(spark, sf_dir):
    given = stage(catalog_dict.layout(dict_catalogs(spark, sf_dir)), "layout")
    return ops.schema_text_rich(catalog_dict.flatten_dict(given), catalog_dict.foreign_keys(given), catalog_dict.enum_lists(given))
