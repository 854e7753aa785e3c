"""Query-text expressions, prompts and chat texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylight.functions import sqltext
from querylight.functions.strings import canonical_db_name
from querylight.operators import prompts
from querylight.operators.linking import schema_link
from querylight.plans.catalog_inputs import CATALOG_CTE
from querylight.plans.catalog_queries import flat, plain_schema
from querylight.plans.example_inputs import ANSWER, EXAMPLE_CTE, VARIANT, examples
from querylight.plans.registry import query, table
from querylight.session import stage

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def quoted(text: str) -> str:
    """A DuckDB string expression for a text with line ends."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


@query(
    "sql_extract_fence",
    f"""with {EXAMPLE_CTE}, a as (select id, {ANSWER} as answer from examples)
    select id, coalesce({STRIP.format("regexp_extract_all(answer, '(?s)```sql(.*?)```', 1)[-1]")}, answer) as sql
    from a""",
)
def sql_extract_fence(spark, sf_dir):
    answers = examples(spark, sf_dir).selectExpr("id", f"{ANSWER} as answer")
    return answers.select("id", sqltext.last_fence(F.col("answer")).alias("sql"))


@query(
    "sql_has_keywords",
    rf"with {EXAMPLE_CTE} select id, regexp_matches(sql, '(?i)\b(JOIN|GROUP BY|WHERE)\b') as has_keywords from examples",
)
def sql_has_keywords(spark, sf_dir):
    return examples(spark, sf_dir).select("id", sqltext.has_keywords(F.col("sql")).alias("has_keywords"))


@query(
    "sql_add_limit",
    rf"""with {EXAMPLE_CTE}, b as (select id, regexp_replace(sql, '[ ;\t\n\r]+$', '') as sql from examples)
    select id, sql || case when regexp_matches(sql, '(?i)\bLIMIT\b\s*\d+') then ';' else ' LIMIT 10;' end as limited
    from b""",
)
def sql_add_limit(spark, sf_dir):
    return examples(spark, sf_dir).select("id", sqltext.add_limit(F.col("sql"), 10).alias("limited"))


@query(
    "sql_terminate",
    f"""with {EXAMPLE_CTE} select id, case when {STRIP.format("sql")} like '%;' then sql else sql || ';' end as ended
    from examples""",
)
def sql_terminate(spark, sf_dir):
    return examples(spark, sf_dir).select("id", sqltext.terminate(F.col("sql")).alias("ended"))


@query(
    "sql_schema_link",
    rf"""with {CATALOG_CTE}, {EXAMPLE_CTE},
    tokens as (select distinct id, db_id, lower(unnest(regexp_extract_all(sql, '[A-Za-z_]\w*'))) as name from examples),
    names as (select db_id, 'table' as kind, lower(tab) as name from cols
              union select db_id, 'column', lower(col) from cols)
    select id, kind, name from tokens join names using (db_id, name)""",
)
def sql_schema_link(spark, sf_dir):
    return schema_link(examples(spark, sf_dir), flat(spark, sf_dir))


def _normal(column: str) -> str:
    """DuckDB form of the normal text of a query."""
    bare = rf"regexp_replace({column}, '(''[^'']*'')|--[^\n]*|/\*[\s\S]*?\*/', '\1', 'g')"
    plain = r"regexp_replace(replace(replace(lower(x), '`', ''), chr(34), ''), '\s+', ' ', 'g')"
    pieces = f"regexp_extract_all({bare}, '''[^'']*''|[^'']+|''')"
    tidy = f"list_transform({pieces}, lambda x: case when starts_with(x, '''') then x else {plain} end)"
    return rf"regexp_replace(array_to_string({tidy}, ''), '^\s+|[\s;]+$', '', 'g')"


@query(
    "sql_exact_match",
    f"""with {EXAMPLE_CTE},
    written as (select id, sql_type, sql as g, {VARIANT} as p from examples),
    compared as (select sql_type, {_normal("g")} = {_normal("p")} as same from written)
    select sql_type, count(*) as n, count(*) filter (same) as n_exact,
      round(100 * round(count(*) filter (same) / count(*), 5), 3) as exact_match from compared group by sql_type""",
)
def sql_exact_match(spark, sf_dir):
    both = examples(spark, sf_dir).selectExpr("sql_type", "sql as g", f"{VARIANT} as p")
    exact = sqltext.normal_text(F.col("g")) == sqltext.normal_text(F.col("p"))
    counts = both.groupBy("sql_type").agg(F.count("*").alias("n"), F.count_if(exact).alias("n_exact"))
    return counts.withColumn("exact_match", F.round(100 * F.round(F.col("n_exact") / F.col("n"), 5), 3))


@query(
    "db_name_canonical",
    f"""with {EXAMPLE_CTE}, n as (select id, case cast(id % 3 as int) when 0 then 'sql_eval_' || db_id when 1 then db_id
        else 'sql_eval_sql_eval_' || db_id end as name from examples)
    select id, 'sql_eval_' || string_split(name, 'sql_eval_')[-1] as db_name from n""",
)
def db_name_canonical(spark, sf_dir):
    named = examples(spark, sf_dir).selectExpr(
        "id",
        """case cast(id % 3 as int) when 0 then 'sql_eval_' || db_id when 1 then db_id
        else 'sql_eval_sql_eval_' || db_id end as name""",
    )
    return named.select("id", canonical_db_name(F.col("name")).alias("db_name"))


# Dialects beyond the five base ones, some in upper case.
TYPED = """case cast(id % 11 as int) when 0 then 'PG2NL' when 1 then 'common' when 2 then 'Oracle' when 3 then upper(sql_type)
    else sql_type end"""


def _filled(template: str) -> str:
    fields = {
        "question": "coalesce(nullif(rewrite, ''), question)",
        "db_schema": STRIP.format("schema_text"),
        "evidence": "evidence",
        "sql": "sql",
        "qnum": "cast(qnum as varchar)",
        "instructions": "''",
        "create_table_statements": "''",
    }
    return " || ".join(fields[p] if is_field else quoted(p) for is_field, p in prompts.template_parts(template))


RENDERED_CTE = f"""{CATALOG_CTE}, {EXAMPLE_CTE},
    typed as (select * exclude (sql_type), lower({TYPED}) as sql_type from examples join plain_schema using (db_id)),
    rendered as (select *, case sql_type
        {" ".join(f"when '{name}' then {_filled(t)}" for name, t in prompts.TEMPLATES.items())}
        else {_filled(prompts.FALLBACK_TEMPLATE)} end as prompt from typed)"""


def rendered(spark, sf_dir):
    given = examples(spark, sf_dir).withColumn("sql_type", F.expr(TYPED))
    return prompts.render(prompts.join_schema(given, plain_schema(spark, sf_dir)))


@query("prompt_render", f"with {RENDERED_CTE} select id, sql_type, prompt from rendered")
def prompt_render(spark, sf_dir):
    return rendered(spark, sf_dir).select("id", "sql_type", "prompt")


@query(
    "prompt_conversation",
    f"""with {RENDERED_CTE}
    select id, db_id as db_name, sql_type, 0 as turn, 'user' as role, prompt as content from rendered union all
    select id, db_id, sql_type, 1, 'assistant', case sql_type when 'pg2nl' then question else sql end from rendered""",
)
def prompt_conversation(spark, sf_dir):
    rows = prompts.conversation(rendered(spark, sf_dir))
    return rows.select("id", "db_name", "sql_type", F.posexplode("conversations").alias("turn", "m")).select(
        "id", "db_name", "sql_type", "turn", "m.*"
    )


@query(
    "prompt_join_schema",
    f"""with {CATALOG_CTE}, {EXAMPLE_CTE}
    select id, db_id, coalesce(schema_text, '') as db_schema, schema_text is null as orphan
    from examples left join plain_schema using (db_id)""",
)
def prompt_join_schema(spark, sf_dir):
    given = examples(spark, sf_dir).select("id", "db_id")
    schemas = stage(plain_schema(spark, sf_dir), "schema")
    found = prompts.join_schema(given, schemas).withColumn("orphan", F.lit(False))
    lost = prompts.orphans(given, schemas).select("id", "db_id", F.lit("").alias("db_schema"), F.lit(True).alias("orphan"))
    return found.select("id", "db_id", "db_schema", "orphan").unionByName(lost)


TURN = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>'"
SYSTEM = "'<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10)"


@query(
    "chat_drop_first",
    """select conv_id, row_number() over (partition by conv_id order by turn) - 2 as pos, role, text as content
    from conversations qualify pos >= 0""",
)
def chat_drop_first(spark, sf_dir):
    lists = prompts.gather_turns(table(spark, sf_dir, "conversations"))
    kept = lists.select("conv_id", F.posexplode(prompts.drop_first(F.col("messages"))).alias("pos", "m"))
    return kept.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "m.*")


@query(
    "chat_template",
    f"""select conv_id, case when arg_min(role, turn) = 'system' then '' else {SYSTEM} end
      || string_agg({TURN}, chr(10) order by turn) as chat from conversations group by conv_id""",
)
def chat_template(spark, sf_dir):
    lists = prompts.gather_turns(table(spark, sf_dir, "conversations"))
    return lists.select("conv_id", prompts.chat_text(F.col("messages")).alias("chat"))


@query(
    "chat_prompt_only",
    f"""select conv_id, case when role = 'system' then '' else {SYSTEM} end || {TURN}
      || chr(10) || '<|im_start|>assistant' || chr(10) as chat
    from conversations qualify row_number() over (partition by conv_id order by turn) = 1""",
)
def chat_prompt_only(spark, sf_dir):
    """The first turn alone is a minimum per conversation, so the other turns are never gathered."""
    first = F.min_by(F.struct("role", F.col("text").alias("content")), "turn")
    opened = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(first.alias("m"))
    return opened.select("conv_id", prompts.chat_text(F.array("m"), generation_prompt=True).alias("chat"))
