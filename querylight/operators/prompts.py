"""Prompts, conversations and chat texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylight.functions.strings import strip_blank
from querylight.session import by_merge

# The prompt wording per query dialect.
TEMPLATES = {
    "mysql": """你是一名MySQL专家，现在需要阅读并理解下面的【数据库schema】描述，以及可能用到的【参考信息】，并运用MySQL知识生成sql语句回答【用户问题】。
【用户问题】
{question}

【数据库schema】
{db_schema}

【参考信息】
{evidence}

【用户问题】
{question}

```sql""",
    "postgresql": """你是一名PostgreSQL专家，现在需要阅读并理解下面的【数据库schema】描述，以及可能用到的【参考信息】，并运用PostgreSQL知识生成sql语句回答【用户问题】。
【用户问题】
{question}

【数据库schema】
{db_schema}

【参考信息】
{evidence}

【用户问题】
{question}

```sql""",
    "common": """你是一名数据库语言专家，现在需要阅读并理解下面的【数据库schema】描述，可能用到的【参考信息】，并运用数据库知识生成sql语句回答【用户问题】。
【用户问题】
{question}

【数据库schema】
{db_schema}

【参考信息】
{evidence}

【用户问题】
{question}

```sql""",
    "pg2nl": """你是一名PostgreSQL专家，现在有一条【SQL】语句，是基于下面的【数据库schema】描述，以及可能用到的【参考信息】来生成回复【用户问题】的，现在请你根据【SQL】语句，推断出{qnum}条可能询问的【用户问题】。
【SQL】
{sql}

【数据库schema】
{db_schema}

【参考信息】
{evidence}

【SQL】
{sql}

【用户问题】""",
    "cypher": """你是一名Neo4j专家，现在需要阅读并理解下面的【图数据库schema】描述，以及可能用到的【参考信息】，并运用Cypher知识生成Cypher Query语句回答【用户问题】。
【用户问题】
{question}

【图数据库schema】
{db_schema}

【参考信息】
{evidence}

【用户问题】
{question}

```cypher""",
    "ngql": """你是一名NebulaGraph专家，现在需要阅读并理解下面的【图数据库schema】描述，以及可能用到的【参考信息】，并运用nGQL知识生成Graph Query语句回答【用户问题】。
【用户问题】
{question}

【图数据库schema】
{db_schema}

【参考信息】
{evidence}

【用户问题】
{question}

```ngql""",
    "sqlite": """你是一名SQLite专家，现在需要阅读并理解下面的【数据库schema】描述，以及可能用到的【参考信息】，并运用SQLite知识生成sql语句回答【用户问题】。
【用户问题】
{question}

【数据库schema】
{db_schema}

【参考信息】
{evidence}

【用户问题】
{question}

```sql""",
}
FALLBACK_TEMPLATE = """<|begin_of_text|><|start_header_id|>user<|end_header_id|>

Generate a SQL query to answer this question: `{question}`
{instructions}

DDL statements:
{create_table_statements}<|eot_id|><|start_header_id|>assistant<|end_header_id|>

The following SQL query best answers the question `{question}`:
```sql

"""

# The chat markup.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
DEFAULT_SYSTEM = f"{TURN_START}system\nYou are a helpful assistant.{TURN_END}\n"
GENERATION_PROMPT = f"\n{TURN_START}assistant\n"


def template_parts(template: str) -> list[tuple[bool, str]]:
    """A template as literal texts (False) and field names (True), in order."""
    parts = re.split(r"\{(\w+)\}", template)
    return [(i % 2 == 1, p) for i, p in enumerate(parts) if p]


def _fill(template: str, fields: dict[str, Column]) -> Column:
    return F.concat(*[fields[p] if is_field else F.lit(p) for is_field, p in template_parts(template)])


def join_schema(examples: DataFrame, schemas: DataFrame) -> DataFrame:
    """Examples with the schema text of their database; examples of unknown databases drop out."""
    return examples.join(by_merge(schemas.withColumnRenamed("schema_text", "db_schema")), "db_id")


def orphans(examples: DataFrame, schemas: DataFrame) -> DataFrame:
    """Examples whose database has no schema text."""
    return examples.join(by_merge(schemas), "db_id", "left_anti")


def render(examples: DataFrame) -> DataFrame:
    """Add `prompt`, with the dialect in lower case; a rewrite wins over the question.

    Fields go between the literal parts of the template, so braces in the data stay as they are; a
    null field is an empty text.
    """
    question = F.coalesce(F.nullif(F.col("rewrite"), F.lit("")), F.col("question"))
    fields = {
        "question": F.coalesce(question, F.lit("")),
        "db_schema": F.coalesce(strip_blank(F.col("db_schema")), F.lit("")),
        "evidence": F.coalesce("evidence", F.lit("")),
        "sql": F.coalesce("sql", F.lit("")),
        "qnum": F.coalesce(F.col("qnum").cast("string"), F.lit("")),
        "instructions": F.lit(""),
        "create_table_statements": F.lit(""),
    }
    dialect = F.lower("sql_type")
    prompt = None
    for name, template in TEMPLATES.items():
        filled = _fill(template, fields)
        prompt = F.when(dialect == name, filled) if prompt is None else prompt.when(dialect == name, filled)
    return examples.withColumn("prompt", prompt.otherwise(_fill(FALLBACK_TEMPLATE, fields))).withColumn(
        "sql_type", dialect
    )


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.col(content) if isinstance(content, str) else content).alias("content"))


def conversation(rendered: DataFrame) -> DataFrame:
    """Training rows `(id, conversations, sql_type, db_name)`: prompt, then query (or question for pg2nl)."""
    answer = F.when(F.col("sql_type") == "pg2nl", F.col("question")).otherwise(F.col("sql"))
    return rendered.select(
        "id",
        F.array(message("user", "prompt"), message("assistant", answer)).alias("conversations"),
        "sql_type",
        F.col("db_id").alias("db_name"),
    )


def gather_turns(turns: DataFrame) -> DataFrame:
    """`(conv_id, turn, role, text)` to one message list per conversation."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")
    )


def drop_first(messages: Column) -> Column:
    return F.slice(messages, F.lit(2), F.size(messages))


def first_only(messages: Column) -> Column:
    return F.slice(messages, 1, 1)


def chat_text(messages: Column, generation_prompt: bool = False) -> Column:
    """Messages in chat markup; a default system message leads unless the first turn is one. A null
    role or content is an empty text."""
    empty = F.lit("")
    turns = F.transform(
        messages,
        lambda m: F.concat(
            F.lit(TURN_START), F.coalesce(m["role"], empty), F.lit("\n"), F.coalesce(m["content"], empty), F.lit(TURN_END)
        ),
    )
    lead = F.when(F.get(messages, F.lit(0))["role"] == "system", "").otherwise(DEFAULT_SYSTEM)
    tail = GENERATION_PROMPT if generation_prompt else ""
    return F.concat(lead, F.array_join(turns, "\n"), F.lit(tail))
