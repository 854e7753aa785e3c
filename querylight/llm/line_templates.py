"""Line dedup by a log-template tree.

A line is split at ASCII blanks and tokens with a digit become `<*>`. The tree has a fixed depth: the
token count, then `LEAD` leading tokens, then the leaf's templates. Inside a leaf

- a line that occurs in at least `min_docs` documents is a template of its own, if any token of it
  is not `<*>`;
- the other lines are generalised: a token stays where the lines of the leaf that hold it at that
  place come from `min_docs` documents or more, and every other token behind the leading ones
  becomes `<*>`. Lines that agree after that share a template, which recurs when its lines come from
  `min_docs` documents and at least `similarity` of its tokens stay. A document counts once for a
  token or template, however many of its lines hold it.

A recurring template is dropped from all documents but the first (smallest id) that holds it, so a
passage that many documents share survives once. Repetition inside one document is left alone.

Results for odd input: null texts stay null and have no lines; blank lines are never dropped; a null
id counts as the largest id, and rows of one id as one document; documents keep their rows even when
every line goes (the text is then empty). Ties cannot arise, as the keeper is the smallest id. A text or
line of any length is one row of words in its task and is read whole. Lines compare by two 64-bit hashes, of leaf and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylight.llm.common import same_row, small, text_or_empty, with_row_key
from querylight.llm.registry import query, table
from querylight.session import scratch, stage

MIN_DOCS = 5
LEAD = 2
SIMILARITY = 0.8
BLANKS = r"[\x09-\x0D\x20]+"
FIELD = "<*>"


def tidy(line: Column) -> Column:
    """The line with single blanks and its variable tokens as `<*>`."""
    uneven = line.rlike(r"[\x09-\x0D]|  ")
    plain = F.trim(F.when(uneven, F.regexp_replace(line, BLANKS, " ")).otherwise(line))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"[^ 0-9]*[0-9][^ ]*", FIELD)).otherwise(plain)


def tree_lines(keyed: DataFrame, lead: int) -> DataFrame:
    """(id, h, doc, line_no, norm, leaf, line, has_fixed): every line and its leaf; blank lines have none."""
    lines = keyed.filter(F.col("text").isNotNull()).select("id", "h", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    parts = lines.select("id", "h", "line_no", tidy(F.col("raw")).alias("norm"))
    head = F.substring_index("norm", " ", lead)
    count = F.octet_length("norm") - F.octet_length(F.translate("norm", " ", "")) + 1
    return parts.select(
        "id",
        "h",
        F.coalesce(F.col("id").cast("long"), F.lit(2**63 - 1)).alias("doc"),
        "line_no",
        "norm",
        F.when(F.col("norm") != "", F.xxhash64(count, head)).alias("leaf"),
        F.xxhash64(F.lit(1), "norm").alias("line"),
        (F.translate(F.replace("norm", F.lit(FIELD), F.lit("")), " ", "") != "").alias("has_fixed"),
    )


def keepers(keyed: DataFrame, lines: DataFrame, min_docs: int, lead: int, similarity: float) -> DataFrame:
    """(leaf, line, keeper): the lines of recurring templates and the one document that keeps each."""
    classes = stage(
        lines.filter(F.col("leaf").isNotNull())
        .groupBy("leaf", "line", "doc")
        .agg(F.first("has_fixed").alias("has_fixed"))
        .groupBy("leaf", "line")
        .agg(F.count("*").alias("docs"), F.min("doc").alias("keeper"), F.first("has_fixed").alias("has_fixed")),
        "line_classes",
    )
    whole = classes.filter((F.col("docs") >= min_docs) & F.col("has_fixed")).select("leaf", "line", "keeper")
    rest = classes.filter(F.col("docs") < min_docs)
    leaves = rest.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count("*").alias("leaf_lines"))
    leaves = leaves.filter((F.col("leaf_docs") >= min_docs) & (F.col("leaf_lines") > 1)).select("leaf")
    rest = stage(rest.join(leaves, "leaf").select("leaf", "line", "keeper"), "leaf_lines")

    # Only documents that hold such a line are read again.
    rest = small(rest, rest.count(), 32)
    holders = lines.join(rest, ["leaf", "line"]).select(F.col("id").alias("i2"), F.col("h").alias("h2")).distinct()
    holders = stage(holders, "holders")
    found = F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))
    again = keyed.join(small(holders, holders.count(), 32), found, "left_semi")
    said = tree_lines(again, lead).select("leaf", "line", "norm", "doc").join(rest, ["leaf", "line"]).groupBy("leaf", "line")
    # Such a line has fewer than `min_docs` documents, so they fit its row.
    said = said.agg(F.collect_set("doc").alias("docs"), F.first("keeper").alias("keeper"), F.first("norm").alias("norm"))
    said = stage(said, "leaf_texts")
    tokens = said.select("leaf", "line", "docs", F.posexplode(F.split("norm", " ")).alias("place", "token"))
    tokens = tokens.filter((F.col("place") >= lead) & (F.col("token") != FIELD))
    held = tokens.select("leaf", "place", "token", F.explode("docs").alias("doc")).distinct()
    fixed = held.groupBy("leaf", "place", "token").agg(F.count("*").alias("token_docs"))
    fixed = fixed.filter(F.col("token_docs") >= min_docs).drop("token_docs")
    stays = (
        tokens.join(fixed, ["leaf", "place", "token"])
        .groupBy("leaf", "line")
        .agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("stays"))
    )
    none = F.array().cast("array<struct<place:int,token:string>>")
    size = F.size(F.split("norm", " "))
    shaped = said.join(stays, ["leaf", "line"], "left").select(
        "leaf",
        "line",
        "docs",
        "keeper",
        F.coalesce("stays", none).alias("stays"),
        size.alias("n"),
        F.size(F.filter(F.slice(F.split("norm", " "), 1, lead), lambda t: t != FIELD)).alias("lead_fixed"),
    )
    shaped = shaped.withColumn("template", F.xxhash64("stays"))
    close = (F.size("stays") + F.col("lead_fixed")) >= F.col("n") * similarity
    recurring = (
        shaped.filter(close)
        .select("leaf", "template", "keeper", F.explode("docs").alias("doc"))
        .groupBy("leaf", "template", "doc")
        .agg(F.min("keeper").alias("keeper"))
        .groupBy("leaf", "template")
        .agg(F.count("*").alias("t_docs"), F.min("keeper").alias("t_keeper"))
        .filter(F.col("t_docs") >= min_docs)
    )
    general = shaped.join(recurring, ["leaf", "template"]).select("leaf", "line", F.col("t_keeper").alias("keeper"))
    return whole.unionByName(general)


def drop_templates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    lead: int = LEAD,
    similarity: float = SIMILARITY,
    added: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """All rows and columns of `docs` with the kept lines in `text_col`, and how many lines there were and
    went as the columns named in `added` (replaced where there)."""
    keyed = with_row_key(docs, id_col, text_col)
    with scratch(docs.sparkSession) as keep:
        lines = stage(
            tree_lines(keyed, lead).select("id", "h", "doc", "line_no", "leaf", "line", "has_fixed"), "tree_lines"
        )
        recurring = stage(keepers(keyed, lines, min_docs, lead, similarity), "recurring")
        judged = lines.join(recurring, ["leaf", "line"], "left").select(
            "id", "h", "line_no", F.coalesce(F.col("doc") != F.col("keeper"), F.lit(False)).alias("drop")
        )
        marks = (
            judged.groupBy("id", "h")
            .agg(F.sort_array(F.collect_set(F.struct("line_no", "drop"))).alias("marks"))
            .select(
                "id",
                "h",
                F.transform("marks", lambda m: m["drop"]).alias("_drops"),
                F.size("marks").cast("long").alias("n_lines"),
                F.size(F.filter("marks", lambda m: m["drop"])).cast("long").alias("n_dropped"),
            )
        )
        # Dropped lines become null, and array_join passes over nulls.
        marks = keep(stage(marks.filter("n_dropped > 0"), "line_marks"))
    rows = docs.withColumn("_h", F.xxhash64(F.lit(7), text_or_empty(F.col(text_col))))
    joined = rows.join(marks, rows[id_col].eqNullSafe(marks["id"]) & (rows["_h"] == marks["h"]), "left")
    kept = F.array_join(F.zip_with(F.split(rows[text_col], "\n"), marks["_drops"], lambda x, d: F.when(~d, x)), "\n")
    text = F.when(marks["_drops"].isNull(), rows[text_col]).otherwise(kept)
    lines_of = F.when(rows[text_col].isNull(), 0).otherwise(F.size(F.split(rows[text_col], "\n")))
    return joined.select(
        *[text.alias(c) if c == text_col else rows[c] for c in docs.columns if c not in added],
        lines_of.cast("long").alias(added[0]),
        F.coalesce(marks["n_dropped"], F.lit(0)).cast("long").alias(added[1]),
    )


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, lang, source, n_chars) with the kept text and its length."""
    kept = drop_templates(docs, added=("_n_lines", "_n_dropped"))
    return kept.select(
        *[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    )


ORACLE = r"""
with raw as (
  select doc_id, i - 1 as line_no, l[i] as raw
  from (select doc_id, l, unnest(range(1, len(l) + 1)) as i
        from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null))),
tidied as (
  select doc_id, line_no, raw, trim(regexp_replace(raw, '[\x09-\x0D\x20]+', ' ', 'g'), ' ') as plain from raw),
lines as (
  select doc_id, line_no, raw, regexp_replace(plain, '[^ 0-9]*[0-9][^ ]*', '<*>', 'g') as norm from tidied),
toks as (select *, string_split(norm, ' ') as t from lines),
treed as (
  select *, len(t) as n, list_slice(t, 1, 2) as lead, len(list_filter(t, lambda x: x <> '<*>')) > 0 as has_fixed
  from toks where norm <> ''),
classes as (
  select norm, any_value(t) as t, any_value(n) as n, any_value(lead) as lead, any_value(has_fixed) as has_fixed,
    count(distinct doc_id) as docs, list(distinct doc_id) as holders, min(doc_id) as keeper from treed group by norm),
whole as (select norm, keeper from classes where docs >= 5 and has_fixed),
rest as (
  select * from (
    select *, sum(docs) over (partition by n, lead) as leaf_docs, count(*) over (partition by n, lead) as leaf_lines
    from classes where docs < 5) where leaf_docs >= 5 and leaf_lines > 1),
tokens as (select norm, n, lead, holders, p, t[p] as token from (select *, unnest(range(3, n + 1)) as p from rest)),
fixed as (
  select n, lead, p, token from (select n, lead, p, token, unnest(holders) as doc from tokens where token <> '<*>')
  group by n, lead, p, token having count(distinct doc) >= 5),
stays as (
  select norm, list((p, token) order by p) as stays from tokens join fixed using (n, lead, p, token) group by norm),
shaped as (
  select r.*, coalesce(cast(s.stays as varchar), '') as template, coalesce(len(s.stays), 0) as n_stays,
    len(list_filter(r.lead, lambda x: x <> '<*>')) as lead_fixed
  from rest r left join stays s using (norm)),
supported as (
  select n, lead, template, count(distinct doc) as t_docs, min(keeper) as t_keeper
  from (select n, lead, template, keeper, unnest(holders) as doc from shaped) group by n, lead, template),
general as (
  select s.norm, u.t_keeper as keeper from shaped s join supported u using (n, lead, template)
  where u.t_docs >= 5 and s.n_stays + s.lead_fixed >= s.n * 0.8),
recurring as (select * from whole union all select * from general),
judged as (
  select l.doc_id, l.line_no, l.raw, coalesce(l.doc_id <> r.keeper, false) as gone
  from lines l left join recurring r on l.norm = r.norm)
select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
  cast(length(coalesce(string_agg(raw, chr(10) order by line_no) filter (not gone), '')) as bigint) as n_chars,
  sha256(coalesce(string_agg(raw, chr(10) order by line_no) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""


@query("op9_line_templates", ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_templates(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
