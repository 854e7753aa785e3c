"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark item is cut into windows of `WINDOW` words; a window is the set of its shingles
(`SHINGLE` neighbouring words), and a document is contaminated by a window that it contains whole.
Containment means that any one shingle of the window must occur, so the necessary prefix is one
shingle, and the rarest over all documents gives the fewest candidates. A candidate has a start
(shingle position less its offset in the window) that must leave room for the window before the
document ends, and the words from there on are compared with the window's words.

Results for odd input: a null or empty text has no words and no hits; an item without words has no
window; an item shorter than a window is one window. Items of equal words share their windows, and
each is reported. A null item_id marks words but is not listed. Documents that agree in id and text
get equal rows, one each. Nothing is collected but the lengths of shingles, of which there are at
most `SHINGLE`. Benchmark shingles are broadcast below a checked size and joined by shuffle above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylight.llm.common import same_row, small, with_row_key, words
from querylight.llm.registry import query, table
from querylight.session import stage

WINDOW = 13
SHINGLE = 4


def shingle_hash(tokens: Column, at: Column, length: int) -> Column:
    """Hash of `length` words from the 0-based place `at` on."""
    return F.xxhash64(F.lit(length), *[F.get(tokens, at + i) for i in range(length)])


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, win): the distinct windows of each item as arrays of words."""
    tokens = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("tokens")).filter(F.size("tokens") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - window, F.lit(0)))
    return (
        tokens.select("item", "tokens", F.explode(starts).alias("at"))
        .select("item", F.slice("tokens", F.col("at") + 1, window).alias("win"))
        .distinct()
    )


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(win, len, off, sh): every shingle of every distinct window and its place there."""
    one = windows.select("win").distinct().withColumn("len", F.least(F.size("win"), F.lit(shingle)))
    placed = one.select("win", "len", F.explode(F.sequence(F.lit(0), F.size("win") - F.col("len"))).alias("off"))
    case = F.when(F.lit(False), F.lit(0).cast("long"))
    for n in range(1, shingle + 1):
        case = case.when(F.col("len") == n, shingle_hash(F.col("win"), F.col("off"), n))
    return placed.withColumn("sh", case)


def document_shingles(tokens: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, h, tokens, pos, sh): the shingles of all documents, at every place."""
    placed = tokens.select("id", "h", "tokens", F.posexplode("tokens").alias("pos", "word"))
    if len(lengths) == 1:
        cut = placed.filter(F.col("pos") + lengths[0] <= F.size("tokens"))
        return cut.withColumn("sh", shingle_hash(F.col("tokens"), F.col("pos"), lengths[0]))
    hashes = [
        F.when(F.col("pos") + n <= F.size("tokens"), shingle_hash(F.col("tokens"), F.col("pos"), n)) for n in lengths
    ]
    return placed.withColumn("sh", F.explode(F.array(*hashes))).filter(F.col("sh").isNotNull())


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """One row per document: id, h, n_words, n_hit, item_ids (sorted as strings), n_items."""
    keyed = with_row_key(docs, id_col, text_col)
    tokens = keyed.select("id", "h", words(F.col("text")).alias("tokens"))
    windows = stage(item_windows(items, item_id_col, item_text_col, window), "windows")
    shingles = stage(window_shingles(windows, shingle), "window_shingles")
    lengths = sorted(r[0] for r in shingles.select("len").distinct().collect())
    counted = tokens.select("id", "h", F.size("tokens").cast("long").alias("n_words"))
    if not lengths:
        return counted.select(
            "id", "h", "n_words", F.lit(0).cast("long").alias("n_hit"),
            F.array().cast("array<string>").alias("item_ids"), F.lit(0).cast("long").alias("n_items"),
        )
    distinct = shingles.select("sh").distinct()
    n_shingles = distinct.count()
    placed = document_shingles(tokens, lengths)

    # Rarity over all documents decides which shingle of a window is its prefix.
    rarity = placed.select("sh").join(small(distinct, n_shingles, 16), "sh").groupBy("sh").agg(F.count("*").alias("n"))
    rarity = stage(rarity, "rarity")
    rarest = Window.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "sh", "off")
    prefixes = (
        shingles.join(rarity, "sh", "left")
        .withColumn("place", F.row_number().over(rarest))
        .filter((F.col("place") == 1) & F.col("n").isNotNull())
        .select("sh", "off", "win")
    )
    prefixes = stage(prefixes, "prefixes")
    keys = prefixes.select("sh").distinct()
    # The words that a window could cover around the place, so that nothing is looked up again.
    first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    around = F.slice("tokens", first + 1, 2 * window - 1)
    candidates = (
        placed.join(small(keys, keys.count(), 16), "sh")
        .select("id", "h", "sh", "pos", first.alias("first"), around.alias("around"), F.size("tokens").alias("n"))
        .join(prefixes, "sh")
        .withColumn("start", F.col("pos") - F.col("off"))
        .filter((F.col("start") >= 0) & (F.col("start") + F.size("win") <= F.col("n")))
        .filter(F.slice("around", F.col("start") - F.col("first") + 1, F.size("win")) == F.col("win"))
    )
    found = stage(candidates.select("id", "h", "start", "win").distinct(), "found")

    by_place = Window.partitionBy("id", "h").orderBy("start", "end")
    before = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    hits = (
        found.select("id", "h", "start", (F.col("start") + F.size("win")).alias("end"))
        .distinct()
        .withColumn("from", F.greatest("start", F.coalesce(before, F.lit(0))))
        .groupBy("id", "h")
        .agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))
    )
    listed = (
        found.select("id", "h", "win").distinct().join(windows, "win")
        .groupBy("id", "h")
        .agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("item_ids"))
    )
    hits = hits.join(listed, same_row(hits, listed)).select(hits["id"], hits["h"], "n_hit", "item_ids")
    hits = stage(hits, "hits")
    return counted.join(hits, same_row(counted, hits), "left").select(
        counted["id"],
        counted["h"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
    )


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, …) that are not contaminated, as they are."""
    marks = contamination(docs, items)
    bad = stage(marks.filter(is_contaminated(F.col("n_hit"), F.col("n_words"))).select("id", "h").distinct(), "contaminated")
    key = F.xxhash64(F.lit(7), F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["id"]) & (key == bad["h"]), "left_anti")


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select distinct item_id, list_slice(w, s, s + 12) as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s from b where len(w) > 0)),
lens as (select distinct len(win) as l from bw),
dw as (
  select doc_id, s, l, list_slice(w, s, s + l - 1) as win
  from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as s from d cross join lens where len(w) >= l)),
found as (select dw.doc_id, dw.s, dw.l, bw.item_id from dw join bw on dw.win = bw.win),
hit as (
  select doc_id, count(distinct p) as n_hit
  from (select distinct doc_id, unnest(range(s, s + l)) as p from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as item_id from found) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


@query("op1_benchmark_decontamination", ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marks.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
