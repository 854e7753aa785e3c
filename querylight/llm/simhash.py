"""Document fingerprints: SimHash votes, and permuted block tables for the near ones.

A document's terms are pairs of neighbouring words (the last word is a term alone), and a term weighs
as many votes as its first word has characters. Each term's 64-bit hash votes on each bit; a bit is
set when more than half of the weight voted for it. The votes for two bits travel in one long, so a
document's votes are 32 sums, combined before the shuffle.

Near fingerprints: the bits are cut into blocks, and a table per choice of blocks is keyed by these
blocks' bits. With a radius of r and r + 3 blocks, fingerprints within the radius agree in all of
some 3 blocks, so one of the tables brings them together; the pair counts in the first that does.

Results for odd input: null counts as empty; a text without words has one term, the whole text, so
equal texts always have equal fingerprints. Rows that agree in id and text are one document in the
order of ids and get equal rows, one each. Null ids come first in that order. A document alone is
its own next one. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylight.llm.common import same_row, text_or_empty, with_row_key, words
from querylight.llm.registry import query, table
from querylight.operators.numbering import number_rows
from querylight.session import stage

BITS = 64
RADIUS = 3
SPARE_BLOCKS = 3
TWO_LANES = (1 << 32) | 1  # the bits j and j + 32 of a shifted hash


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, fingerprint): 64 bits as a long for each row of `texts`; rows of equal keys must hold equal texts."""
    tokens = texts.select(*keys, words(F.col(text_col)).alias("w"), F.col(text_col).alias("t"))
    tokens = tokens.select(*keys, F.when(F.size("w") > 0, F.col("w")).otherwise(F.array(F.col("t"))).alias("w"))
    placed = tokens.select(*keys, "w", F.posexplode("w").alias("at", "word"))
    terms = placed.select(
        *keys,
        F.xxhash64("word", F.get("w", F.col("at") + 1)).alias("hash"),
        F.greatest(F.char_length("word"), F.lit(1)).cast("long").alias("weight"),
    )
    lanes = [
        F.sum(F.shiftrightunsigned("hash", j).bitwiseAND(F.lit(TWO_LANES)) * F.col("weight")).alias(f"lane{j}")
        for j in range(BITS // 2)
    ]
    voted = terms.groupBy(*keys).agg(F.sum("weight").alias("total"), *lanes)
    bits = F.lit(0).cast("long")
    for j in range(BITS // 2):
        low, high = F.col(f"lane{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"lane{j}"), 32)
        for votes, bit in ((low, j), (high, j + 32)):
            mask = (1 << bit) if bit < 63 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(votes * 2 > F.col("total"), F.lit(mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return voted.select(*keys, bits.alias("fingerprint"))


def hex16(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def block_masks(radius: int = RADIUS, spare: int = SPARE_BLOCKS) -> list[int]:
    """The bits compared in each table: every choice of `spare` of radius + spare blocks."""
    blocks = radius + spare
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    spans = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(spans[i] for i in chosen) for chosen in combinations(range(blocks), spare)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_fingerprints(queries: DataFrame, table_of: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q, fingerprint, …): for each distinct q of `queries` the rows of `table_of` (distinct
    fingerprints) within the radius, its own included."""
    masks = block_masks(radius)

    def keyed(df: DataFrame, value: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col(value).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
        return df.select("*", F.explode(keys).alias("k")).select(*df.columns, "k.i", "k.key")

    differ = F.col("q").bitwiseXOR(F.col("fingerprint"))
    first = F.lit(len(masks))
    for i in range(len(masks) - 1, -1, -1):
        first = F.when(differ.bitwiseAND(F.lit(masks[i])) == 0, F.lit(i)).otherwise(first)
    a, b = keyed(queries, "q"), keyed(table_of, "fingerprint")
    met = a.join(b, ["i", "key"]).filter((F.bit_count(differ) <= radius) & (F.col("i") == first))
    return met.drop("i", "key")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row of `docs`: id, n_chars, edited_sha256, fingerprint, edited_fingerprint (longs), near_edited,
    near_next, n_near (for ids divisible by 100: how many documents lie within the radius, itself included)."""
    keyed = with_row_key(docs, id_col, text_col).withColumn("text", text_or_empty(F.col("text")))
    sizes = keyed.select("id", "h", F.char_length("text").cast("long").alias("n_chars")).distinct()
    ranked = stage(number_rows(sizes, [], ["id", "h"], out="rank", total="docs"), "ranked")
    after = ranked.select(F.col("id").alias("nid"), F.col("h").alias("nh"), F.col("rank").alias("nrank"))
    following = ranked.withColumn("nrank", (F.col("rank") + 1) % F.col("docs")).join(after, "nrank")
    following = stage(following.select("id", "h", "nid", "nh", F.floor(F.col("n_chars") / 4).alias("quarter")), "following")

    next_start = (
        keyed.join(following.withColumnsRenamed({"id": "tid", "h": "th"}), F.col("id").eqNullSafe(F.col("nid")) & (F.col("h") == F.col("nh")))
        .select(F.col("tid").alias("id"), F.col("th").alias("h"), "quarter", F.substr("text", F.lit(1), F.col("quarter").cast("int")).alias("start"))
        .dropDuplicates(["id", "h"])
    )
    cut = F.substr("text", F.lit(1), (F.char_length("text") - F.col("quarter")).cast("int"))
    both = keyed.join(next_start, same_row(keyed, next_start)).select(keyed["id"], keyed["h"], "text", F.concat(cut, "start").alias("edited"))
    both = both.select(
        "id",
        "h",
        F.unhex(F.sha2("edited", 256)).alias("sha"),
        F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("t")), F.struct(F.lit(1).alias("e"), F.col("edited").alias("t")))).alias("x"),
    )
    texts = both.select("id", "h", "sha", F.col("x.e").alias("e"), F.col("x.t").alias("text"))
    prints = fingerprints(texts, ["id", "h", "sha", "e"])
    prints = prints.groupBy("id", "h", "sha").agg(
        F.max(F.when(F.col("e") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("e") == 1, F.col("fingerprint"))).alias("edited"),
    )
    prints = stage(prints, "fingerprints")

    held = prints.select("id", "h", "fingerprint").join(
        keyed.select(F.col("id").alias("i2"), F.col("h").alias("h2")).groupBy("i2", "h2").agg(F.count("*").alias("rows")),
        F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")),
    )
    held = stage(held.select("id", "h", "fingerprint", "rows"), "held")
    asked = held.filter(F.col("id") % 100 == 0).select(F.col("fingerprint").alias("q")).distinct()
    distinct = held.groupBy("fingerprint").agg(F.sum("rows").alias("rows"))
    near = near_fingerprints(asked, distinct, radius).groupBy("q").agg(F.sum("rows").alias("n_near"))
    near = stage(near, "near_counts")

    next_prints = prints.select(F.col("id").alias("nid"), F.col("h").alias("nh"), F.col("fingerprint").alias("next"))
    nexts = following.join(
        next_prints, following["nid"].eqNullSafe(next_prints["nid"]) & (following["nh"] == next_prints["nh"])
    ).select(following["id"], following["h"], "next")
    full = prints.join(nexts, same_row(prints, nexts)).select(prints["id"], prints["h"], "sha", "fingerprint", "edited", "next")
    full = full.join(held.select("id", "h", "rows"), same_row(full, held)).select(full["id"], full["h"], "sha", "fingerprint", "edited", "next", "rows")
    full = full.join(ranked.select("id", "h", "n_chars"), same_row(full, ranked)).drop(ranked["id"], ranked["h"])
    full = full.withColumn("q", F.when(F.col("id") % 100 == 0, F.col("fingerprint"))).join(near, "q", "left")
    return full.select(
        "id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        "fingerprint",
        F.col("edited").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
        "n_near",
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_copy"),
    ).drop("_copy")


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        hex16(F.col("fingerprint")).alias("fingerprint"),
        hex16(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "n_near",
    )
