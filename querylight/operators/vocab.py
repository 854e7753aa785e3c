"""Vocabularies, token ids, WordPiece, pair merges, and the way back to text.

Costly work is done once per distinct word of the corpus and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylight.operators.merging import bpe, merge_word  # noqa: F401
from querylight.operators.numbering import number_rows
from querylight.operators.pieces import PieceAutomaton
from querylight.session import SLICE_ROWS, fan_out, stage

# Special tokens, in id order.
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
LONGEST_WORD = 200
VOCAB_BYTES, NODE_BYTES, ENTRY_BYTES = 256 << 20, 200, 64


def build_vocab(lists: DataFrame, size: int = 2000) -> DataFrame:
    """`vocab(id, token)` of token lists: specials, characters, `##` characters, the most frequent longer tokens."""
    tokens = lists.select(F.explode("tokens").alias("token"))
    counts = stage(tokens.groupBy("token").agg(F.count("*").alias("n")), "counts")
    chars = stage(counts.select(F.explode(F.array_distinct(F.split("token", ""))).alias("token")).distinct(), "chars")
    top = counts.filter(F.length("token") > 1).orderBy(F.desc("n"), "token").limit(size)
    special = F.array(*[F.struct(F.lit(0).alias("part"), F.lit(i).cast("long").alias("rank"), F.lit(t).alias("token"))
                        for i, t in enumerate(SPECIALS)])
    spark = tokens.sparkSession
    fixed = spark.range(1).select(F.explode(special).alias("s")).select("s.*")
    single = chars.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("rank"), "token")
    inner = chars.select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("rank"), F.concat(F.lit("##"), "token").alias("token"))
    words = top.select(F.lit(3).alias("part"), (-F.col("n")).alias("rank"), "token")
    listed = fixed.union(single).union(inner).union(words)
    return number_rows(listed, [], ["part", "rank", "token"], out="id").select("id", "token")


def _map_lists(lists: DataFrame, key: str, column: str, pairs: DataFrame, out: str, fallback) -> DataFrame:
    """`(key, out)`: every element of an array column looked up in `pairs`.

    A table within `VOCAB_BYTES` goes to the tasks, which look up whole Arrow batches, and no row moves; a larger
    one is met by join. A null list stays null, an empty one empty; a repeated entry of the table counts once, with its
    smallest value.
    """
    old, new = pairs.columns
    kind = dict(pairs.dtypes)[new]
    entries = stage(pairs.groupBy(old).agg(F.min(new).alias(new)), "entries")
    text = F.octet_length(F.col(old).cast("string")) + F.octet_length(F.col(new).cast("string"))
    count, size = entries.agg(F.count("*"), F.coalesce(F.sum(text), F.lit(0))).first()
    if ENTRY_BYTES * count + size > VOCAB_BYTES:
        return _map_by_join(lists, key, column, entries, out, fallback)
    shared = lists.sparkSession.sparkContext.broadcast(entries.filter(F.col(old).isNotNull()).toArrow().combine_chunks())
    kind_of = f"`{key}` {lists.schema[key].dataType.simpleString()}"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = (shared.value.column(i) for i in (0, 1))
        known = known.combine_chunks()
        values = pa.concat_arrays([values.combine_chunks().cast(pa.string() if kind == "string" else pa.int64()), pa.array([fallback], pa.string() if kind == "string" else pa.int64())])
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            column = batch.column(1)
            at = pc.fill_null(pc.index_in(column.flatten().cast(known.type), value_set=known), len(values) - 1)
            offsets = pa.array(np.asarray(column.offsets) - column.offsets[0].as_py())
            found = pa.ListArray.from_arrays(offsets, pc.coalesce(values.take(at), values[-1]), mask=column.is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[key, out])

    element = "string" if kind == "string" else "bigint"
    found = lists.select(key, column).mapInArrow(look_up, f"{kind_of}, `{out}` array<{element}>")
    return found.withColumn(out, F.col(out).cast(f"array<{kind}>"))


def _map_by_join(lists: DataFrame, key: str, column: str, entries: DataFrame, out: str, fallback) -> DataFrame:
    """The same by join of all elements, and the lists are put together again."""
    old, new = entries.columns
    kind = dict(entries.dtypes)[new]
    each = lists.select(key, F.posexplode(column).alias("pos", old))
    named = each.join(entries, old, "left").withColumn(new, F.coalesce(F.col(new), F.lit(fallback).cast(kind)))
    ordered = F.array_sort(F.collect_list(F.struct("pos", new)))
    joined = named.groupBy(key).agg(F.transform(ordered, lambda x: x[new]).alias(out))
    empty = F.when(F.col(column).isNotNull(), F.array().cast(f"array<{kind}>"))
    return lists.join(joined, key, "left").select(key, F.coalesce(out, empty).alias(out))


def id_lists(
    lists: DataFrame, vocab: DataFrame, key: str, unknown: str | int = "[UNK]", specials: list[str] | None = None
) -> DataFrame:
    """`(key, ids)` for token lists `(key, tokens)`; unknown tokens get the id of `[UNK]`, or a given number.

    Extra special tokens are numbered on behind the vocabulary, in the order given.
    """
    fallback = unknown if isinstance(unknown, int) else SPECIALS.index(unknown)
    known = vocab.select("token", "id")
    if specials:
        listed = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(i).alias("i")) for i, t in enumerate(specials)])
        after = vocab.agg((F.max("id") + 1).alias("first")).select("first", F.explode(listed).alias("s"))
        known = known.unionByName(after.select("s.token", (F.col("first") + F.col("s.i")).alias("id")))
    return _map_lists(lists, key, "tokens", known, "ids", fallback)


def token_lists(lists: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """`(key, tokens)` for id lists `(key, ids)`: the way back through the inverse vocabulary."""
    return _map_lists(lists, key, "ids", vocab.select("id", "token"), "tokens", "[UNK]")


def wordpiece(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """`(word, pieces)` for the distinct words: greedy longest match, `##` before inner pieces.

    A word with an unmatched rest, or of more than 200 characters, becomes `[UNK]`. A vocabulary within `VOCAB_BYTES`
    goes to the tasks as an automaton; a larger one is met by join.
    """
    tokens = stage(vocab.select("token"), "tokens")
    count, size = tokens.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()
    # An entry takes a node per character at most, and each node some hundred bytes.
    if NODE_BYTES * (count + size) > VOCAB_BYTES:
        return _wordpiece_joined(words, tokens)
    automaton = PieceAutomaton(sorted(r["token"] for r in tokens.collect()))
    shared = words.sparkSession.sparkContext.broadcast(automaton)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                None if w is None else (shared.value.pieces(w) if len(w) <= LONGEST_WORD else None) or (["[UNK]"] if w else [])
                for w in batch.column("word").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(out, pa.list_(pa.string()))], names=["word", "pieces"])

    return fan_out(words.select("word").distinct()).mapInArrow(split, "word string, pieces array<string>")


def _wordpiece_joined(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """All substrings a piece may have are looked up in one join; the longest hit per start position
    survives, and each word then walks from hit to hit.
    """
    longest = vocab.agg(F.max(F.length("token"))).first()[0] or 1
    distinct = stage(fan_out(words.select("word").distinct()), "words")
    spans = distinct.filter(F.length("word") <= LONGEST_WORD).select(
        "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start")
    )
    cut = spans.select(
        "word",
        "start",
        F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start") + 1))).alias("len"),
    )
    piece = F.substring("word", F.col("start"), F.col("len"))
    looked = cut.withColumn("token", F.when(F.col("start") > 1, F.concat(F.lit("##"), piece)).otherwise(piece))
    hits = looked.join(vocab.select("token"), "token", "left_semi").groupBy("word", "start").agg(F.max("len").alias("len"))
    steps = hits.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("start", "len"))).alias("steps"))

    def walk(state: Column, _: Column) -> Column:
        length = F.try_element_at(F.col("steps"), state["at"])
        text = F.substring(F.col("word"), state["at"], length)
        shown = F.when(state["at"] > 1, F.concat(F.lit("##"), text)).otherwise(text)
        onward = F.struct((state["at"] + length).alias("at"), F.array_append(state["out"], shown).alias("out"))
        return F.when((state["at"] > F.length("word")) | length.isNull(), state).otherwise(onward)

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
    end = F.aggregate(F.sequence(F.lit(1), F.length("word")), start, walk)
    walked = distinct.join(steps, "word", "left").withColumn("end", end)
    whole = F.col("end.at") > F.length("word")
    return walked.select("word", F.when(whole, F.col("end.out")).otherwise(F.array(F.lit("[UNK]"))).alias("pieces"))


def pair_counts(word_counts: DataFrame) -> DataFrame:
    """Adjacent character pairs of `(word, n)`, each pair once per word, weighted by the word count."""
    chars = F.split("word", "")
    pairs = F.zip_with(
        F.slice(chars, F.lit(1), F.size(chars) - 1),
        F.slice(chars, F.lit(2), F.size(chars)),
        lambda a, b: F.struct(a.alias("left"), b.alias("right")),
    )
    each = word_counts.filter(F.length("word") > 1).select("n", F.explode(F.array_distinct(pairs)).alias("p"))
    return each.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("n").alias("n"))


def top_merges(pairs: DataFrame, size: int) -> DataFrame:
    """The `size` most frequent pairs with their rank."""
    top = pairs.orderBy(F.desc("n"), "left", "right").limit(size).withColumn("m", -F.col("n"))
    return number_rows(top, [], ["m", "left", "right"], out="rank").select("left", "right", "rank")


# Blanks removed before punctuation and short forms, in this order.
TIDY = [
    (" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"),
    (" 've", "'ve"), (" 're", "'re"),
]


def tokens_to_text(tokens: Column, tidy: bool = True) -> Column:
    """Tokens joined to text, `##` pieces attached, blanks before punctuation removed."""
    text = F.trim(F.replace(F.array_join(tokens, " "), F.lit(" ##"), F.lit("")))
    if tidy:
        for old, new in TIDY:
            text = F.replace(text, F.lit(old), F.lit(new))
    return text


def pieces_to_text(tokens: Column) -> Column:
    """The plainer form: drops `[PAD]` and `[CLS]`, attaches `##` pieces, a blank before every other token."""
    kept = F.filter(tokens, lambda t: ~t.isin("[PAD]", "[CLS]"))
    return F.array_join(
        F.transform(kept, lambda t: F.when(t.startswith("##"), F.substr(t, F.lit(3))).otherwise(F.concat(F.lit(" "), t))), ""
    )
