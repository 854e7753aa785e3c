"""Pair merges: the best ranked adjacent pair of a word is merged until none is ranked.

A table of merges within `MERGE_BYTES` goes to the tasks as sorted arrays: a pair's key is two symbol numbers in
one integer, looked up by binary search. A word is a linked list of symbols with a heap of its ranked pairs, so it
takes time n log n whatever its length, and nothing but adjacent pairs is ever looked up. A larger table
stays where it is, and the pairs of all words meet it by join, one merge of each word per round.

Byte-level merges work on texts whose bytes are written as printable characters, see `byte_text`.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylight.session import SLICE_ROWS, fan_out, stage

MERGE_BYTES = 64 << 20
PAIR_BYTES = 64  # of a merge in the arrays, beside its texts
CACHED_WORDS = 200_000

# Bytes that stand for themselves; all others are numbered on behind 255, in order.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_moved = [b for b in range(256) if b not in PRINTABLE]
BYTES_AS_READ, BYTES_AS_SHOWN = "".join(map(chr, _moved)), "".join(chr(256 + i) for i in range(len(_moved)))


def byte_text(text: Column) -> Column:
    """The UTF-8 bytes of a text, one printable character each."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), BYTES_AS_READ, BYTES_AS_SHOWN)


def text_of_bytes(shown: Column) -> Column:
    """The way back from `byte_text`."""
    # translate() drops what it should turn into the zero character, the first of those shown otherwise.
    read = F.replace(F.translate(shown, BYTES_AS_SHOWN[1:], BYTES_AS_READ[1:]), F.lit(BYTES_AS_SHOWN[0]), F.lit(BYTES_AS_READ[0]))
    return F.decode(F.encode(read, "ISO-8859-1"), "UTF-8")


class MergeTable:
    """Merges (left, right, rank) as sorted arrays of pair keys, ranks and the symbols they make."""

    def __init__(self, merges: Iterable[tuple[str, str, int]]):
        best: dict[tuple[str, str], int] = {}
        for left, right, rank in merges:
            best[left, right] = min(rank, best.get((left, right), rank))
        texts = sorted({x for pair in best for x in (*pair, pair[0] + pair[1])})
        self.numbers = {text: i for i, text in enumerate(texts)}
        self.texts = texts
        rows = sorted((self.key(self.numbers[a], self.numbers[b]), rank, self.numbers[a + b]) for (a, b), rank in best.items())
        self.keys = array("q", [key for key, _, _ in rows])
        self.ranks = array("q", [rank for _, rank, _ in rows])
        self.made = array("q", [made for _, _, made in rows])
        self.words: dict[str, list[str]] = {}

    @staticmethod
    def key(left: int, right: int) -> int:
        return left << 32 | right

    def find(self, left: int, right: int) -> int:
        """The place of a pair in the arrays, or -1."""
        if left < 0 or right < 0:
            return -1
        key = left << 32 | right
        at = bisect_left(self.keys, key)
        return at if at < len(self.keys) and self.keys[at] == key else -1

    def pieces(self, word: str) -> list[str]:
        """The merged parts of one word, remembered for words seen before."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            found = self.words[word] = self.merge(word)
        return found

    def merge(self, word: str) -> list[str]:
        size = len(word)
        symbol = [self.numbers.get(c, -1) for c in word]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        end = [False] * size  # places whose symbol went into the one on the left
        heap = []
        for i in range(size - 1):
            at = self.find(symbol[i], symbol[i + 1])
            if at >= 0:
                heap.append((self.ranks[at], i, at))
        heapify(heap)
        while heap:
            rank, fresh = heap[0][0], []
            # One pass merges the pair wherever it stands, from the left; pairs that arise wait for the next pass.
            while heap and heap[0][0] == rank:
                _, i, at = heappop(heap)
                j = after[i]
                if end[i] or j >= size or self.keys[at] != (symbol[i] << 32 | symbol[j]):
                    continue
                symbol[i], end[j] = self.made[at], True
                after[i] = after[j]
                if after[i] < size:
                    before[after[i]] = i
                for left in (before[i], i):
                    if left >= 0 and after[left] < size:
                        fresh.append(left)
            for left in fresh:
                if not end[left] and after[left] < size:
                    at = self.find(symbol[left], symbol[after[left]])
                    if at >= 0:
                        heappush(heap, (self.ranks[at], left, at))
        return [word[i : after[i]] if symbol[i] < 0 else self.texts[symbol[i]] for i in range(size) if not end[i]]


def merge_table(merges: DataFrame) -> MergeTable | None:
    """The merges as arrays, or None when they are more than `MERGE_BYTES`."""
    texts = F.sum(F.octet_length("left") + F.octet_length("right"))
    count, size = merges.agg(F.count("*"), F.coalesce(texts, F.lit(0))).first()
    if count * PAIR_BYTES + 2 * size > MERGE_BYTES:
        return None
    return MergeTable((r["left"], r["right"], r["rank"]) for r in merges.select("left", "right", "rank").collect())


def bpe(words: DataFrame, merges: DataFrame) -> DataFrame:
    """`(word, pieces)` for the distinct words under `merges(left, right, rank)`."""
    table = merge_table(stage(merges, "merges"))
    distinct = fan_out(words.select("word").distinct())
    if table is None:
        return bpe_by_join(distinct, merges)
    shared = words.sparkSession.sparkContext.broadcast(table)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [None if w is None else shared.value.merge(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(pieces, pa.list_(pa.string()))], names=["word", "pieces"])

    return distinct.mapInArrow(encode, "word string, pieces array<string>")


def bpe_by_join(words: DataFrame, merges: DataFrame) -> DataFrame:
    """The same by one join of all adjacent pairs per round; a round merges the best pair of each word."""
    live = words.select("word", F.filter(F.split("word", ""), lambda c: c != "").alias("parts"))
    ranked = merges.groupBy("left", "right").agg(F.min("rank").alias("rank"))
    done: DataFrame | None = None
    while True:
        here = stage(live, "parts")
        size = F.size("parts")
        neighbours = F.zip_with(
            F.slice("parts", F.lit(1), F.greatest(size - 1, F.lit(0))), F.slice("parts", 2, F.greatest(size - 1, F.lit(0))),
            lambda a, b: F.struct(a.alias("left"), b.alias("right")),
        )
        pairs = here.select("word", F.explode(F.array_distinct(neighbours)).alias("p")).select("word", "p.left", "p.right")
        best = pairs.join(ranked, ["left", "right"]).groupBy("word").agg(F.min(F.struct("rank", "left", "right")).alias("best"))
        best = stage(best, "best")
        settled = here.join(best, "word", "left_anti").select("word", F.col("parts").alias("pieces"))
        done = settled if done is None else done.unionByName(settled)
        if best.isEmpty():
            return done

        def step(state: Column, x: Column) -> Column:
            meets = (state["held"] == F.col("best.left")) & (x == F.col("best.right"))
            kept = F.when(state["held"].isNull(), state["out"]).otherwise(F.array_append(state["out"], state["held"]))
            merged = F.struct(F.array_append(state["out"], F.concat(state["held"], x)).alias("out"), F.lit(None).cast("string").alias("held"))
            return F.when(meets, merged).otherwise(F.struct(kept.alias("out"), x.alias("held")))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))
        finish = F.aggregate(
            "parts", start, step,
            lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["held"])),
        )
        live = here.join(best, "word").select("word", finish.alias("parts"))


def encode_lists(lists: DataFrame, key: str, column: str, merges: DataFrame, vocab: DataFrame, unknown: int = 0, specials: list[str] | None = None) -> DataFrame:
    """`(key, ids)`: lists of pre-tokens through merges to ids, list by list.

    Merges and vocabulary within `MERGE_BYTES` go to the tasks, which remember the words they have met, so no
    row moves. Larger ones are met by join over the distinct words. Special tokens are numbered on behind the
    vocabulary and never merged; a piece that the vocabulary lacks becomes `unknown`.
    """
    specials = specials or []
    table = merge_table(stage(merges, "merges"))
    count, size, top = vocab.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)), F.coalesce(F.max("id"), F.lit(-1))).first()
    extra = {t: top + 1 + i for i, t in enumerate(specials)}
    if table is None or count * PAIR_BYTES + size > MERGE_BYTES:
        return _encode_by_join(lists, key, column, merges, vocab, unknown, extra)
    context = lists.sparkSession.sparkContext
    ids = {r["token"]: r["id"] for r in vocab.select("token", "id").collect()}
    shared = context.broadcast((table, ids | extra, extra))
    kind = lists.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids, extra = shared.value
        known: dict[str, list[int]] = {}
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            column = batch.column("tokens")
            flat = column.flatten().dictionary_encode()
            words = []
            for word in flat.dictionary.to_pylist():
                if len(known) >= CACHED_WORDS:
                    known.clear()
                if word not in known:
                    known[word] = [extra[word]] if word in extra else [ids.get(p, unknown) for p in table.merge(word)]
                words.append(known[word])
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            each = flat.indices.to_numpy()
            out = np.fromiter((i for w in each.tolist() for i in words[w]), dtype=np.int64, count=int(sizes[each].sum()) if len(each) else 0)
            ends = np.concatenate([[0], np.cumsum(sizes[each] if len(each) else np.zeros(0, np.int64))])
            offsets = ends[np.asarray(column.offsets) - column.offsets[0].as_py()]
            lists_of = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(out), mask=column.is_null())
            yield pa.RecordBatch.from_arrays([batch.column("k"), lists_of.cast(pa.list_(pa.int64()))], names=["k", "ids"])

    given = lists.select(F.col(key).alias("k"), F.col(column).alias("tokens"))
    return given.mapInArrow(encode, f"k {kind}, ids array<bigint>").withColumnRenamed("k", key)


def _encode_by_join(lists: DataFrame, key: str, column: str, merges: DataFrame, vocab: DataFrame, unknown: int, extra: dict[str, int]) -> DataFrame:
    each = lists.select(key, F.posexplode(column).alias("pos", "word"))
    words = each.select("word").distinct().filter(~F.col("word").isin(list(extra)) if extra else F.lit(True))
    pieces = bpe_by_join(words, merges).select("word", F.posexplode("pieces").alias("at", "token"))
    found = pieces.join(vocab.groupBy("token").agg(F.min("id").alias("id")), "token", "left")
    ids = found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", F.lit(unknown)).alias("id")))).alias("l"))
    ids = ids.select("word", F.transform("l", lambda x: x["id"].cast("long")).alias("part"))
    special = F.lit(None).cast("long")
    for token, i in extra.items():
        special = F.when(F.col("word") == token, F.lit(i)).otherwise(special)
    parts = each.join(ids, "word", "left").withColumn("part", F.coalesce(F.when(special.isNotNull(), F.array(special)), "part"))
    joined = parts.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])).alias("ids"))
    empty = F.when(F.col(column).isNotNull(), F.array().cast("array<bigint>"))
    return lists.join(joined, key, "left").select(key, F.coalesce("ids", empty).alias("ids"))


def merge_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The merges of one word."""
    return MergeTable((left, right, rank) for (left, right), rank in ranks.items()).merge(word)
