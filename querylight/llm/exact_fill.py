"""Best-fit packing of whole documents by exact-complement hashing.

Every document is encoded once. One longer than the window is cut into whole windows and one rest,
which is its first piece; all others stay whole. Packing sees only how many pieces of each length there
are, at most one count per length, however large the corpus. A sequence starts with the longest length
left. An index keyed by sum says whether one length, two, or three (one and a pair) close the gap exactly with
what is still available; the combination found is used as often as the counts allow. When none does, the
longest length that fits goes in and the smaller gap is looked up. A length that ends with a gap is set aside;
at last the lengths set aside are placed in decreasing order, each into the open sequence with the least gap that
holds it. Three orders of filling are tried on the counts, and the one of fewest sequences is taken. Ranks of the pieces within their length then say which sequence and offset each piece takes.

Results for odd input: a null or empty text is one piece, the end id alone. Repeated rows are packed each, and
equal pieces (ties) take places in the order of id, start and checksum. A text of any length is encoded whole. An
empty table gives no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylight.llm.packing import Seats, encode
from querylight.llm.registry import query, table
from querylight.operators.numbering import number_rows
from querylight.session import spread, stage

WINDOW = 1024
END_ID = 2
BATCH_PIECES = 4096

# Passes of exact filling before best fit: most lengths in a combination, and whether open gaps take the longest length.
PLANS = [[(3, True)], [(1, True), (2, True), (3, True)], [(1, False)]]

Fill = tuple[int, list[tuple[int, int]]]


def cut_places(length: int, window: int) -> list[int]:
    """Starts of the pieces of a document: the rest first, then whole windows."""
    return [0, *range(length % window or window, length, window)]


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    model: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of each document's ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, rows = batch.column("id"), batch.column("text"), []

            def flush() -> pa.RecordBatch:
                at, piece, start, length, crc = zip(*rows)
                return pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(at, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int32()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=names,
                )

            for i in range(batch.num_rows):
                ids = np.append(encode(texts[i].as_py(), model, ranks), np.uint32(end_id)).astype("<u4")
                starts = cut_places(len(ids), window)
                for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    rows.append((i, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                if len(rows) >= BATCH_PIECES:
                    yield flush()
                    rows.clear()
            if rows:
                yield flush()

    given = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return spread(given).mapInArrow(cut, f"id {kind}, piece int, start long, length int, ids_crc32 long")


class SumIndex:
    """Counts of lengths with, for every sum, how many pairs of available lengths make it."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64).copy()
        size = len(counts)
        self.pairs = np.zeros(2 * size, dtype=np.int64)
        have = np.flatnonzero(self.counts)
        for x in have:
            self.pairs[x + have[have > x]] += 1
            self.pairs[2 * x] += self.counts[x] > 1

    def use(self, length: int, n: int) -> None:
        before = self.counts[length]
        after = self.counts[length] = before - n
        if (before > 1) != (after > 1):
            self.pairs[2 * length] += 1 if after > 1 else -1
        if (before > 0) != (after > 0):
            others = np.flatnonzero(self.counts)
            self.pairs[length + others[others != length]] += 1 if after > 0 else -1

    def pair(self, total: int, need: dict[int, int]) -> list[int]:
        """The pair with the longest member that makes `total` beside what `need` takes, or nothing."""
        if total < 2 or total >= len(self.pairs) or not self.pairs[total]:
            return []
        top = min(total - 1, len(self.counts) - 1)
        x = np.arange(top, (total - 1) // 2, -1)
        x = x[(self.counts[x] > 0) & (self.counts[total - x] > 0)]
        for a in x.tolist():
            b = total - a
            if self.free(a, need) >= 1 + (a == b) and self.free(b, need) >= 1 + (a == b):
                return [a, b]
        return []

    def free(self, length: int, need: dict[int, int]) -> int:
        return int(self.counts[length]) - need.get(length, 0)

    def close(self, gap: int, need: dict[int, int], most: int = 3) -> list[int]:
        """Up to `most` (one to three) available lengths whose sum is `gap`, beside what `need` takes; or nothing."""
        if gap < len(self.counts) and self.free(gap, need) > 0:
            return [gap]
        two = self.pair(gap, need) if most > 1 else []
        if two or most < 3:
            return two
        first = np.flatnonzero(self.counts[: max(gap - 1, 0)])[::-1]
        first = first[gap - first < len(self.pairs)]
        for x in first[self.pairs[gap - first] > 0].tolist():
            if self.free(x, need) > 0:
                two = self.pair(gap - x, need | {x: need.get(x, 0) + 1})
                if two:
                    return [x, *two]
        return []

    def longest(self, room: int, need: dict[int, int]) -> int:
        """The longest available length within `room`, or 0."""
        for x in np.flatnonzero(self.counts[: room + 1])[::-1].tolist():
            if self.free(x, need) > 0:
                return x
        return 0


def exact_fills(counts: np.ndarray, window: int, most: int = 3, grow: bool = True) -> tuple[list[Fill], np.ndarray]:
    """Fills without a gap, each closed by up to `most` lengths, and the counts of the lengths that found none.

    With `grow`, the longest length that fits goes into a gap that cannot be closed.
    """
    index, found, left = SumIndex(counts), [], np.zeros_like(counts)
    while True:
        start = index.longest(window, {})
        if not start:
            return found, left
        need, gap = {start: 1}, window - start
        while gap:
            more = index.close(gap, need, most) or ([index.longest(gap, need)] if grow else [0])
            if not more[0]:
                break
            for x in more:
                need[x] = need.get(x, 0) + 1
            gap -= sum(more)
        if gap:
            left[start] += index.counts[start]
            index.use(start, int(index.counts[start]))
            continue
        times = min(int(index.counts[x]) // n for x, n in need.items())
        for x, n in need.items():
            index.use(x, times * n)
        found.append((times, sorted(need.items(), reverse=True)))


def best_fit(counts: np.ndarray, window: int) -> list[Fill]:
    """Best fit in decreasing order; sequences of equal content are handled together."""
    open_at: list[list[list]] = [[] for _ in range(window + 1)]
    some = np.zeros(window + 1, dtype=bool)

    def put(gap: int, times: int, content: dict[int, int]) -> None:
        if times:
            open_at[gap].append([times, content])
            some[gap] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fitting = np.flatnonzero(some[length:])
            if len(fitting):
                gap = length + int(fitting[0])
                times, content = open_at[gap].pop()
                some[gap] = bool(open_at[gap])
                use = min(times, left)
                if use < times:
                    put(gap, times - use, content)
                put(gap - length, use, content | {length: content.get(length, 0) + 1})
                left -= use
            else:
                each = window // length
                put(window - each * length, left // each, {length: each})
                if left % each:
                    put(window - left % each * length, 1, {length: left % each})
                left = 0
    return [(times, sorted(content.items(), reverse=True)) for bins in open_at for times, content in bins]


def fill_sequences(counts: np.ndarray, window: int) -> list[Fill]:
    """(number of sequences, their multiset of lengths) until every piece has its place.

    Closing gaps early uses up short lengths that best fit could spread better, by a per cent or so and
    not for all distributions. So the plans of `PLANS` are all made, and the one of fewest sequences is kept.
    """
    made = []
    for plan in PLANS:
        fills, left = [], counts
        for most, grow in plan:
            exact, left = exact_fills(left, window, most, grow)
            fills += exact
        made.append(fills + best_fit(left, window))
    return min(made, key=lambda fills: sum(times for times, _ in fills))


def pack_whole(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of `docs` (doc_id, text, …) with sequence_id and offset."""
    cut = stage(pieces(docs, window=window, end_id=end_id), "pieces")
    counts = np.zeros(window + 1, dtype=np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `window` rows
        counts[length] = n
    seats = Seats(fill_sequences(counts, window))
    ranked = number_rows(cut, ["length"], ["id", "start", "ids_crc32"], out="rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            sequence, offset = seats.find(lengths, batch.column("rank").to_numpy())
            columns = [*batch.columns[:3], pa.array(lengths.astype(np.int64)), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = ranked.select("id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long"))
    return ordered.mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


@query("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_whole(table(spark, sf_dir, "documents"))
