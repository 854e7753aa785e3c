"""Removal of long repeated byte strings with a run-length index of the Burrows-Wheeler transform.

A byte goes when a string of `LENGTH` bytes that covers it also starts earlier, in a document of
smaller id or earlier in the same one. Finding all such strings takes four steps.

1. Anchors. Every string of `LENGTH` bytes holds `WINDOW` short grams; the one with the smallest hash
   (the leftmost of equals) is its anchor. Equal strings have equal anchors at the same place, and
   neighbouring strings mostly share one. Only anchors that occur twice or more matter further.
2. Segments. The strings that share one anchor occurrence lie in one segment of less than twice
   `LENGTH` bytes. A segment equal to an earlier one goes whole; of equal ones the first is kept.
3. Index. Different segments of the same anchor meet in a bucket. Each bucket's segments form a text
   whose run-length Burrows-Wheeler transform is built, with the text position, the position of the
   row above and the common length sampled at the start of each run. Streaming the text from one
   sample to the next gives every position its match length with the row above (the matching
   statistics), and following the rows above gives the first position of each repeated string.
4. Marks. The strings found are joined to byte ranges per document and cut out.

Skew: equal segments of an anchor collapse before they meet, so copies cost one segment each. Where
more than `FEW` different segments share an anchor, each is cut into parts of at most `STEP` strings,
and only parts that agree in the bytes common to all their strings meet; a frequent line shorter than
`LENGTH` falls apart there. Parts of which more than `BUCKET_SEGMENTS` agree are settled by grouping
their strings by their bytes, which needs no bucket.

Results for odd input: null counts as empty, and texts under `LENGTH` bytes keep all. A null id comes
before all others, and rows of equal id follow the order of their texts' hashes; rows that agree in
id and text are one document and get equal rows, one each. An empty table gives no rows. Segments
are told apart by two 64-bit hashes, strings in the index by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylight.llm.common import text_or_empty
from querylight.llm.registry import query, table
from querylight.session import release, scratch, stage

LENGTH = 100
GRAM = 20
WINDOW = LENGTH - GRAM + 1
CHUNK_BYTES = 1 << 19
PLACE_BITS = np.uint64(22)
FEW = 200
STEP = 16
BUCKET_SEGMENTS = 8000
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hash of the n bytes from each place on, built by doubling."""
    base = int(GOLD)
    have, width, out, span = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if n & width:
            if out is None:
                out, span = have, width
            else:
                size = len(data) - span - width + 1
                out = out[:size] * np.uint64(pow(base, width, 1 << 64)) + have[span : span + size]
                span += width
        if span == n:
            return mix(out)
        have = have[: len(have) - width] * np.uint64(pow(base, width, 1 << 64)) + have[width:]
        width *= 2


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of the w values from each place on."""
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def text_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the texts [start, end) of a run of bytes: text, hash, place, first and last start of the
    strings that share the anchor. Places are within the run, which is shorter than 2**PLACE_BITS."""
    h = gram_hashes(data)
    # The low bits hold the place, so the leftmost of equal hashes wins, whatever run the text is in.
    keyed = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    place = (sliding_least(keyed, WINDOW) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    strings = np.maximum(ends - starts - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(starts)), strings)
    at = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(strings) - strings), strings)
    own = place[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    return owner[heads], h[own[heads]], own[heads], at[heads], at[tails]


def runs_of_texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of an Arrow string column in runs of about CHUNK_BYTES: (bytes, starts, ends, row, offset in the row).

    Texts under LENGTH bytes are left out; a longer text than a run is cut into pieces that overlap, so
    that every string of LENGTH bytes lies in one piece.
    """
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    pieces = []
    for row in np.flatnonzero(np.diff(offsets) >= LENGTH):
        for start in range(offsets[row], offsets[row + 1] - LENGTH + 1, CHUNK_BYTES):
            pieces.append((row, start, min(start + CHUNK_BYTES + LENGTH - 1, offsets[row + 1])))
    i = 0
    while i < len(pieces):
        j, size = i, 0
        while j < len(pieces) and (j == i or size + pieces[j][2] - pieces[j][1] <= CHUNK_BYTES):
            size += pieces[j][2] - pieces[j][1]
            j += 1
        rows, starts, ends = (np.array(x, dtype=np.int64) for x in zip(*pieces[i:j]))
        lengths = ends - starts
        own = np.concatenate([data[a:b] for a, b in zip(starts, ends)])
        at = np.cumsum(lengths) - lengths
        yield own, at, at + lengths, rows, starts - offsets[rows]
        i = j


def anchor_hashes(keyed: DataFrame) -> DataFrame:
    """(anchor, id): a row per anchor of every text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, ends, rows, _ in runs_of_texts(batch.column("text")):
                text, h, _, _, _ = text_anchors(data, starts, ends)
                ids = batch.column("id").take(pa.array(rows[text]))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids], names=["anchor", "id"])

    return keyed.select("id", "text").mapInArrow(hashed, "anchor long, id long")


SEGMENT = "anchor long, digest long, id long, h long, start long, strings int, anchor_at int, seg binary"


def segments(texts: DataFrame) -> DataFrame:
    """Segments of the anchors listed in `repeated`, per text: anchor, digest, id, h, start of the first
    string, number of strings, the anchor's place in it, and the bytes (null after a segment's first place
    in a batch)."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
    inverse = np.uint64(pow(int(GOLD), -1, 1 << 64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("repeated").flatten().to_numpy().view(np.uint64)
            wanted = np.unique(wanted)
            held = np.zeros(0, dtype=np.uint64)  # digests whose bytes the batch has sent
            for data, starts, ends, rows, shift in runs_of_texts(batch.column("text")):
                text, h, place, lo, hi = text_anchors(data, starts, ends)
                at = np.searchsorted(wanted, h)
                keep = (wanted[np.minimum(at, len(wanted) - 1)] == h) if len(wanted) else np.zeros(len(h), bool)
                text, h, place, lo, hi = (x[keep] for x in (text, h, place, lo, hi))
                powers = np.ones(len(data) + 1, dtype=np.uint64)
                powers[1:] = GOLD
                powers = np.multiply.accumulate(powers)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(values[data] * powers[:-1], dtype=np.uint64)])
                back = np.full(len(data) + 1, inverse, dtype=np.uint64)
                back[0] = 1
                back = np.multiply.accumulate(back)
                digest = mix((sums[hi + LENGTH] - sums[lo]) * back[lo])
                shape = ((place - lo).astype(np.uint64) << np.uint64(16)) + (hi - lo).astype(np.uint64)
                digest = mix(digest ^ mix(shape + GOLD) ^ h)
                distinct, one = np.unique(digest, return_index=True)
                one = one[~np.isin(distinct, held)]
                held = np.union1d(held, distinct)
                raw, seg = data.tobytes(), [None] * len(digest)
                for i, a, b in zip(one.tolist(), lo[one].tolist(), (hi[one] + LENGTH).tolist()):
                    seg[i] = raw[a:b]
                own = pa.array(rows[text])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)),
                        pa.array(digest.view(np.int64)),
                        batch.column("id").take(own),
                        batch.column("h").take(own),
                        pa.array(lo - starts[text] + shift[text]),
                        pa.array((hi - lo + 1).astype(np.int32)),
                        pa.array((place - lo).astype(np.int32)),
                        pa.array(seg, pa.binary()),
                    ],
                    names=[f.split()[0] for f in SEGMENT.split(", ")],
                )

    return texts.select("id", "h", "text", "repeated").mapInArrow(cut, SEGMENT)


@dataclass
class RunIndex:
    """Run-length Burrows-Wheeler transform of a text of segments, sampled at the starts of its runs."""

    heads: np.ndarray  # the sign of each run
    lengths: np.ndarray  # and how often it stands
    places: np.ndarray  # sampled text positions, ascending: where the first sign of each run stands
    above: np.ndarray  # position of the row above each sample's row, -1 for none
    common: np.ndarray  # signs that both rows begin with
    size: int

    @classmethod
    def build(cls, signs: np.ndarray) -> RunIndex:
        """Of a text in which every segment ends with a sign of its own."""
        order, rank = suffix_order(signs)
        last = signs[order - 1]
        new = np.ones(len(last), dtype=bool)
        new[1:] = last[1:] != last[:-1]
        starts = np.flatnonzero(new)
        places = np.sort((order[starts] - 1) % len(signs))
        row = rank[places]
        above = np.where(row > 0, order[row - 1], -1)
        return cls(last[starts], np.diff(np.append(starts, len(last))), places, above, common_length(signs, places, above), len(signs))

    def matching(self) -> tuple[np.ndarray, np.ndarray]:
        """For every text position the position of the row above it and the common length, streamed from
        the next sample: one position back, both move along and the match is one sign longer."""
        at = np.searchsorted(self.places, np.arange(self.size))
        ahead = self.places[at] - np.arange(self.size)
        above = np.where(self.above[at] >= 0, self.above[at] - ahead, -1)
        return above, np.where(above >= 0, self.common[at] + ahead, 0)

    def first_places(self, length: int) -> np.ndarray:
        """For every position the first one where the same `length` signs start."""
        above, common = self.matching()
        here = np.arange(self.size)
        root = np.where(common >= length, above, here)
        while True:  # follow the rows above to the top of each group of equal strings
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
        first = np.full(self.size, self.size)
        np.minimum.at(first, root, here)
        return first[root]


def suffix_order(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the rank of each: sorted by the first signs, then by doubling the length
    compared, where only suffixes not yet told apart are sorted again."""
    n = len(signs)
    bits = int(signs.max() + 1).bit_length()
    width = max(1, min(63 // bits, n))
    key = np.zeros(n, dtype=np.int64)
    for i in range(width):
        key <<= bits
        key[: n - i] += signs[i:] + 1
    order = np.argsort(key, kind="stable")
    slots, moved = np.arange(n), key[order]
    rank = np.empty(n, dtype=np.int64)
    while True:
        head = np.ones(len(slots), dtype=bool)
        head[1:] = moved[1:] != moved[:-1]
        rank[order[slots]] = np.maximum.accumulate(np.where(head, slots, 0))
        alone = head.copy()
        alone[:-1] &= head[1:]
        slots = slots[~alone]
        if not len(slots):
            return order, rank
        live = order[slots]
        behind = live + width
        key = rank[live] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[slots], moved = live[by], key[by]
        width *= 2


def common_length(signs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many signs the suffixes at a and b begin with in common; 0 where b is -1."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(b >= 0)
    padded = np.append(signs, -1)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        same = (padded[x] == padded[y]) & (x < len(signs)) & (y < len(signs))
        live = live[same]
        out[live] += 1
    return out


def mark_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """(id, h, start, end): the bytes to remove of a bucket's segments, found with its index."""
    rows = rows.sort_values(["id", "h", "start"], kind="stable").reset_index(drop=True)
    data = [np.frombuffer(x, dtype=np.uint8) for x in rows["seg"]]
    lengths = np.array([len(x) + 1 for x in data])
    begin = np.cumsum(lengths) - lengths
    signs = np.empty(lengths.sum(), dtype=np.int64)
    signs[begin + lengths - 1] = np.arange(len(data))  # the end signs, each its own
    inside = np.ones(len(signs), dtype=bool)
    inside[begin + lengths - 1] = False
    signs[inside] = np.concatenate(data).astype(np.int64) + len(data)
    first = RunIndex.build(signs).first_places(LENGTH)
    gone = np.flatnonzero(first < np.arange(len(signs)))
    owner = np.searchsorted(begin, gone, side="right") - 1
    start = rows["start"].to_numpy()[owner] + gone - begin[owner]
    head = np.ones(len(gone), dtype=bool)
    head[1:] = (gone[1:] != gone[:-1] + 1) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(gone)) - 1
    return pd.DataFrame(
        {
            "id": rows["id"].to_numpy()[owner[heads]],
            "h": rows["h"].to_numpy()[owner[heads]],
            "start": start[heads],
            "end": start[tails] + LENGTH if len(gone) else start[heads],
        }
    )


def agreeing_parts(known: DataFrame) -> DataFrame:
    """Segments cut by how far their strings reach before the anchor; parts with others of the same core.

    The strings that begin between a and a + STEP - 1 bytes before the anchor all cover the LENGTH - STEP + 1
    bytes from a before it on. Equal strings lie in parts of the same a with the same core.
    """
    reach = F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1), F.lit(STEP)))
    cut = known.select("anchor", "id", "h", "start", "strings", "anchor_at", "seg", reach.alias("a"))
    first = F.greatest(F.col("anchor_at") - F.col("a") - (STEP - 1), F.lit(0))
    last = F.least(F.col("anchor_at") - F.col("a"), F.col("strings") - 1)
    cut = cut.withColumns({"first": first, "last": last}).filter("first <= last")
    core = F.substring("seg", F.col("anchor_at") - F.col("a") + 1, F.lit(LENGTH - STEP + 1))
    parts = cut.select(
        F.xxhash64("anchor", "a", core).alias("anchor"),
        "id",
        "h",
        (F.col("start") + F.col("first")).alias("start"),
        (F.col("last") - F.col("first") + 1).alias("strings"),
        F.substring("seg", F.col("first") + 1, F.col("last") - F.col("first") + LENGTH).alias("seg"),
    )
    several = parts.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    return parts.join(several, "anchor")


def not_first() -> Column:
    """Whether a row is another than the one in its column `first`."""
    return ~((F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h")) & (F.col("start") == F.col("first.start")))


def unlike_segments(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ranges of segments that repeat as wholes, and one of each kind of an anchor that has several, with its bytes."""
    place = F.struct("id", "h", "start", "strings")
    kinds = cut.groupBy("anchor", "digest").agg(F.min(place).alias("first"), F.count("*").alias("c"))
    kinds = stage(kinds, "segment_kinds")
    again = cut.select("anchor", "digest", "id", "h", "start", "strings").join(kinds.filter("c > 1").drop("c"), ["anchor", "digest"])
    whole = again.filter(not_first()).select("id", "h", "start", (F.col("start") + F.col("strings") + LENGTH - 1).alias("end"))

    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    several = stage(kinds.join(several, "anchor").select("anchor", "digest", "kinds", "first"), "several")
    bytes_of = cut.filter("seg is not null").select("anchor", "digest", "anchor_at", "seg").join(several, ["anchor", "digest"])
    bytes_of = bytes_of.groupBy("anchor", "digest").agg(
        F.first("seg").alias("seg"), F.first("anchor_at").alias("anchor_at"), F.first("kinds").alias("kinds"), F.first("first").alias("f")
    )
    return whole, bytes_of.select("anchor", "f.id", "f.h", "f.start", "f.strings", "anchor_at", "kinds", "seg")


def repeated_ranges(keyed: DataFrame) -> DataFrame:
    """(id, h, start, end): byte ranges to remove from the texts of `keyed` (id, h, text); they may overlap."""
    spark = keyed.sparkSession
    with scratch(spark) as keep:
        found = stage(anchor_hashes(keyed), "anchors")
        repeated = found.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor")
        per_text = found.join(repeated, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("repeated"))
        cut = keep(stage(segments(keyed.join(per_text, "id")), "segments"))
    with scratch(spark) as keep:
        whole, known = unlike_segments(cut)
        whole, known = keep(stage(whole, "whole")), keep(stage(known, "different"))
    release(cut)
    parts = stage(agreeing_parts(known.filter(F.col("kinds") > FEW)), "parts")
    hot = parts.filter(F.col("kinds") > BUCKET_SEGMENTS)
    usual = known.filter(F.col("kinds") <= FEW).select(*parts.columns).unionByName(parts.filter(F.col("kinds") <= BUCKET_SEGMENTS))
    total = usual.agg(F.coalesce(F.sum(F.octet_length("seg")), F.lit(0))).first()[0]
    buckets = int(total // CHUNK_BYTES) + 1
    indexed = (
        usual.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
        .select("bucket", "id", "h", "start", "seg")
        .groupBy("bucket")
        .applyInPandas(mark_bucket, "id long, h long, start long, end long")
    )
    strings = hot.select("anchor", "id", "h", "start", "seg", F.explode(F.sequence(F.lit(0), F.col("strings") - 1)).alias("off")).select(
        "id", "h", (F.col("start") + F.col("off")).alias("start"), F.unhex(F.md5(F.substring("seg", F.col("off") + 1, F.lit(LENGTH)))).alias("string")
    )
    strings = stage(strings, "strings")
    origin = strings.groupBy("string").agg(F.min(F.struct("id", "h", "start")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    later = strings.join(origin, "string").filter(not_first()).select("id", "h", "start", (F.col("start") + LENGTH).alias("end"))
    return whole.unionByName(indexed).unionByName(later)


def merged(ranges: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((int(r["start"]), int(r["end"])) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut_out(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    rows = []
    for text, own in zip(texts, ranges):
        if text is None or own is None:
            rows.append((0, 0, None))
            continue
        data, spans = text.encode(), merged(own)
        edges = [0, *[x for span in spans for x in span], len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
        rows.append((len(data) - len(kept), len(spans), kept))
    return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    keyed = docs.select(
        F.col(id_col).alias("own"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"),
        F.xxhash64(F.lit(7), text_or_empty(F.col(text_col))).alias("h"),
        text_or_empty(F.col(text_col)).alias("text"),
    )
    with scratch(docs.sparkSession) as keep:
        ranges = repeated_ranges(keyed.select("id", "h", "text"))
        ranges = ranges.groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
        ranges = keep(stage(ranges, "ranges"))
    joined = keyed.join(ranges, ["id", "h"], "left")
    removed = F.pandas_udf(cut_out, "n_removed long, n_spans long, kept binary")
    cut = joined.withColumn("cut", removed(F.when(F.col("ranges").isNotNull(), F.col("text")), F.col("ranges")))
    return cut.select(
        F.col("own").alias("id"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce("cut.n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("cut.n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("cut.kept", F.col("text").cast("binary")).alias("kept"),
    )


@query("op8_repeat_index")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
