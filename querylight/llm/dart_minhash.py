"""Near-duplicate classes by DartMinHash over weighted word shingles.

An element of a document is a shingle of five words, and its weight is how often it occurs; a
document of fewer words is one element, a text without words one element that is the whole text.
Documents are near-duplicates when the sum of the smaller weights is at least 0.8 of the sum of the
larger ones, and classes are the connected components of such pairs.

Signatures: every unit of an element's weight is a region in which darts land at hashed ranks, a
Poisson process that is the same for the same region in every document; a fractional rest of weight
keeps the darts whose hashed height lies below it. Each dart belongs to one hashed coordinate. Darts
are thrown up to the rank at which all coordinates should be hit, and further where one is not; the
earliest dart of a coordinate is its value. Two documents share it with the probability of their
weighted similarity, so bands of equal values find the candidates, and those are verified exactly.

Skew: texts of equal words meet in one representative first. A bucket links its members to one
pivot, the member that meets most others, not to each other. After the first components, members
outside a bucket's largest component are compared with the other components there, except where the
bound rules it out: two documents share no more than the weight that each has in common with any
other, and the threshold asks for similarity / (1 + similarity) of both weights together. No pair of
components that shares a bucket is left undecided. Pairs are dealt out by pivot and salt.

Results for odd input: null counts as empty text, and texts without words are one class only if
equal. Repeated rows and ids are members each. A null id belongs to the class of its text; a class
of null ids alone has a null class id. Words are those of `common.words`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylight.functions.vectors import let
from querylight.llm.common import small, text_or_empty, with_row_key, words
from querylight.llm.components import components
from querylight.llm.registry import query, table
from querylight.session import scratch, stage

SHINGLE = 5
SIMILARITY = 0.8
ROWS_PER_BAND = 5
BANDS = 25
SALT_ROWS = 512  # pairs of one pivot that share a copy of its elements
DARTS_AT_ONCE = 1 << 18

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingle_elements(flat: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Element hashes of documents given as word hashes in a row; (elements, document of each)."""
    lengths = np.diff(offsets)
    counts = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    doc = np.repeat(np.arange(len(lengths)), counts)
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(doc))
    length = np.minimum(lengths, k)[doc]
    out = mix(length.astype(np.uint64) + GOLD)
    padded = np.concatenate([flat, np.zeros(k, dtype=np.uint64)])
    for i in range(k):
        out = np.where(i < length, mix(out * GOLD + padded[first + i]), out)
    return out, doc


def weighted_elements(elements: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements per document with their counts, by document and element."""
    order = np.lexsort((elements, doc))
    elements, doc = elements[order], doc[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (elements[1:] != elements[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return elements[at], doc[at], np.diff(np.append(at, len(doc))).astype(np.float64)


def dart_signatures(
    elements: np.ndarray, doc: np.ndarray, weights: np.ndarray, n_docs: int, k: int, reach: float | None = None
) -> np.ndarray:
    """(n_docs, k) values: the hash of the earliest dart of each coordinate; 0 for documents without elements."""
    units = np.maximum(np.ceil(weights), 1).astype(np.int64)
    source = np.repeat(np.arange(len(elements)), units)
    level = np.arange(len(source)) - np.repeat(np.cumsum(units) - units, units)
    state = mix(elements[source] + (level.astype(np.uint64) + np.uint64(1)) * GOLD)
    part = np.minimum(weights[source] - level, 1.0)
    owner = doc[source]
    total = np.bincount(owner, weights=part, minlength=n_docs)
    reach = reach or (np.log(k) + 2) * k  # darts expected per document
    limit = reach / np.maximum(total, 1e-9)
    best = np.full(n_docs * k, np.inf)
    value = np.zeros(n_docs * k, dtype=np.uint64)
    clock = np.zeros(len(state))
    while len(state):
        state = mix(state + GOLD)
        clock = clock - np.log(unit(state))
        inside = clock <= limit[owner]
        state, clock, owner, part = state[inside], clock[inside], owner[inside], part[inside]
        low = slice(None) if (part >= 1).all() else unit(mix(state ^ M1)) <= part
        draw = mix(state[low] ^ M2)
        slot = owner[low] * k + (draw % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, slot, clock[low])
        won = best[slot] == clock[low]
        value[slot[won]] = draw[won]
    value = value.reshape(n_docs, k)
    short = np.isinf(best).reshape(n_docs, k).any(axis=1) & (total > 0)
    if short.any():  # throw further for documents with a coordinate not hit
        place = np.cumsum(short) - 1
        mine = short[doc]
        value[short] = dart_signatures(elements[mine], place[doc[mine]], weights[mine], int(short.sum()), k, 2 * reach)
    return value


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n_docs, bands): one hash per band of `rows` values."""
    out = np.empty((len(signatures), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(signatures), b + 1, dtype=np.uint64) * GOLD
        for r in range(rows):
            h = mix(h * GOLD + signatures[:, b * rows + r])
        out[:, b] = h
    return out


def list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values (as unsigned) and offsets of an Arrow list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows of about `most` in total."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield slice(start, len(sizes))


def bucket_rows(nodes: DataFrame, bands: int, rows: int, k: int) -> DataFrame:
    """(bucket, node, n): the buckets of each node's signature; n is the number of its shingles."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = list_column(batch.column("hashes"))
            lengths = np.diff(offsets)
            for part in chunks(lengths + 1500, DARTS_AT_ONCE):
                own = offsets[part.start : part.stop + 1]
                elements, doc = shingle_elements(flat[own[0] : own[-1]], own - own[0], k)
                n = np.bincount(doc, minlength=len(own) - 1)
                signatures = dart_signatures(*weighted_elements(elements, doc), len(own) - 1, bands * rows)
                some = np.flatnonzero(n > 0)
                buckets = band_hashes(signatures[some], bands, rows).view(np.int64)
                at = pa.array(np.repeat(some + part.start, bands))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(buckets.ravel()),
                        batch.column("node").take(at),
                        pa.array(np.repeat(n[some], bands).astype(np.int32)),
                    ],
                    names=["bucket", "node", "n"],
                )

    return nodes.mapInArrow(hashed, "bucket long, node binary, n int")


def similarities(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, similarity) of pairs that carry both documents' word hashes (left, right)."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [list_column(batch.column(c)) for c in ("left", "right")]
            sizes = np.diff(sides[0][1]) + np.diff(sides[1][1])
            for part in chunks(sizes, DARTS_AT_ONCE):
                n, keys, pair, count = part.stop - part.start, [], [], []
                for flat, offsets in sides:
                    own = offsets[part.start : part.stop + 1]
                    e, d, w = weighted_elements(*shingle_elements(flat[own[0] : own[-1]], own - own[0], k))
                    keys.append(e), pair.append(d), count.append(w)
                e, d, w = (np.concatenate(x) for x in (keys, pair, count))
                order = np.lexsort((e, d))
                e, d, w = e[order], d[order], w[order]
                both = np.flatnonzero((e[1:] == e[:-1]) & (d[1:] == d[:-1]))
                shared = np.bincount(d[both], weights=np.minimum(w[both], w[both + 1]), minlength=n)
                total = np.bincount(d, weights=w, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("a").slice(part.start, n),
                        batch.column("b").slice(part.start, n),
                        pa.array(shared / np.maximum(total - shared, 1)),
                    ],
                    names=["a", "b", "similarity"],
                )

    return pairs.select("a", "b", "left", "right").mapInArrow(compared, "a binary, b binary, similarity double")


def texts_of(keyed: DataFrame, ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes): the word hashes of the wanted nodes, from one row (id, h) of `keyed` for each."""
    row = F.struct(F.coalesce(F.col("id").cast("string"), F.lit("")), "h", "id")
    rows = ids.join(small(wanted, wanted.count(), 64), "node").groupBy("node").agg(F.min(row).alias("r"))
    rows = stage(rows.select(F.col("node"), F.col("r.id").alias("i2"), F.col("r.h").alias("h2")), "text_rows")
    same = F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))
    found = keyed.join(small(rows, rows.count(), 96), same).select("node", "text").dropDuplicates(["node"])
    return stage(found.select("node", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("hashes")), "texts")


def node_elements(texts: DataFrame, k: int) -> DataFrame:
    """(element, node, weight) of every node of `texts` (node, hashes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = list_column(batch.column("hashes"))
            for part in chunks(np.diff(offsets), DARTS_AT_ONCE):
                own = offsets[part.start : part.stop + 1]
                e, d, w = weighted_elements(*shingle_elements(flat[own[0] : own[-1]], own - own[0], k))
                node = batch.column("node").take(pa.array(d + part.start))
                yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), node, pa.array(w)], names=["element", "node", "weight"])

    return texts.select("node", "hashes").mapInArrow(cut, "element long, node binary, weight double")


def shared_weights(texts: DataFrame, k: int) -> DataFrame:
    """(node, s): how much of a node's weight lies in elements that another node has, too."""
    each = stage(node_elements(texts, k), "elements")
    twice = each.groupBy("element").agg(F.count("*").alias("c")).filter("c > 1").select("element")
    return each.join(twice, "element").groupBy("node").agg(F.sum("weight").alias("s"))


def verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold. A hot `a` is dealt out by salt."""
    degrees = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    dealt = pairs.join(degrees, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    right = dealt.join(texts.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b")
    left = degrees.join(texts.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a")
    left = left.select("a", "left", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return similarities(right.join(left, ["a", "salt"]), k).filter(F.col("similarity") >= similarity)


def node_of(tokens: Column, text: Column) -> Column:
    """Digest of the words, or of the text where it has none: texts that agree in it are one node."""
    said = let(tokens, lambda w: F.when(F.size(w) > 0, F.array_join(w, " ")))
    return F.unhex(F.md5(F.coalesce(said, F.concat(F.lit("\0"), text_or_empty(text)))))


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS_PER_BAND,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has a row per row of `docs`: id, h (of its text), node (its words), root (the
    node that stands for its class), class_id, class_size;
    links (a, b, similarity) are the verified pairs of nodes that hold the classes together."""
    keyed = with_row_key(docs, id_col, text_col)
    tokens = keyed.select("id", "h", "text", words(F.col("text")).alias("w"))
    node = node_of(F.col("w"), F.col("text")).alias("node")
    nodes = tokens.select(node, F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"))
    ids = stage(tokens.select("id", "h", node), "node_ids")
    buckets = stage(bucket_rows(nodes, bands, rows, k), "buckets")

    shared = buckets.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("last"), F.count("*").alias("size"))
    shared = shared.filter("least <> last").select("bucket", "size")
    members = stage(buckets.join(shared, "bucket").distinct(), "members")
    # The pivot of a bucket is the member that meets most others over all its buckets: the middle of a group of copies.
    degrees = members.groupBy("node").agg(F.sum("size").alias("degree"))
    pivots = members.join(degrees, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("p"))
    members = members.drop("size").join(pivots.select("bucket", F.col("p.node").alias("pivot")), "bucket")
    members = stage(members, "members")
    texts = texts_of(keyed, ids, stage(members.select("node").distinct(), "member_nodes"))
    stars = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(verified(stage(stars, "stars"), texts, k, similarity), "links")
    roots = components(links)

    # Members beyond the largest component of their bucket: every pair of two components not yet compared,
    # but for pairs that cannot be similar because too much of one of them occurs nowhere else.
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stage(placed, "placed")
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots"))
    largest = largest.filter("roots > 1").select("bucket", F.col("top.root").alias("top"))
    open_rows = stage(placed.join(largest, "bucket").filter("node <> pivot"), "open_rows")
    weights = shared_weights(texts.join(open_rows.select("node").distinct(), "node"), k)
    open_rows = stage(open_rows.join(weights, "node").filter(F.col("s") >= F.col("n") * similarity - 1e-6), "open_rows")
    # A pair that shares several of these buckets is made in the first of them only.
    lists = open_rows.groupBy("node").agg(F.collect_set("bucket").alias("own"))
    open_rows = stage(open_rows.join(lists, "node"), "open_rows")
    x = open_rows.filter("root <> top").select(
        "bucket",
        F.col("node").alias("a"),
        F.col("root").alias("root_a"),
        F.col("n").alias("n_a"),
        F.col("s").alias("s_a"),
        F.col("own").alias("own_a"),
    )
    y = open_rows.select("bucket", F.col("node").alias("b"), "root", "n", "s", "top", "own")
    rest = x.join(y, "bucket").filter(
        (F.col("root_a") != F.col("root"))
        & (F.array_min(F.array_intersect("own", "own_a")) == F.col("bucket"))
        & ((F.col("root") == F.col("top")) | (F.col("a") < F.col("b")))
        & (F.least("s", "s_a") >= (F.col("n") + F.col("n_a")) * (similarity / (1 + similarity)) - 1e-6)
        & (F.least("n", "n_a") >= F.greatest("n", "n_a") * similarity - 1e-6)
    )
    rest = stage(rest.select("a", "b").distinct(), "rest")
    links = stage(links.unionByName(verified(rest, texts, k, similarity)), "links")
    roots = components(links)

    per_node = ids.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classed = per_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classed = stage(classed, "classed")
    classes = classed.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    classed = stage(classed.join(classes, "root").select("node", "root", "class_id", "class_size"), "classes")
    return ids.join(classed, "node").select("id", "h", "node", "root", "class_id", "class_size"), links


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, …) without all but one of each near-duplicate class.

    The row of the smallest id stays; of equal ids the one of the smallest hash over all columns, and
    of rows equal throughout, one.
    """
    with scratch(docs.sparkSession) as keep:
        members, _ = near_classes(docs)
        members = stage(members.select("id", "h", "root"), "classed_rows")
        order = F.struct(F.coalesce(F.col("id").cast("long"), F.lit(2**63 - 1)), "h", "id")
        first = members.groupBy("root").agg(F.min(order).alias("o")).select("o.id", "o.h")
        first = keep(stage(first.select(F.col("id").alias("_id"), F.col("h").alias("_h")), "kept_rows"))
        repeated = members.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.count("*").alias("c")).filter("c > 1")
        repeated = keep(stage(repeated.select("_id", "_h"), "repeated_rows"))
    rows = docs.withColumn("_hash", F.xxhash64(F.lit(7), text_or_empty(F.col("text"))))
    kept = rows.join(first, rows["doc_id"].eqNullSafe(first["_id"]) & (rows["_hash"] == first["_h"]), "left_semi")
    if repeated.isEmpty():
        return kept.drop("_hash")
    again = kept["doc_id"].eqNullSafe(repeated["_id"]) & (kept["_hash"] == repeated["_h"])
    every = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns])
    one = kept.join(repeated, again, "left_semi").groupBy("doc_id", "_hash").agg(F.min_by(F.struct(*docs.columns), every).alias("_row"))
    return kept.join(repeated, again, "left_anti").drop("_hash").unionByName(one.select("_row.*"))


@query("op7_dart_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = near_classes(table(spark, sf_dir, "documents"))
    return members.select(F.col("id").alias("doc_id"), "class_id", "class_size")
