import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entrypoint
from odd import SF, no_documents, odd_documents
from querylight.llm.exact_fill import SumIndex, best_fit, exact_fills, fill_sequences, pack_whole


@given(st.lists(st.integers(1, 12), max_size=10), st.integers(1, 40), st.lists(st.integers(1, 12), max_size=4))
@settings(max_examples=300, deadline=None)
def test_close_finds_every_exact_sum(lengths, gap, gone):
    index = SumIndex(np.bincount(lengths, minlength=13))
    left = Counter(lengths)
    for x in gone:
        if left[x]:
            index.use(x, 1)
            left[x] -= 1
    found = index.close(gap, {})
    have = [x for x in left if left[x] > 0]
    possible = [c for k in (1, 2, 3) for c in combinations_with_replacement(have, k) if sum(c) == gap and all(left[x] >= n for x, n in Counter(c).items())]
    assert bool(found) == bool(possible)
    if found:
        assert sum(found) == gap and len(found) == len(possible[0])
        assert all(left[x] >= n for x, n in Counter(found).items())


def one_by_one(lengths, window):
    """Plain best fit in decreasing order."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fitting = [b for b in bins if sum(b) + x <= window]
        if fitting:
            max(fitting, key=sum).append(x)
        else:
            bins.append([x])
    return bins


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=200, deadline=None)
def test_fills_hold_every_piece(lengths):
    counts = np.bincount(lengths, minlength=41)
    fills = fill_sequences(counts, 40)
    held = Counter()
    for times, used in fills:
        assert times > 0 and sum(x * n for x, n in used) <= 40
        for x, n in used:
            held[x] += times * n
    assert held == Counter(lengths)
    exact, _ = exact_fills(counts, 40)
    assert all(sum(x * n for x, n in used) == 40 for _, used in exact)
    assert sum(t for t, _ in best_fit(counts, 40)) == len(one_by_one(lengths, 40))


def check(rows, docs):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for key, text in docs:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 or min(len(ids), 1024)
        starts = [0, *range(first, len(ids), 1024)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((key, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    order = lambda row: tuple((x is not None, x) for x in row)
    assert sorted(got, key=order) == sorted(want, key=order)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_query_covers_every_token_once(spark):
    rows = entrypoint.queries()["op11_best_fit_packing"](spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    used = check(rows, docs)
    lengths = [r["length"] for r in rows]
    assert used <= len(one_by_one(lengths, 1024))
    assert used <= -(-sum(lengths) // 1024) + 1


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    special = spark.createDataFrame([(9, "a <|endoftext|> b"), (10, "  \t\n  é ü 𝔘")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(special)
    check(pack_whole(both).collect(), [tuple(r) for r in both.collect()])
    check(pack_whole(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert pack_whole(no_documents(spark)).count() == 0
