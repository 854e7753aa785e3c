import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entrypoint
from odd import SF, no_documents, odd_documents
from querylight.llm.packing import Seats, best_fill, fill_windows, pack_documents


@given(st.lists(st.integers(1, 12), max_size=12), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_best_fill_reaches_the_largest_sum(lengths, room):
    counts = np.bincount(lengths, minlength=13)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    used = best_fill(counts, room)
    assert sum(n * k for n, k in used) == max(sums)
    assert all(k <= counts[n] for n, k in used)


def test_every_piece_has_its_own_seat():
    rng = random.Random(1)
    counts = np.zeros(65, dtype=np.int64)
    for _ in range(500):
        counts[rng.randint(1, 64)] += 1
    fills = fill_windows(counts, 64)
    seats, taken = Seats(fills), set()
    for n in range(1, 65):
        sequence, offset = seats.find(np.full(counts[n], n), np.arange(counts[n]))
        for s, o in zip(sequence, offset):
            assert o + n <= 64
            places = {(int(s), int(o) + i) for i in range(n)}
            assert not places & taken
            taken |= places
    windows = sum(t for t, _ in fills)
    assert windows <= 1.05 * int((counts * np.arange(65)).sum()) / 64


def check(pieces, docs):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for key, text in docs:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want.append((key, s, len(part), zlib.crc32(part.tobytes()), len(ids)))
    got = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces]
    order = lambda row: tuple((x is not None, x) for x in row)
    assert sorted(got, key=order) == sorted(want, key=order)
    sequences = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_query_covers_every_token_once(spark):
    pieces = entrypoint.queries()["op10_packing"](spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    windows = check(pieces, docs)
    assert windows <= sum(r["length"] for r in pieces) / 2048 * 1.02 + 1


def test_odd_rows(spark):
    docs = odd_documents(spark)
    special = spark.createDataFrame([(9, "a <|endoftext|> b"), (10, "  \t\n  é ü 𝔘")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(special)
    pieces = pack_documents(both).collect()
    check(pieces, [tuple(r) for r in both.collect()])
    assert pack_documents(no_documents(spark)).count() == 0
