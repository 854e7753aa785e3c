import hashlib

import numpy as np
import pytest

import __spark_entry__ as entrypoint
from odd import SF, no_documents, odd_documents
from querylight.llm import repeat_index
from querylight.llm.repeat_index import RunIndex, remove_repeats


def brute(docs, length=100):
    seen, out = {}, {}
    for key, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen[data[s : s + length]] = True
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("few, most", [(200, 8000), (2, 8000), (2, 2)])
def test_query_matches_brute_force(spark, monkeypatch, few, most):
    monkeypatch.setattr(repeat_index, "FEW", few)
    monkeypatch.setattr(repeat_index, "BUCKET_SEGMENTS", most)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = entrypoint.queries()["op8_repeat_index"](spark, SF).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute(docs)


def test_long_texts_are_cut_into_runs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = "".join(chr(97 + c) for c in rng.integers(0, 20, 3000))
    docs = [(1, base), (2, base[500:2500] + "é" * 150), (3, "z" * 700 + base[:130]), (4, base[:99])]
    monkeypatch.setattr(repeat_index, "CHUNK_BYTES", 257)
    got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    have = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got}
    assert have == brute(docs)


def test_run_index_is_smaller_than_a_repetitive_text():
    text = np.concatenate([np.tile(np.arange(1, 40), 50), [0]])
    index = RunIndex.build(text)
    assert len(index.heads) < len(text) / 10 and index.lengths.sum() == len(text)
    assert (index.first_places(30)[: 39 * 48] == np.tile(np.arange(39), 48)).all()


def test_odd_rows(spark):
    rows = [(r["id"], r["n_bytes"], r["n_removed"]) for r in remove_repeats(odd_documents(spark)).collect()]
    assert len(rows) == 12
    assert (2, 0, 0) in rows and (3, 0, 0) in rows and (8, 1, 0) in rows
    assert [r for r in rows if r[0] == 6][0][2] > 200_000
    assert remove_repeats(no_documents(spark)).count() == 0
