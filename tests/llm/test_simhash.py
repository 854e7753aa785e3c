import hashlib
import random

from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
from odd import SF, no_documents, odd_documents
from querylight.llm.simhash import block_masks, document_fingerprints, near_fingerprints


def test_near_table_finds_all_within_the_radius(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(150)]
    for v in list(values[:60]):
        for flips in (1, 2, 3, 4, 5):
            for at in rng.sample(range(64), flips):
                v ^= 1 << at
            values.append(v)
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = near_fingerprints(frame.select(F.col("fingerprint").alias("q")), frame).collect()
    want = {(a, b) for a in signed for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert len(got) == len(want) and {(r["q"], r["fingerprint"]) for r in got} == want
    assert len(block_masks()) == 20


def test_edits_lie_nearer_than_neighbours(spark):
    rows = {r["doc_id"]: r for r in entrypoint.queries()["op6_simhash"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    for here, after in zip(docs, [*docs[1:], docs[0]]):
        text, q = here["text"], len(here["text"]) // 4
        edited = text[: len(text) - q] + after["text"][:q]
        assert rows[here["doc_id"]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[here["doc_id"]]["n_chars"] == len(text)
    bits = {d: int(r["fingerprint"], 16) for d, r in rows.items()}
    for here, after in zip(docs, [*docs[1:], docs[0]]):
        row = rows[here["doc_id"]]
        assert row["near_next"] == 1 - (bits[here["doc_id"]] ^ bits[after["doc_id"]]).bit_count() / 64
    for d, r in rows.items():
        near = sum((bits[d] ^ b).bit_count() <= 3 for b in bits.values()) if d % 100 == 0 else None
        assert r["n_near"] == near
    edited = sum(r["near_edited"] for r in rows.values()) / len(rows)
    assert edited > sum(r["near_next"] for r in rows.values()) / len(rows) + 0.15


def test_equal_texts_have_equal_fingerprints(spark):
    rows = document_fingerprints(odd_documents(spark)).collect()
    assert len(rows) == 12
    prints = {(r["id"], r["n_chars"]): r["fingerprint"] for r in rows}
    assert prints[(2, 0)] == prints[(3, 0)]
    assert document_fingerprints(no_documents(spark)).count() == 0
    one = document_fingerprints(odd_documents(spark).filter("doc_id = 8")).collect()[0]
    assert one["near_edited"] == 1 and one["near_next"] == 1
