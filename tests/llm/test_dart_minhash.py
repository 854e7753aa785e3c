import random
from collections import Counter

import numpy as np

from odd import SF, no_documents, odd_documents, words
from querylight.llm.dart_minhash import dart_signatures, keep_one, near_classes


def shingles(text, k=5):
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter({("", text or ""): 1})


def brute_classes(docs, at_least=0.8):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for e in s:
            holders.setdefault(e, []).append(i)
    for pair in {(a, b) for own in holders.values() for a in own for b in own if a < b}:
        a, b = sets[pair[0]], sets[pair[1]]
        both = sum((a & b).values())
        if both / (sum(a.values()) + sum(b.values()) - both) >= at_least:
            x, y = find(pair[0]), find(pair[1])
            parent[max(x, y)] = min(x, y)
    return [min(docs[j][0] for j in range(len(docs)) if find(j) == find(i)) for i in range(len(docs))]


def test_signatures_agree_as_often_as_weights_do():
    rng = np.random.default_rng(3)
    k = 2000
    elements = rng.integers(1, 2**63, 60).astype(np.uint64)
    left, right = rng.uniform(0.1, 4, 60), rng.uniform(0.1, 4, 60)
    right[:20] = left[:20]
    signatures = dart_signatures(np.tile(elements, 2), np.repeat([0, 1], 60), np.concatenate([left, right]), 2, k)
    true = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    assert abs((signatures[0] == signatures[1]).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5
    assert (signatures > 0).all()


def test_classes_match_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    # A group of near copies with few to many words changed, whose pivot alone does not decide every pair.
    for i in range(60):
        own = list(base)
        for at in rng.sample(range(300), rng.choice([1, 3, 6, 9, 14, 20])):
            own[at] = f"x{i}y{at}"
        docs.append((1000 + i, " ".join(own)))
        if i % 10 == 0:
            docs.append((2000 + i, " ".join([*own[:290], "z"])))
    members, _ = near_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r["id"]: r["class_id"] for r in members.collect()}
    assert got == dict(zip((d for d, _ in docs), brute_classes(docs)))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = near_classes(docs)[0].collect()
    assert len(rows) == 12
    assert {r["id"]: r["class_id"] for r in rows} == {1: 1, 2: 2, 3: 2, None: None, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert [d for d, _ in left] == [0, 1, 2, 4, 4, 5, 7, 8]
    assert keep_one(no_documents(spark)).count() == 0
