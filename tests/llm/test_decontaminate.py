import hashlib
import random

from pyspark.sql import functions as F

from odd import no_documents, odd_documents, odd_items, words
from querylight.llm.decontaminate import contamination, drop_contaminated


def brute(docs, items, window=13):
    wins = [(i, w[s : s + window]) for i, t in items for w in [words(t)] if w for s in range(max(1, len(w) - window + 1))]
    out = {}
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(i)
        out[key] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def test_random_texts_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "dd", "é"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 8]))) for i in range(12)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    got = contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5
    )
    assert {r["id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in got.collect()} == brute(docs, items, 5)


def test_odd_rows(spark):
    docs, items = odd_documents(spark), odd_items(spark)
    rows = [(r["id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in contamination(docs, items).collect()]
    assert len(rows) == docs.count()
    assert rows.count((1, 14, 6, ("1", "2"))) == 2
    assert (2, 0, 0, ()) in rows and (3, 0, 0, ()) in rows
    long = next(r for r in rows if r[0] == 5)
    assert long[2] == 3000 * 5 and long[3] == ()  # the item without an id marks words and is not listed
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 0, 2, 3, 4, 4, 7, 8]


def test_empty_tables(spark):
    assert contamination(no_documents(spark), odd_items(spark)).count() == 0
    none = contamination(odd_documents(spark), odd_items(spark).limit(0))
    assert none.filter(F.col("n_hit") > 0).count() == 0 and none.count() == 12


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
