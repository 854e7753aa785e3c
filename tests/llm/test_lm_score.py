import math
import zlib
from collections import Counter
import re

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
from odd import LOW, SF, no_documents, odd_documents
from querylight.llm import lm_score
from querylight.session import stage
from querylight.llm.lm_score import CLASSES, END, IDS, AttentionModel, lm_scores

TOKEN = re.compile("[^\x20\x09-\x0d]+")


def test_counts_and_base_match_brute_force(spark):
    docs = [(r[0], TOKEN.findall(r[1].translate(LOW))) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    learned = [w for d, w in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(x for w in learned for x in w)
    n, v = sum(counts.values()) + len(learned), len(counts) + 1
    rows = {r["doc_id"]: r for r in entrypoint.queries()["op2_lm_scoring"](spark, SF).collect()}
    assert len(rows) == len(docs)
    log = lambda c: math.log10((c + 1) / (n + v + 1))
    for d, w in docs:
        r = rows[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 7 == 2)
        assert (r["n_tokens"], r["train_tokens"]) == (len(w) + 1, n)
        assert r["n_known"] == sum(counts[x] > 0 for x in w) + 1
        assert math.isclose(r["base_score"], sum(log(counts[x]) for x in w) + log(len(learned)), rel_tol=1e-9)
        assert r["score"] < 0


def model(seed=0):
    rng = np.random.default_rng(seed)
    unigrams = rng.integers(0, 5, IDS).astype(float)
    pairs = np.unique(rng.integers(0, IDS * IDS, 2000))
    base = rng.normal(size=(IDS + 1, CLASSES))
    out = AttentionModel.start(unigrams, rng.integers(0, CLASSES, IDS), base, pairs, np.ones(len(pairs), np.float32))
    out.bias[:] = rng.normal(size=len(out.bias))
    return out


def test_next_ids_sum_to_one():
    m = model()
    ids = np.array([[END, 5, 77, 900]])
    total = 0.0
    every = np.arange(IDS)
    within = np.exp(m.inside(np.full(IDS, 900), every))
    for c in range(CLASSES):
        some = every[m.class_of == c]
        targets = ids.copy()
        targets[0, 3] = some[0]
        chance = np.exp(m.window_scores(ids, targets, np.zeros(ids.shape, bool), 0)[0, 3])
        assert math.isclose(within[some].sum(), 1, rel_tol=1e-4)
        total += chance
    assert math.isclose(total, 1, rel_tol=1e-4)


def test_ids_and_word_borders_sum_to_one():
    m = model()
    ids, every = np.array([[END, 5, 77, 900]]), np.arange(IDS)
    total = 0.0
    for begins in (False, True):
        last = np.full(IDS, lm_score.WORD_START if begins else 900)
        within = np.exp(m.inside(last, every))
        marks = np.array([[True, True, False, begins]])
        border = np.exp(m.borders(np.array([900]), np.array([begins]))[0])
        for c in range(CLASSES):
            some = every[m.class_of == c]
            targets = ids.copy()
            targets[0, 3] = some[0]
            total += border * np.exp(m.window_scores(ids, targets, marks, 0)[0, 3]) * within[some].sum()
    assert math.isclose(total, 1, rel_tol=1e-4)


def naive_score(m, words):
    """The log probability of a text, id by id, with plain loops over the context."""
    own = [lm_score.word_ids(lm_score.pa.array([w]))[0].tolist() for w in words]
    ids = [END, *[i for w in own for i in w], END]
    begins = [True, *[n == 0 for w in own for n in range(len(w))], True]
    total = 0.0
    for t in range(1, len(ids)):
        start = 0 if t <= 32 else 24 * ((t - 9) // 24)
        seen, last = ids[start:t], ids[t - 1]
        rows = [m.row_of[i] for i in seen]
        q = m.q[rows[-1]]
        weights = [math.exp(float(q @ m.k[r]) / math.sqrt(lm_score.WIDTH) + float(m.bias[len(rows) - 1 - j])) for j, r in enumerate(rows)]
        mixed = sum(w * m.v[r].astype(float) for w, r in zip(weights, rows)) / sum(weights)
        row = lm_score.WORD_START if begins[t] else last
        logits = m.base[row] + mixed @ m.u
        kind = m.class_of[ids[t]]
        total += logits[kind] - math.log(np.exp(logits.astype(float)).sum())
        n = dict(zip(m.pairs.tolist(), m.pair_n.tolist())).get(row * IDS + ids[t], 0)
        total += math.log((n + 2 * m.in_class[ids[t]]) / (m.pair_sums[row, kind] + 2))
        total += math.log(m.word_ends[last] if begins[t] else 1 - m.word_ends[last])
    return total / math.log(10)


def test_scores_match_a_naive_pass(spark):
    m = model(7)
    m.bias[:] = 0.1
    texts = ["", "one", "a few words of no great length", " ".join(f"word{i % 13}s unlikely" for i in range(40))]
    keyed = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("h", F.lit(0).cast("long"))
    common = (lm_score.pa.array(["one"]), np.array([3.0]))
    got = {r["id"]: r["score"] for r in lm_score.scored(keyed, m, common).collect()}
    for i, text in enumerate(texts):
        assert math.isclose(got[i], naive_score(m, text.split()), rel_tol=1e-4)


def test_words_at_once_does_not_change_scores(spark, monkeypatch):
    m = model(8)
    texts = [" ".join(f"w{i * j % 17}" for j in range(i * 3)) for i in range(9)]
    keyed = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("h", F.lit(0).cast("long")).coalesce(1)
    common = (lm_score.pa.array(["w0"]), np.array([3.0]))
    score = lambda: {r["id"]: r["score"] for r in lm_score.scored(keyed, m, common).collect()}
    whole = score()
    monkeypatch.setattr(lm_score, "WORDS_AT_ONCE", 10)
    assert all(math.isclose(whole[i], s, rel_tol=1e-5) for i, s in score().items())


def test_windows_score_each_id_once_and_look_back_only():
    m = model(1)
    rng = np.random.default_rng(2)
    sizes = np.array([2, 3, 33, 34, 57, 100])
    ids = rng.integers(0, IDS, sizes.sum())
    begins, inside = rng.random(len(ids)) < 0.3, rng.normal(size=len(ids))
    got = m.text_scores(ids, begins, inside, sizes)
    offset = 0
    for size, score in zip(sizes, got):
        own = slice(offset, offset + size)
        x, b, i = ids[own], begins[own], inside[own]
        want = 0.0
        for t in range(size - 1):
            # the window that scores place t
            start = 0 if t < 32 else 24 * ((t - 8) // 24)
            one = m.window_scores(x[None, start : t + 1], x[None, start + 1 : t + 2], b[None, start + 1 : t + 2], 0)
            want += one[0, -1] + i[t + 1]
        assert math.isclose(score, want, rel_tol=1e-4, abs_tol=1e-2)
        offset += size


def test_fitting_lowers_the_cost():
    m = model(3)
    m.base[:] = 0
    rng = np.random.default_rng(4)
    ids = np.repeat(rng.integers(0, 50, (256, 11)), 3, axis=1)  # each id thrice
    before = m.window_scores(ids[:, :-1], ids[:, 1:], np.zeros((256, 32), bool), 0).mean()
    m.fit(ids, np.zeros(ids.shape, bool), epochs=60)
    assert m.window_scores(ids[:, :-1], ids[:, 1:], np.zeros((256, 32), bool), 0).mean() > before + 0.2


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "EPOCHS", 1)
    docs = odd_documents(spark)
    held = F.coalesce(F.col("id") == 7, F.lit(False))
    rows = lm_scores(docs, held, common_words=3).collect()
    assert len(rows) == 12
    one = [r for r in rows if r["id"] == 1]
    assert one[0] == one[1]
    assert {r["n_tokens"] for r in rows if r["id"] in (2, 3)} == {1}
    assert lm_scores(no_documents(spark), held).count() == 0
    untaught = lm_scores(docs.filter("doc_id = 7"), held).collect()[0]
    assert untaught["train_tokens"] == 0 and untaught["n_known"] == 0 and untaught["base_score"] == 0


def test_every_id_is_fitted_once(spark):
    texts = [" ".join(f"word{i * j % 50} next" for j in range(i * 7)) for i in range(12)] + ["", "one"]
    keyed = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("h", F.xxhash64("text")).repartition(3)
    m = model(5)
    fixed = spark.sparkContext.broadcast(m)
    parts = [lm_score.slice_gradients(keyed, fixed, m.weights(), i, 4) for i in range(4)]
    want, total = 0, 0.0
    for text in texts:
        row = lm_score.Texts(lm_score.pa.array([text.split()], lm_score.pa.list_(lm_score.pa.string())))
        assert len(row.ids) == len(lm_score.word_ids(row.words.take(row.codes))[0]) + 2
        want += len(row.ids) - 1
        for ids, begins in row.windows():
            total = total + m.gradients(ids, begins)[1]
    assert sum(n for n, _ in parts) == want
    assert np.allclose(sum(d for _, d in parts), total, rtol=1e-3, atol=1e-3)


def test_weights_follow_texts_outside_the_passages(spark):
    # 40 words each, so a passage of 16 holds less than half; only one text may give one.
    docs = [(i, " ".join(f"{'abcdefgh'[(i + j) % 8]}x" for j in range(40))) for i in range(30)]
    keyed = spark.createDataFrame(docs, "id long, text string").withColumn("h", F.xxhash64("text"))
    m = model(6)
    before = m.weights()
    lm_score.fit_on_all(keyed, m, rounds=4)
    seen = lm_score.Texts(lm_score.pa.array([docs[3][1].split()]))
    rows = np.unique(m.row_of[seen.ids])
    assert (np.abs(m.v[rows] - m.with_weights(before).v[rows]).max(axis=1) > 0).all()


def test_pairs_beyond_the_most_frequent_count(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "EPOCHS", 1)
    monkeypatch.setattr(lm_score, "ROUNDS", 2)
    docs = stage(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40))
    docs = docs.union(docs.filter("doc_id % 5 = 0"))  # rows that agree in id and text
    held = F.col("id") % 4 == 0
    scores = lambda: sorted((r["id"], r["score"]) for r in lm_scores(docs, held).select("id", "score").collect())
    every = scores()
    monkeypatch.setattr(lm_score, "PAIRS", 100)
    few = scores()
    assert len(every) == len(few)
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-4) for a, b in zip(every, few))


def test_fitting_and_scoring_read_written_ids_not_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "EPOCHS", 1)
    monkeypatch.setattr(lm_score, "ROUNDS", 2)
    read, gradients = [], lm_score.slice_gradients
    monkeypatch.setattr(lm_score, "slice_gradients", lambda keyed, *a, **b: read.append(keyed.columns) or gradients(keyed, *a, **b))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(30)
    assert lm_scores(docs, F.col("id") % 4 == 0).count() == 30
    assert len(read) == 2 and all("text" not in columns and {"ids", "slice"} <= set(columns) for columns in read)


def test_words_in_arrow_are_those_of_spark(spark):
    texts = [None, "", " ", "\t a\x0bB\x0c\r\nc ", "x\x1cy\x85z Ä É", "  Ab\x00c  d", "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select(lm_score.words_of(F.col("text")).alias("w"), "i")
    want = [r["w"] for r in rows.orderBy("i").collect()]
    assert lm_score.split_words(lm_score.pa.array(texts, lm_score.pa.string())).to_pylist() == want


def test_words_to_send_are_picked_without_sorting_all(spark, monkeypatch):
    rows = [(f"w{i}", c) for i, c in enumerate([9, 7, 7, 5, 5, 5, 1, 1, 1, 1])]
    counts = spark.createDataFrame(rows, "word string, c long")
    plan = lambda df: df._jdf.queryExecution().toString()
    for limit, want in ((1, 1), (2, 1), (3, 3), (5, 3), (6, 6), (9, 6), (10, 10), (50, 10)):
        top = lm_score.most_frequent(counts, limit)
        assert sorted(r["c"] for r in top.collect()) == sorted(c for _, c in rows)[len(rows) - want :]
        assert "Sort" not in plan(top) and "Limit" not in plan(top)
    monkeypatch.setattr(lm_score, "COUNT_BINS", 5)
    assert sorted(r["word"] for r in lm_score.most_frequent(counts, 2).collect()) == ["w0", "w1"]
    assert lm_score.most_frequent(counts, 6).count() == 6
    assert lm_score.most_frequent(counts.limit(0), 6).count() == 0


def test_common_words_are_cut_into_ids_once(spark):
    m = model(9)
    texts = ["one two three", "two odd one", "", "zebras"]
    keyed = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("h", F.lit(0).cast("long")).coalesce(1)
    rows = lambda common: {r["id"]: r for r in lm_score.tokenised(keyed, m, common).collect()}
    plain, told = rows(lm_score.NO_WORDS), rows((lm_score.pa.array(["one", "two", "unused"]), np.array([3.0, 9.0, 1.0])))
    for i, text in enumerate(texts):
        assert all(plain[i][c] == told[i][c] for c in ("n_tokens", "ids", "begins", "open")) and math.isclose(plain[i]["fixed"], told[i]["fixed"])
        assert told[i]["rare"] == [w for w in text.split() if w not in ("one", "two")] and plain[i]["rare"] == text.split()
    a, b = (lm_score.word_table(lm_score.pa.array(w), m, True) for w in (["one", "unlikely"], ["zebras", "x"]))
    both = lm_score.word_table(lm_score.pa.array(["one", "unlikely", "zebras", "x"]), m, True)
    assert all(np.array_equal(x, y) for x, y in zip(lm_score.with_words(a, b), both))
