import numpy as np
import pytest

from querylight.functions.vectors import softmax, top_k
from querylight.operators import balance, routing

E, D, G, K = 6, 3, 2, 2


@pytest.fixture(scope="module")
def logits():
    rng = np.random.default_rng(4)
    return {(s, p): (rng.normal(size=E), rng.normal(size=D)) for s in range(4) for p in range(5)}


@pytest.fixture(scope="module")
def rows(spark, logits):
    data = [(s, p, 1 if p < 4 else 0, e.tolist(), d.tolist()) for (s, p), (e, d) in logits.items()]
    return spark.createDataFrame(
        data, "seq long, pos long, mask int, expert_logits array<double>, dialect_logits array<double>"
    )


def soft(v):
    x = np.exp(v - v.max())
    return x / x.sum()


def best(w, k=K):
    return sorted(range(len(w)), key=lambda i: (-w[i], i))[:k]


def by_token(df, column):
    return {(r["seq"], r["pos"]): r[column] for r in df.collect()}


def test_soft_routing(rows, logits):
    chosen = by_token(rows.select("seq", "pos", top_k(routing.soft_weights(G), K).alias("c")), "c")
    for key, (e, d) in logits.items():
        w = soft(e) * np.repeat(soft(d), G)
        assert [c["e"] for c in chosen[key]] == best(w)
        assert [c["w"] for c in chosen[key]] == pytest.approx([w[i] for i in best(w)])


def test_group_limited(rows, logits):
    picked = by_token(rows.select("seq", "pos", routing.group_limited(softmax("expert_logits"), D, G, 1, K).alias("c")), "c")
    for key, (e, _) in logits.items():
        group = int(np.argmax(soft(e))) // G
        assert {c["e"] for c in picked[key]} == {group * G, group * G + 1}


def test_hard_group_and_labels(rows, logits):
    got = by_token(routing.hard_group(rows, D, G, K), "group")
    labels = {r["seq"]: (r["label"], r["group_size"]) for r in routing.sequence_groups(rows, "dialect_logits", D).collect()}
    for (s, p), group in got.items():
        want = int(np.argmax(np.mean([d for (t, _), (_, d) in logits.items() if t == s], axis=0)))
        assert group == want == labels[s][0]
    assert sum(size for label, size in set(labels.values())) == 4


def test_renormalised_weights_sum_to_one(rows):
    chosen = rows.select(routing.renormalised(top_k(softmax("expert_logits"), K)).alias("c")).collect()
    assert all(sum(c["w"] for c in r["c"]) == pytest.approx(1.0) for r in chosen)


def test_balance_losses(rows, logits):
    scores = np.array([soft(e) for e, _ in logits.values()])
    hits = np.zeros((len(scores), E))
    for i, s in enumerate(scores):
        hits[i, best(s)] = 1
    want = E * (hits.mean(0) * scores.mean(0)).sum()
    assert balance.balance_loss(rows, E, K).first()["loss"] == pytest.approx(want)
    kept = np.array([p < 4 for _, p in logits])
    masked = E * (hits[kept].mean(0) * scores[kept].mean(0)).sum()
    assert balance.balance_loss_masked(rows, E, K).first()["loss"] == pytest.approx(masked)
    seqs = np.array([s for s, _ in logits])
    per_seq = [(hits[seqs == s].sum(0) * E / (5 * K) * scores[seqs == s].mean(0)).sum() for s in range(4)]
    both = balance.balance_loss_seq(rows, E, K, 0.1).first()
    assert both["seq_loss"] == pytest.approx(0.1 * np.mean(per_seq))
    assert both["global_loss"] == pytest.approx(0.1 * E * (hits.mean(0) / K * scores.mean(0)).sum())


def test_dialect_losses_skip_batches_with_unknown_ids(spark, rows, logits):
    labels = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 1, None), (3, 1, 0)], "seq long, batch long, label int")
    got = balance.dialect_losses(rows, labels, D, 0.1).collect()
    assert [r["batch"] for r in got] == [0]
    means = [np.mean([d for (t, _), (_, d) in logits.items() if t == s], axis=0) for s in (0, 1)]
    logp = [np.log(soft(m)) for m in means]
    assert got[0]["cross_entropy"] == pytest.approx(-(logp[0][1] + logp[1][2]) / 2)
    smooth = [-(np.eye(D)[y] * 0.9 + 0.1 / D) @ lp for y, lp in zip((1, 2), logp)]
    assert got[0]["smoothed"] == pytest.approx(np.mean(smooth))


def test_dispatch_plan(spark, rows):
    choice = routing.long_choice(rows, top_k(softmax("expert_logits"), K))
    plan = routing.dispatch_plan(choice).orderBy("e").collect()
    assert plan[0]["start_at"] == 0 and plan[-1]["end_at"] == 20 * K
    assert all(a["end_at"] == b["start_at"] for a, b in zip(plan, plan[1:]))


def test_assemble_log(spark):
    steps = spark.createDataFrame([(0, 1, s, a) for s, n in ((0, 3), (1, 1), (2, 1)) for a in range(n)], "layer int, seq long, step int, at long")
    assert [r["pos"] for r in routing.assemble_log(steps).orderBy("pos").collect()] == [0, 1, 2, 3, 4]
