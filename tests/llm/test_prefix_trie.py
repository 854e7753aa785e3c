import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entrypoint
from odd import SF
from querylight.llm import prefix_trie as ops

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_order(row):
    role, text = row[2] or "", row[3] or ""
    digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    return (row[1] is not None, row[1] or 0, digest)


def brute(rows):
    own = {}
    for row in sorted((r for r in rows if r[0] is not None), key=turn_order):
        own.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    out = []
    for prefix, who in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        inner = {p[:-1] for p in members if p}
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        kids = sum(len(p) == len(prefix) + 1 for p in below)
        done = ",".join(map(str, sorted(ends.get(prefix, []))))
        up = min(members[prefix[:-1]]) if prefix else None
        leaves = sum(p not in inner for p in below)
        out.append((min(who), len(prefix), up, len(who), kids, leaves, saved, hashlib.sha256(done.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: r[:2])


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def random_rows(seed, n, most):
    rng = random.Random(seed)
    words = ["a", "b c", "", "d e  f", None]
    return [(c, t, rng.choice(["user", "bot", None]), rng.choice(words)) for c in rng.sample(range(-40, 4 * n), n) for t in range(rng.randint(1, most))]


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(entrypoint.queries()["op13_prefix_trie"](spark, SF)) == brute(rows)


@pytest.mark.parametrize("large, bins", [(4, 8), (20, 1000), (10**6, 16)])
def test_split_by_joins_and_in_bins(spark, large, bins):
    rows = random_rows(1, 60, 6)
    # A hot group of copies, and one very long conversation with another that leaves it half way.
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(40) for t in range(5)]
    rows += [(2000 + c, t, "user", f"long {t}" if t < 60 else f"long {t} {c}") for c in (0, 1) for t in range(120)]
    assert result(ops.prefix_trie(frame(spark, rows), large, bins)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", "x y"), (1, 0, "user", "x y"), (None, 0, "user", "lost"),
        (20, 0, "user", "word " * 50000), (21, 0, "user", "one"), (21, 1, "bot", "two"), (7, 5, "user", " \t"), (-3, 1, "user", "q"),
    ]
    rows += [(c, 0, "user", "only") for c in range(40, 60)]
    docs = frame(spark, rows).selectExpr("*", "'x' as depth", "1 as a", "2 as h", "3 as words", "4 as top", "5 as len", "6 as conv")
    got = result(ops.prefix_trie(docs))
    assert got == brute(rows)
    assert result(ops.prefix_trie(docs.limit(0))) == []
    assert result(ops.prefix_trie(docs.filter("conv_id is null"))) == []


def test_ids_are_hashed_across_parts(spark, monkeypatch):
    monkeypatch.setattr(ops, "IDS_AT_ONCE", 3)
    rows = [(c, t, "user", f"{t} {c % 3 if t else 0}") for c in range(0, 400, 20) for t in range(4)]
    assert result(ops.prefix_trie(frame(spark, rows))) == brute(rows)


@given(st.lists(st.integers(0, 10**6), max_size=60), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_centroid_sums(picks, narrow):
    parent = np.array([-1 if not i or not p % 7 else max(i - 1 - p % (narrow * 3), 0) for i, p in enumerate(picks)], dtype=np.int64)
    m = len(parent)
    depth, weight = np.zeros(m, dtype=np.int64), np.ones(m, dtype=np.int64)
    values = np.array([[p % 5, p % 11] for p in picks], dtype=np.int64).reshape(m, 2)
    for i in range(m):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
    want = values.copy()
    for i in range(m - 1, -1, -1):
        if parent[i] >= 0:
            want[parent[i]] += want[i]
            weight[parent[i]] += weight[i]
    assert np.array_equal(ops.centroid_sums(parent, depth, weight, values), want)
