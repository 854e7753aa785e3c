"""Plain-Python statements of what the comparisons mean, for small inputs."""

from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F


def cells_frame(spark, tables):
    """`{pair_id: (gold_rows, pred_rows)}` of cell texts to a cell table and a pair table."""
    rows = [
        (pair, side, i, j, cell)
        for pair, both in tables.items()
        for side, table in zip(("gold", "pred"), both)
        for i, row in enumerate(table)
        for j, cell in enumerate(row)
    ]
    cells = spark.createDataFrame(rows, "pair_id long, side string, row_idx long, col_idx int, cell string")
    pairs = spark.createDataFrame([(p,) for p in tables], "pair_id long")
    return cells, pairs


def verdict_map(df, column):
    return {r["pair_id"]: r[column] for r in df.select("pair_id", column).collect()}


def brute_equal(gold, pred, ordered):
    if not gold and not pred:
        return True
    if len(gold) != len(pred) or len(gold[0]) != len(pred[0]):
        return False
    for perm in permutations(range(len(gold[0]))):
        moved = [tuple(r[i] for i in perm) for r in pred]
        if moved == gold if ordered else Counter(moved) == Counter(gold):
            return True
    return False


def brute_subset(gold, pred, ordered):
    """First unused predicted column of equal values per gold column, then distinct matched rows."""
    if not gold:
        return False
    width = len(pred[0]) if pred else 0
    taken = []
    for j in range(len(gold[0])):
        want = sorted(r[j] for r in gold)
        hit = next((k for k in range(width) if k not in taken and sorted(r[k] for r in pred) == want), None)
        if hit is None:
            return False
        taken.append(hit)
    left = list(dict.fromkeys(gold))
    right = list(dict.fromkeys(tuple(r[k] for k in taken) for r in pred))
    return left == right if ordered else set(left) == set(right)


def brute_align(gold, pred):
    """Greedy alignment score of two result tables."""
    left, right = [set(r) for r in gold], [set(r) for r in pred]
    short, long = (right, left) if len(left) > len(right) else (left, right)
    for i, row in enumerate(short):
        scores = [len(row & long[j]) / len(row | long[j]) for j in range(i, len(long))]
        j = i + scores.index(max(scores))
        long[i], long[j] = long[j], long[i]
    one = {(i, v) for i, r in enumerate(short) for v in r}
    two = {(i, v) for i, r in enumerate(long) for v in r}
    return len(one & two) / len(one | two) if one | two else 1.0


def random_tables(rng, n, values=("str:a", "str:b", "num:1.0"), max_cols=4, max_rows=4):
    """Pairs of small tables; the second is a shuffle of the first, sometimes disturbed."""
    out = {}
    for pair in range(n):
        cols, rows = rng.randint(1, max_cols), rng.randint(0, max_rows)
        gold = [tuple(rng.choice(values) for _ in range(cols)) for _ in range(rows)]
        perm = rng.sample(range(cols), cols)
        pred = [tuple(r[i] for i in perm) for r in gold]
        if rng.random() < 0.5:
            rng.shuffle(pred)
        kind = rng.random()
        if kind < 0.3 and pred:
            i, j = rng.randrange(rows), rng.randrange(cols)
            row = list(pred[i])
            row[j] = rng.choice(values)
            pred[i] = tuple(row)
        elif kind < 0.4 and pred:
            pred.pop()
        elif kind < 0.5:
            pred = [(*r, rng.choice(values)) for r in pred]
        out[pair] = (gold, pred)
    return out
