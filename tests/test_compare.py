import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import brute_align, brute_equal, brute_subset, cells_frame, random_tables, verdict_map
from querylight.operators import frames, match, replay, similarity, verdicts
from querylight.operators.cells import canonical_cell, column_prints, result_rows


@pytest.fixture(scope="module")
def tables():
    return random_tables(random.Random(5), 400)


@pytest.mark.parametrize("ordered", [False, True])
def test_result_eq_agrees_with_all_permutations(spark, tables, ordered):
    cells, pairs = cells_frame(spark, tables)
    got = verdict_map(match.result_eq(cells, pairs, ordered=ordered, beam=2), "match")
    assert got == {p: brute_equal(g, q, ordered) for p, (g, q) in tables.items()}
    assert sum(got.values()) > 100


def test_result_eq_symmetric_tables(spark):
    """All columns hold equal bags: the search must find an order, or see that there is none."""
    n = 6
    eye = [tuple("num:1.0" if i == j else "num:0.0" for j in range(n)) for i in range(n)]
    shuffled = [tuple(r[k] for k in (3, 1, 5, 0, 2, 4)) for r in reversed(eye)]
    two_cycles = [
        tuple("num:1.0" if j // 3 == i // 3 and j != i else "num:0.0" for j in range(n)) for i in range(n)
    ]
    one_cycle = [tuple("num:1.0" if j in (i, (i + 1) % n) else "num:0.0" for j in range(n)) for i in range(n)]
    given = {
        1: (eye, shuffled),
        2: (two_cycles, one_cycle),
        3: (one_cycle, [tuple(r[k] for k in (2, 4, 0, 5, 1, 3)) for r in one_cycle]),
        4: ([("str:x",) * n] * 3, [("str:x",) * n] * 3),
    }
    cells, pairs = cells_frame(spark, given)
    got = verdict_map(match.result_eq(cells, pairs, beam=200), "match")
    assert got == {p: brute_equal(g, q, False) for p, (g, q) in given.items()} == {1: True, 2: False, 3: True, 4: True}


def test_one_pair_with_most_of_the_rows(spark):
    """A large result beside many small ones: equal but for column and row order, then with one cell changed."""
    n = 20000
    ids = spark.range(n)
    text = F.concat(F.lit("str:"), (F.col("id") % 7).cast("string"))
    number = F.concat(F.lit("num:"), F.col("id").cast("double").cast("string"))

    def side(pair, name, place, columns):
        cells = F.posexplode(F.array(*columns)).alias("col_idx", "cell")
        return ids.select(F.lit(pair).cast("long").alias("pair_id"), F.lit(name).alias("side"), place.alias("row_idx"), cells)

    changed = F.when(F.col("id") == 77, F.lit("num:0.5")).otherwise(number)
    parts = [
        side(1, "gold", F.col("id"), [text, number]), side(1, "pred", n - 1 - F.col("id"), [number, text]),
        side(2, "gold", F.col("id"), [text, number]), side(2, "pred", F.col("id"), [changed, text]),
    ]
    cells, pairs = cells_frame(spark, {p: ([("str:a",)], [("str:a",)]) for p in range(3, 50)})
    for part in parts:
        cells = cells.unionByName(part)
    pairs = pairs.union(spark.createDataFrame([(1,), (2,)], "pair_id long"))
    assert [p for p, ok in verdict_map(match.result_eq(cells, pairs), "match").items() if not ok] == [2]
    in_order = verdict_map(match.result_eq(cells, pairs, ordered=True), "match")
    assert sorted(p for p, ok in in_order.items() if not ok) == [1, 2]
    subset = verdict_map(frames.subset_match(cells, pairs, ordered=True), "subset")
    assert sorted(p for p, ok in subset.items() if not ok) == [1, 2]
    assert verdict_map(frames.subset_match(cells, pairs), "subset")[1] is True


def test_bag_and_quick_reject(spark):
    a, b = ("str:a", "str:b"), ("str:b", "str:a")
    given = {1: ([a, b], [b, a]), 2: ([a, a], [a]), 3: ([a], [b]), 4: ([], []), 5: ([a], [])}
    cells, pairs = cells_frame(spark, given)
    assert verdict_map(match.multiset_eq(cells, pairs), "same_bag") == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert verdict_map(match.quick_reject(cells, pairs), "may_match") == {1: True, 2: True, 3: True, 4: True, 5: False}
    assert verdict_map(match.quick_reject(cells, pairs, ordered=True), "may_match")[2] is False


@pytest.mark.parametrize("ordered", [False, True])
def test_subset_agrees_with_greedy_choice(spark, tables, ordered):
    cells, pairs = cells_frame(spark, tables)
    got = verdict_map(frames.subset_match(cells, pairs, ordered=ordered), "subset")
    assert got == {p: brute_subset(g, q, ordered) for p, (g, q) in tables.items()}


def test_subset_worked_cases(spark):
    """Wrong order fails when order counts; an extra column passes."""
    cities = [("str:上海",), ("str:北京",), ("str:杭州",)]
    wrong_order = [("str:北京", "num:6.0"), ("str:上海", "num:5.0"), ("str:杭州", "num:4.0")]
    other_order = [("str:杭州", "num:4.0"), ("str:上海", "num:6.0"), ("str:北京", "num:5.0")]
    cells, pairs = cells_frame(spark, {1: (cities, wrong_order), 2: (cities, other_order)})
    assert verdict_map(frames.subset_match(cells, pairs, ordered=True), "subset")[1] is False
    assert verdict_map(frames.subset_match(cells, pairs), "subset")[2] is True


def test_subset_float_tolerance(spark):
    cells, pairs = cells_frame(spark, {1: ([("num:0.30000000000000004",)], [("num:0.3",)])})
    assert verdict_map(frames.subset_match(cells, pairs), "subset")[1] is True


def test_replay_on_postings(spark):
    rng = random.Random(8)
    for n in range(300):
        rows = [[sorted(rng.sample(range(6), rng.randint(0, 3))) for _ in range(rng.randint(0, 9))] for _ in range(2)]
        short, long = sorted(rows, key=len)
        want = similarity._shared_after_swaps(short, long)
        assert replay.shared_values(*[[np.array(r, dtype=np.int64) for r in side] for side in (short, long)], 6) == want


def test_align_score_of_ten_thousand_rows(spark):
    rng = random.Random(9)
    gold = [(f"str:{i}", f"str:{i % 700}", "str:same") for i in range(10_000)]
    pred = gold[:9_900] + [(f"str:{i}x", f"str:{i % 50}", "str:same") for i in range(150)]
    rng.shuffle(pred)
    cells, pairs = cells_frame(spark, {1: (gold, pred), 2: ([], []), 3: (gold[:300], gold[:300][::-1])})
    got = verdict_map(similarity.align_score(cells, pairs), "score")
    assert got[2] == got[3] == 1.0 and 0.97 < got[1] < 1.0


def test_align_score_small_and_large_agree_with_greedy(spark, tables):
    cells, pairs = cells_frame(spark, tables)
    want = {p: pytest.approx(brute_align(g, q)) for p, (g, q) in tables.items()}
    assert verdict_map(similarity.align_score(cells, pairs), "score") == want
    assert verdict_map(similarity.align_score(cells, pairs, small=2), "score") == want
    assert verdict_map(similarity.align_score(cells, pairs, small=2, at_once=0), "score") == want


def test_similarity_one_means_equal_bags_of_row_sets(spark, tables):
    cells, pairs = cells_frame(spark, tables)
    texts = pairs.withColumn("gold_sql", F.lit("match (n)")).withColumn("pred_sql", F.lit("match (m)"))
    got = verdict_map(similarity.df_sim_is_one(cells, texts), "same")
    assert got == {p: brute_align(g, q) == 1 for p, (g, q) in tables.items()}


def test_order_by_switches_to_places(spark):
    rows = [("str:a",), ("str:b",)]
    cells, pairs = cells_frame(spark, {1: (rows, rows[::-1]), 2: (rows, rows[::-1])})
    texts = pairs.withColumn("gold_sql", F.when(F.col("pair_id") == 1, "x ORDER BY y").otherwise("x"))
    texts = texts.withColumn("pred_sql", F.lit("x"))
    assert verdict_map(similarity.df_sim_is_one(cells, texts), "same") == {1: False, 2: True}


def test_canonical_cell(spark):
    given = [
        ("int", "1", "num:1.0"), ("double", "1.0", "num:1.0"), ("boolean", "true", "num:1.0"), ("string", "1", "str:1"),
        ("decimal(10,2)", "1.00", "num:1.0"), ("string", None, "null:"), ("array<int>", "[1, 2]", "other:[1, 2]"),
        ("double", "-0.0", "num:0.0"),
    ]
    df = spark.createDataFrame(given, "kind string, raw string, want string")
    rows = df.select("want", canonical_cell(F.col("kind"), F.col("raw")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("abc", "xyz", 0.0), ("", "a", 0.0), ("", "", 1.0)],
)
def test_jaro_winkler(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert similarity.text_similarity(df, "a", "b").first()["similarity"] == pytest.approx(want, abs=1e-6)


def test_verdict_codes(spark):
    row = [("str:a", "num:1.0")]
    given = {
        1: (row, row), 2: (row, [("str:b", "num:1.0")]), 3: ([("str:a", "null:")], row), 4: ([], row), 5: (row, []),
        6: (row, []), 7: (row, row), 8: (row, []),
    }
    cells, _ = cells_frame(spark, given)
    kinds = {7: "cypher", 8: "ngql"}
    pairs = spark.createDataFrame(
        [(p, kinds.get(p, "mysql"), "boom" if p in (6, 8) else None, "q", "q") for p in given],
        "pair_id long, sql_type string, err string, gold_sql string, pred_sql string",
    )
    rows = {r["pair_id"]: (r["execution_match"], r["df_match"], r["error"]) for r in verdicts.verdicts(cells, pairs).collect()}
    assert rows == {
        1: (1, 1, ""), 2: (0, 0, ""), 3: (-2, -2, ""), 4: (-2, -2, ""), 5: (0, 0, ""), 6: (-1, -1, "boom"), 7: (1, 0, ""),
        8: (-1, -1, "boom"),
    }
    overall = verdicts.metric_overall(verdicts.verdicts(cells, pairs)).first()
    assert (overall["valid_count"], overall["match_count"], overall["sql_error_count"]) == (6, 2, 2)


def test_overall_without_valid_pairs_is_null(spark):
    coded = spark.createDataFrame([(-2, -2, 1.0)], "execution_match int, df_match int, similarity double")
    assert verdicts.metric_overall(coded).first()["ex"] is None


def test_numbers_compare_exactly(spark):
    rows = [
        ("bigint", "9007199254740993", "num:9007199254740993.0"), ("decimal(20,2)", "9007199254740000.01", "num:9007199254740000.01"),
        ("decimal(20,2)", "-0.00", "num:0.0"), ("double", "1.0E10", "num:10000000000.0"), ("double", "1.5E-7", "num:0.00000015"),
        ("decimal(38,18)", "0.000000150000000000", "num:0.00000015"), ("double", "12345678.5", "num:12345678.5"),
        ("double", "NaN", "num:NaN"), ("boolean", "false", "num:0.0"), ("smallint", "-7", "num:-7.0"), ("double", "0.1", "num:0.1"),
    ]
    frame = spark.createDataFrame(rows, "kind string, raw string, want string")
    got = frame.select("want", canonical_cell(F.col("kind"), F.col("raw")).alias("cell")).collect()
    assert [r["cell"] for r in got] == [r["want"] for r in got]


def test_tolerance_is_relative(spark):
    cells, pairs = cells_frame(
        spark,
        {
            1: ([("num:1000000.0",)], [("num:1000000.5",)]),
            2: ([("num:0.0000001",)], [("num:0.0000002",)]),
            3: ([("num:-123.456001",)], [("num:-123.456",)]),
            4: ([("num:0.0",)], [("num:0.0",)]),
        },
    )
    assert verdict_map(frames.subset_match(cells, pairs), "subset") == {1: True, 2: False, 3: True, 4: True}


def test_columns_are_printed_once_and_meet_without_join(spark):
    tables = {1: ([("num:1.0", "str:a"), ("num:2.0", "str:a")], [("str:a", "num:1.0000001", "str:b"), ("str:a", "num:2.0", "str:b")]), 2: ([("str:a",)], [("str:b",)])}
    cells, pairs = cells_frame(spark, tables)
    mapped = match.mapped_by_rank(column_prints(result_rows(cells), key=frames.rounded_cell))
    assert [(r["pair_id"], r["perm"]) for r in mapped.collect()] == [(1, [1, 0])]
    plan = mapped._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
    assert "Join" not in plan and plan.count("Generate posexplode") == 1
    assert verdict_map(frames.subset_match(cells, pairs), "subset") == {1: True, 2: False}


def test_ordered_subset_ranks_only_rows_that_moved(spark):
    a, b, c = ("str:a",), ("str:b",), ("str:c",)
    tables = {1: ([a, b, c], [a, b, c]), 2: ([a, b, c], [a, c, b]), 3: ([a, a, b, c, c], [a, b, b, c, c]), 4: ([a, b, b], [b, a, b]), 5: ([a, a, b], [a, b, a])}
    cells, pairs = cells_frame(spark, tables)
    got = verdict_map(frames.subset_match(cells, pairs, ordered=True), "subset")
    assert got == {p: brute_subset(g, q, True) for p, (g, q) in tables.items()}
    assert got[1] is True and got[2] is False and got[5] is True


def test_verdicts_do_not_move_whole_rows_to_find_their_pairs(spark):
    """Pairs that are not asked for leave no trace, whatever cells come with them."""
    tables = {1: ([("str:a", "str:b")], [("str:b", "str:a")]), 2: ([("str:a", "str:b"), ("str:b", "str:a")], [("str:a", "str:b"), ("str:b", "str:a")])}
    cells, pairs = cells_frame(spark, tables)
    assert verdict_map(match.result_eq(cells, pairs.filter("pair_id = 1")), "match") == {1: True}
    assert verdict_map(frames.subset_match(cells, pairs.filter("pair_id = 2")), "subset") == {2: True}
