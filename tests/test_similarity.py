import random
from itertools import combinations_with_replacement

from querylight.functions.strings import _jaro_winkler
from querylight.operators import fuzzy, similarity


def test_fuzzy_pairs_finds_pairs_without_the_first_name(spark):
    names = ["zzzz", "marta", "martha", "marhta", "marta", None, "", "", "m", "anna", "annabelle maria", "annabella maria"]
    rows = [(i, n, b) for b in (1, 2, None) for i, n in enumerate(names if b != 2 else names[:4])]
    df = spark.createDataFrame(rows, "key long, name string, block int")
    for at_least in (0.0, 0.7, 0.9, 1.0):
        got = similarity.fuzzy_pairs(df, "name", ["block"], at_least).collect()
        want = {}
        for b in (1, 2):
            own = [n for _, n, x in rows if x == b and n is not None]
            for left, right in combinations_with_replacement(sorted(set(own)), 2):
                if (left != right or own.count(left) > 1) and _jaro_winkler(left, right) >= at_least:
                    want[b, left, right] = (own.count(left), own.count(right), _jaro_winkler(left, right))
        assert {(r["block"], r["left_name"], r["right_name"]): (r["left_rows"], r["right_rows"], r["similarity"]) for r in got} == want
        assert len(got) == len(want)


def all_pairs(names, at_least):
    return {(a, b) for a in names for b in names if a < b and _jaro_winkler(a, b) >= at_least}


def test_candidates_hold_every_pair_and_few_others(spark, monkeypatch):
    rng = random.Random(4)
    parts = ["ste", "mar", "tin", "ver", "quo", "xan", "lle", "zy", "ab", "ö"]
    names = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(260)} | {"a", "aa", "aaaaaaaaaa", "q"})
    rows = [(i, n, "hot") for i, n in enumerate(names)] + [(9000 + i, n, "other") for i, n in enumerate(names[::9])]
    df = spark.createDataFrame(rows, "key long, name string, block string")
    monkeypatch.setattr(fuzzy, "PER_SALT", 20)
    for at_least in (0.4, 0.7, 0.85, 0.95):
        met = {(r["left_name"], r["right_name"]) for r in fuzzy.candidates(df, "name", ["block"], at_least).filter("block = 'hot'").collect()}
        want = all_pairs(names, at_least)
        assert want <= met
        got = fuzzy.fuzzy_pairs(df, "name", ["block"], at_least).filter("left_name < right_name").collect()
        assert {(r["left_name"], r["right_name"]) for r in got if r["block"] == "hot"} == want
        assert {(r["left_name"], r["right_name"]) for r in got if r["block"] == "other"} == all_pairs(names[::9], at_least)
        if at_least == 0.95:
            # Of 33,000 pairs, about as many are left to compare exactly as a few per name.
            assert len(met) < len(names) ** 2 / 2 / 8


def test_fuzzy_join_lists_pairs_and_members(spark):
    rows = [(1, "marta", 1), (2, "martha", 1), (3, "marta", 1), (4, "zoe", 1), (5, None, 1), (6, "martha", None)]
    df = spark.createDataFrame(rows, "key long, name string, block int")
    got = similarity.fuzzy_join(df, "key", "name", ["block"], 0.9).collect()
    pairs = [(r["left_name"], r["right_name"]) for r in got if r["kind"] == "pair"]
    assert pairs == [("marta", "martha")]
    assert sorted((r["key"], r["left_name"] or "") for r in got if r["kind"] == "member") == [(k, n or "") for k, n, _ in rows]
