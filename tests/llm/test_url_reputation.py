from odd import SF
from oracle_compare import compare, duck
from querylight.llm.url_reputation import judge_urls, known_suffixes, reputation, with_domain


def test_query_matches_sql(spark):
    ok, note = compare(spark, duck(SF), "op3_url_reputation", SF)
    assert ok, note


def judged(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([("a.net", 1), ("b.org", 0)], "host string, bad int")
    return {r["page_id"]: tuple(r)[2:] for r in judge_urls(pages, outcomes).collect()}


def test_the_longest_rule_wins(spark):
    urls = [
        "http://X.Example.NET/en/1", "http://example.net/de/1", "https://a.b.example.com/de/", "http://notexample.com/de/1",
        "http://c.org/fr/1?x=/de/", "http://net", "http://net/", None, "no scheme", "", "x://a.NET?q=http://b/#f", "http://example.net/EN/1",
    ]
    got = judged(spark, urls)
    assert got[0] == ("x.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/de/1", "net/", "block")
    assert got[2] == ("a.b.example.com", "/de/", "example.com/de/", "block")
    assert got[3] == ("notexample.com", "/de/1", None, "allow")
    assert got[4] == ("c.org", "/fr/1", "org/fr/", "allow")
    assert got[5] == ("net", "", None, "allow") and got[6][2] == "net/"
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10][:3] == ("a.net", "", None)
    assert got[11][2] == "net/"


def test_few_pages_shrink_towards_their_domain(spark):
    rows = [("bad.x.com", 1)] * 90 + [("bad.x.com", 0)] * 10 + [("good.y.com", 1)] * 5 + [("good.y.com", 0)] * 95
    rows += [("new.x.com", 1), ("new.y.com", 1), ("none.z.com", None), ("", 1)]
    rates = {r["host"]: r for r in reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert rates["bad.x.com"]["bound"] > 0.7 and rates["good.y.com"]["rate"] < 0.15
    assert rates["new.y.com"]["rate"] < rates["new.x.com"]["rate"] < 1
    assert rates["new.x.com"]["bound"] < rates["bad.x.com"]["bound"]
    assert rates["none.z.com"]["n"] == 0 and 0 < rates["none.z.com"]["rate"] < 1


def domains(spark, hosts, suffixes=None):
    listed = known_suffixes(spark) if suffixes is None else spark.createDataFrame([(s,) for s in suffixes], "suffix string")
    rows = with_domain(spark.createDataFrame([(h,) for h in hosts], "host string"), listed).collect()
    return {r["host"]: (r["domain"], r["suffix"]) for r in rows}


def test_the_longest_suffix_counts_label_by_label(spark):
    got = domains(spark, ["a.b.gov.uk", "x.co.za", "u@www.e.com.sg:80", "co.uk", "notco.uk", "a.com", "com", "", "1.2.3.4:8", "a..com"])
    assert got["a.b.gov.uk"] == ("b.gov.uk", "gov.uk") and got["x.co.za"] == ("x.co.za", "co.za")
    assert got["u@www.e.com.sg:80"] == ("e.com.sg", "com.sg")
    assert got["co.uk"] == ("co.uk", "co.uk") and got["notco.uk"] == ("notco.uk", "uk")
    assert got["a.com"] == ("a.com", "com") and got["com"] == ("com", "com") and got[""] == ("", "")
    assert got["1.2.3.4:8"] == ("1.2.3.4", "") and got["a..com"] == (".com", "com")
    own = domains(spark, ["a.b.c.d", "x.c.d", "x.y.d"], ["c.d", "b.c.d", "b.c.d", None])
    assert own == {"a.b.c.d": ("a.b.c.d", "b.c.d"), "x.c.d": ("x.c.d", "c.d"), "x.y.d": ("y.d", "d")}
    assert domains(spark, ["a.b.co.uk"], []) == {"a.b.co.uk": ("co.uk", "uk")}


def test_repeated_rows_long_urls_and_clashing_columns(spark):
    long = "http://h.example.org/fr/" + "x/" * 300_000
    rows = [(1, long, "a", "b", 2.0, "d"), (1, long, "a", "b", 2.0, "d"), (None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, bound double, verdict string")
    got = judge_urls(pages, spark.createDataFrame([("h.example.org", 1)], "host string, bad int")).collect()
    assert sorted((r["page_id"] or 0, r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in got) == [
        (0, "", 0, None, "allow"), (1, "h.example.org", len(long) - 20, "org/fr/", "allow"), (1, "h.example.org", len(long) - 20, "org/fr/", "allow"),
    ]


def test_nothing_to_learn(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    empty = spark.createDataFrame([], "host string, bad int")
    assert [r["verdict"] for r in judge_urls(pages, empty).collect()] == ["allow"]
    assert judge_urls(pages.limit(0), empty).count() == 0
