import json

import __spark_entry__ as entrypoint
from querylight.operators import catalog, catalog_dict


def catalogs(spark, given):
    rows = [(db, text if isinstance(text, str) or text is None else json.dumps(text)) for db, text in given.items()]
    return spark.createDataFrame(rows, "db_id string, catalog string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ZOO = {
    "zebra": {
        "header": ["id", "state"],
        "type": ["int", "text"],
        "column_description": ["number", "state A or B"],
        "table_description": "striped",
        "enumerations": {"state": {"values": ["A", "B"], "desc": "codes"}, "id": [3, 1]},
    },
    "ant": {"header": ["x"], "enumerations": {"x": ["it's", "b"]}},
    "empty": {},
    "listed": [],
    "nothing": None,
    "foreign_key_map": [["ant.x", "zebra.id"], ["zebra.state", "ant.x"]],
}


def test_tables_in_the_order_of_the_text(spark):
    got = rows(catalog_dict.flatten_dict(catalogs(spark, {"zoo": ZOO})))
    assert got == sorted(
        [
            ("zoo", 0, "zebra", 0, "id", "int", "number", "striped"),
            ("zoo", 0, "zebra", 1, "state", "text", "state A or B", "striped"),
            ("zoo", 1, "ant", 0, "x", None, None, ""),
        ],
        key=repr,
    )


def test_enumerations_and_keys(spark):
    given = catalogs(spark, {"zoo": ZOO})
    assert rows(catalog_dict.enumerations(given)) == sorted(
        [("zoo", "zebra", "state", "A", "codes"), ("zoo", "zebra", "state", "B", "codes"), ("zoo", "zebra", "id", "3", None),
         ("zoo", "zebra", "id", "1", None), ("zoo", "ant", "x", "it's", None), ("zoo", "ant", "x", "b", None)],
        key=repr,
    )
    assert rows(catalog_dict.foreign_keys(given)) == [("zoo", 0, "ant", "x", "zebra", "id"), ("zoo", 1, "zebra", "state", "ant", "x")]


def test_schema_text(spark):
    given = catalogs(spark, {"zoo": ZOO, "bare": {"t": {"header": ["a"]}}})
    texts = catalog.schema_text_rich(catalog_dict.flatten_dict(given), catalog_dict.foreign_keys(given), catalog_dict.enumerations(given))
    text = {r["db_id"]: r["schema_text"] for r in texts.collect()}
    assert text["bare"] == "【DB_ID】 bare\n【Schema】\n# Table: t\n[\n  (a,)\n]\n【Foreign keys】\n"
    lines = text["zoo"].split("\n")
    assert lines[2:4] == ["# Table: zebra, striped", "["]
    # Every value of the state stands in its description, so the codes are not mentioned; samples hold both values.
    assert lines[5] in ("  (state:text, state A or B. Value examples: ['A', 'B'].)", "  (state:text, state A or B. Value examples: ['B', 'A'].)")
    assert lines[9] in ("  (x, Value examples: [\"it's\", 'b'].)", "  (x, Value examples: ['b', \"it's\"].)")
    assert lines[-2:] == ["ant.`x` = zebra.`id`", "zebra.`state` = ant.`x`"]


def test_unreadable_texts(spark):
    given = catalogs(spark, {"bad": "{", "none": None, "list": "[1]", "number": "3", "good": {"t": {"header": ["a"], "type": []}}, "odd": {"t": "text"}})
    assert [r[0] for r in rows(catalog_dict.unreadable(given))] == ["bad", "none"]
    assert rows(catalog_dict.flatten_dict(given)) == [("good", 0, "t", 0, "a", None, None, "")]
    assert rows(catalog_dict.enumerations(given)) == [] and rows(catalog_dict.foreign_keys(given)) == []


def test_shared_and_own_enumerations_agree(spark):
    values = [(t, c, f"v{i}") for t, c, n in (("t", "a", 30), ("t", "b", 1)) for i in range(n)]
    shared = spark.createDataFrame(values, "tab string, col string, value string")
    got = {(r["tab"], r["col"]): r["examples"] for r in catalog.value_examples(shared).collect()}
    assert 2 <= got["t", "a"].count("'") // 2 <= 8 and got["t", "b"] == "['v0']"
    own = shared.selectExpr("'db' as db_id", "*")
    assert {(r["tab"], r["col"]) for r in catalog.value_examples(own).collect()} == set(got)


def test_all_rows_in_one_pass(spark):
    """Columns, enumerations and keys come from one parse of each text, without join or shuffle."""
    given = catalogs(spark, {"zoo": ZOO, "bad": "{", "none": None, "list": '[{"header": ["a"]}]', "odd": {"t": "text", "foreign_key_map": [["a", "b.c"]]}})
    got = catalog_dict.flatten_all(given)
    assert rows(got) == sorted(
        [
            ("zoo", 0, "zebra", 0, "id", "int", "number", "striped", 2, None, "1|3"),
            ("zoo", 0, "zebra", 1, "state", "text", "state A or B", "striped", 2, "codes", "A|B"),
            ("zoo", 1, "ant", 0, "x", None, None, "", 2, None, "b|it's"),
            ("zoo", -1, "ant", 0, "x", "zebra", "id", "", 0, None, None),
            ("zoo", -1, "zebra", 1, "state", "ant", "x", "", 0, None, None),
            ("odd", -1, "a", 0, None, "b", "c", "", 0, None, None),
        ],
        key=repr,
    )
    for df in (got, entrypoint.queries()["cat_flatten_dict"](spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        main = plan.split("Subqueries")[0]
        assert "Join" not in main and "Exchange hashpartitioning" not in main and main.lower().count("parsejson(") == 1
