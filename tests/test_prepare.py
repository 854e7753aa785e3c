import random

from pyspark.sql import functions as F

from querylight.functions import sqltext
from querylight.functions.strings import canonical_db_name, quoted_value
from querylight.operators import catalog, encode, prompts
from querylight.operators.numbering import number_rows


def one(spark, expression, **columns):
    names = ", ".join(f"{c} string" for c in columns)
    return spark.createDataFrame([tuple(columns.values())], names).select(expression.alias("x")).first()["x"]


def test_number_rows_with_a_hot_group(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**6), 3000)
    rows = [("hot" if i % 3 else f"g{i % 50}", v) for i, v in enumerate(ids)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    got = {(r["g"], r["v"]): (r["at"], r["n"]) for r in number_rows(df, ["g"], ["v"], "at", total="n").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        vs = sorted(v for h, v in rows if h == g)
        want.update({(g, v): (i, len(vs)) for i, v in enumerate(vs)})
    assert got == want
    first = number_rows(df, [], ["v"], "at", below=10).orderBy("at").collect()
    assert [r["v"] for r in first] == sorted(ids)[:10]


def test_fences(spark):
    text = "Sure:\n```sql\nSELECT state, count(*) FROM t\n```\nThis counts."
    assert one(spark, sqltext.last_fence(F.col("t")), t=text) == "SELECT state, count(*) FROM t"
    assert one(spark, sqltext.last_fence(F.col("t")), t="a ```sql x``` b ```sql y ```") == "y"
    assert one(spark, sqltext.last_fence(F.col("t")), t="no fence") == "no fence"


def test_limits_and_ends(spark):
    assert one(spark, sqltext.add_limit(F.col("t")), t="select 1 ;\n") == "select 1 LIMIT 100;"
    assert one(spark, sqltext.add_limit(F.col("t")), t="select 1 limit 5") == "select 1 limit 5;"
    assert one(spark, sqltext.add_limit(F.col("t"), 10), t="select limits from t") == "select limits from t LIMIT 10;"
    assert one(spark, sqltext.terminate(F.col("t")), t="select 1; \n") == "select 1; \n"
    assert one(spark, sqltext.has_keywords(F.col("t")), t="select whereabouts from t") is False


def test_normal_text_keeps_literals(spark):
    normal = sqltext.normal_text(F.col("t"))
    assert one(spark, normal, t="SELECT  `A` -- note\nFROM T where x = 'It''s  --B' ;") == (
        "select a from t where x = 'It''s  --B'"
    )


def test_small_strings(spark):
    assert one(spark, canonical_db_name(F.col("t")), t="sql_eval_sql_eval_x") == "sql_eval_x"
    assert [one(spark, quoted_value(F.col("t")), t=v) for v in ("a", "it's", "a\\b", "'\"")] == [
        repr(v) for v in ("a", "it's", "a\\b", "'\"")
    ]


def spider(spark):
    return spark.createDataFrame(
        [("d", ["t", "u"], [(-1, "*"), (0, "id"), (0, "name"), (1, "t_id")], ["text", "number", "text", "number"], [[3, 1], [3, 0]])],
        "db_id string, table_names_original array<string>, "
        "column_names_original array<struct<table_idx:int,name:string>>, column_types array<string>, "
        "foreign_keys array<array<int>>",
    )


def test_plain_schema_text_and_back(spark):
    cols, fks = catalog.flatten(spider(spark)), catalog.resolve_fks(spider(spark))
    text = catalog.schema_text(cols, fks)
    assert text.first()["schema_text"] == (
        "【DB_ID】 d\n【Schema】\n# Table: t\n[\n  (id:number),\n  (name:text),\n]\n# Table: u\n[\n  (t_id:number),\n]\n"
        "\n【Foreign keys】\nu.t_id=t.id\n"
    )
    parsed = catalog.parse_columns(text)
    assert [(r["tab"], r["col"], r["line"]) for r in parsed.orderBy("tab_idx", "col_idx").collect()] == [
        ("t", "id", "(id:number)"), ("t", "name", "(name:text)"), ("u", "t_id", "(t_id:number)"),
    ]
    again = catalog.rerender(parsed, catalog.parse_fks(text))
    once = catalog.parse_columns(again).select("tab", "col", "line").collect()
    assert set(once) == set(parsed.select("tab", "col", "line").collect())
    assert catalog.filter_fks(fks, cols.filter("col <> 'id'")).count() == 0
    assert catalog.filter_fks(fks, cols).count() == 1


def test_rich_schema_text(spark):
    cols = catalog.flatten(spider(spark)).withColumn("description", F.concat(F.lit("the "), "col"))
    cols = cols.withColumn("table_description", F.when(F.col("tab") == "t", "things").otherwise(""))
    enums = spark.createDataFrame(
        [("d", "t", "name", v, "codes") for v in ("x'1", "y")], "db_id string, tab string, col string, value string, enum_desc string"
    )
    text = catalog.schema_text_rich(cols, catalog.resolve_fks(spider(spark)), enums).first()["schema_text"]
    assert "# Table: t, things\n[\n  (id:number, the id.),\n  (name:text, the name, codes. Value examples: [" in text
    assert '"x\'1"' in text and "'y'" in text
    assert text.endswith("【Foreign keys】\nu.`t_id` = t.`id`")
    tidy = one(spark, catalog.normalise_fk_section(F.col("t")), t=text)
    assert tidy.endswith("【Foreign keys】\nu.t_id = t.id")
    assert one(spark, catalog.normalise_fk_section(F.col("t")), t="no keys") == "no keys"


def test_value_examples_stay_in_bounds(spark):
    values = spark.createDataFrame(
        [("d", "t", f"c{c}", f"v{v}") for c in range(20) for v in range(30)], "db_id string, tab string, col string, value string"
    )
    sizes = [r["examples"].count(",") + 1 for r in catalog.value_examples(values).collect()]
    assert len(sizes) == 20 and min(sizes) >= 2 and max(sizes) <= 8 and len(set(sizes)) > 2


def test_render_leaves_braces_and_fills_the_fallback(spark):
    df = spark.createDataFrame(
        [(1, "d", "MySQL", "what is {db_schema}?", None, " S ", "E", None, "select 1"),
         (2, "d", "oracle", "q", "better", "S", "E", None, "select 2"),
         (3, "d", "pg2nl", "q", "", "S", "E", 3, "select 3")],
        "id long, db_id string, sql_type string, question string, rewrite string, db_schema string, evidence string, "
        "qnum int, sql string",
    )
    rows = {r["id"]: r for r in prompts.render(df).collect()}
    assert "【用户问题】\nwhat is {db_schema}?\n\n【数据库schema】\nS\n" in rows[1]["prompt"]
    assert "question: `better`\n\n\nDDL statements:\n<|eot_id|>" in rows[2]["prompt"]
    assert "推断出3条" in rows[3]["prompt"] and rows[3]["prompt"].count("select 3") == 2
    chat = {r["id"]: r for r in prompts.conversation(prompts.render(df)).collect()}
    assert chat[3]["conversations"][1]["content"] == "q" and chat[1]["conversations"][1]["content"] == "select 1"


def test_chat_text(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "S"), (1, 1, "user", "U"), (2, 0, "user", "A"), (2, 1, "assistant", "B")],
        "conv_id long, turn long, role string, text string",
    )
    lists = prompts.gather_turns(turns)
    texts = {r["conv_id"]: r["t"] for r in lists.select("conv_id", prompts.chat_text(F.col("messages")).alias("t")).collect()}
    assert texts[1] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>"
    assert texts[2].startswith("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\nA")
    first = lists.select(prompts.chat_text(prompts.first_only(F.col("messages")), True).alias("t")).collect()
    assert all(r["t"].endswith("<|im_end|>\n<|im_start|>assistant\n") for r in first)


def test_masks_slots_and_padding(spark):
    df = spark.createDataFrame(
        [(1, "mysql", [1, 2, 3, 4], 2, 0), (2, "sqlite", [5, 6], 3, 0)], "id long, sql_type string, ids array<long>, n_prompt int, batch_id long"
    )
    rows = encode.mask_rows(df, 3)
    got = {r["id"]: r for r in rows.collect()}
    assert got[1]["labels"] == [-100, -100, 3] and not got[1]["too_long"] and got[1]["full_len"] == 4
    assert got[2]["labels"] == [-100, -100] and got[2]["too_long"]
    slotted = {r["id"]: r["x"] for r in rows.select("id", encode.dialect_slot(F.col("labels"), F.col("sql_type")).alias("x")).collect()}
    assert slotted == {1: [1, -100, 3], 2: [-100, -100]}
    left = {r["id"]: r for r in encode.pad_batches(rows, pad_id=9).collect()}
    assert (left[2]["ids"], left[2]["labels"], left[2]["mask"]) == ([9, 5, 6], [-100, -100, -100], [0, 1, 1])
    right = {r["id"]: r for r in encode.pad_batches(rows, left=False).collect()}
    assert (right[2]["ids"], right[2]["mask"]) == ([5, 6, 0], [1, 1, 0])
    packed = encode.pack_offsets(encode.pad_batches(rows.withColumn("slot", F.col("id")))).orderBy("slot").collect()
    assert [(r["length"], r["offset"], r["max_length"], r["position_ids"]) for r in packed] == [
        (3, 0, 3, [0, 1, 2]), (2, 3, 3, [1, 0, 1]),
    ]


def test_sample_by_dialect(spark):
    rows = spark.range(300).withColumn("sql_type", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    got = encode.sample_by_dialect(rows, {"b": 4, "a": 2, "none": 7}).orderBy("part", "id").collect()
    assert [(r["part"], r["id"]) for r in got] == [(0, 1), (0, 2), (0, 4), (0, 5), (1, 0), (1, 3)]
    assert encode.sample_by_dialect(rows, None).count() == 300
    assert encode.sample_by_dialect(rows, {"a": 0}).count() == 0


def test_batches_and_labels(spark):
    got = encode.batches(spark.range(10, 35), ["id"], 10).orderBy("id").collect()
    assert [(r["batch_id"], r["slot"]) for r in got] == [(i // 10, i % 10) for i in range(25)]
    label = encode.sep_label(F.lit("d"), F.lit("mysql"), F.lit("select '[sep]'"))
    parts = spark.range(1).select(*encode.split_label(label)).first()
    assert (parts["db_name"], parts["sql_type"], parts["target"]) == ("d", "mysql", "'")


def test_row_numbers_join_only_the_groups_that_lie_in_several_chunks(spark):
    df = spark.range(3000).selectExpr("case when id < 2000 then -1 else id end as g", "id as v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = number_rows(df, ["g"], ["v"], "at", total="n")
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        got = {r["v"]: (r["at"], r["n"]) for r in numbered.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {v: (v, 2000) if v < 2000 else (0, 1) for v in range(3000)}
