import hashlib
import json
import os

import __spark_entry__ as entrypoint
import pytest
from pyspark.sql import functions as F

from querylight.session import drop_stages, stage, stage_path, stage_root
from querylight.sources import files, runner
from querylight.streaming import jobs


def test_stage_uses_the_configured_folder(spark, tmp_path):
    staged = stage(spark.range(5))
    assert all(stage_root(spark) in f for f in staged.inputFiles()) and staged.count() == 5


def test_drop_stages_removes_only_what_was_staged(spark):
    kept = stage_root(spark)
    path = stage(spark.range(3)).inputFiles()[0]
    assert drop_stages(spark) >= 1 and stage_root(spark) == kept
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_json_array_files(spark):
    path = stage_path(spark, "t")
    rows = spark.range(25).withColumn("t", F.when(F.col("id") != 7, F.lit("é\n\"x\"")))
    files.write_json_arrays(rows.unionByName(rows.filter("id = 3")), path, "id", file_bytes=90)
    back = files.read_json_array(spark, path, rows.schema)
    named = back.withColumn("file", F.col("_metadata.file_name"))
    assert sorted(r["id"] for r in back.collect()) == sorted([*range(25), 3])
    assert {r["id"]: r["t"] for r in back.collect()} == {i: None if i == 7 else "é\n\"x\"" for i in range(25)}
    per_file = [[r["id"] for r in f["rows"]] for f in named.groupBy("file").agg(F.collect_list(F.struct("id")).alias("rows")).orderBy("file").collect()]
    assert sum(per_file, []) == sorted([*range(25), 3]) and max(map(len, per_file)) <= 4 and len(per_file) >= 7


def test_json_array_files_of_large_records_and_empty_tables(spark):
    path = stage_path(spark, "t")
    rows = spark.createDataFrame([(1, "x" * 500), (None, "y"), (2, None)], "id long, t string")
    files.write_json_arrays(rows, path, "id", file_bytes=100)
    back = files.read_json_array(spark, path, rows.schema)
    assert {(r["id"], r["t"]) for r in back.collect()} == {(1, "x" * 500), (None, "y"), (2, None)}
    path = stage_path(spark, "t")
    files.write_json_arrays(rows.limit(0), path, "id")
    assert files.read_json_array(spark, path, rows.schema).count() == 0


def test_chat_rows_keep_their_nesting(spark, tmp_path):
    row = {"id": 1, "conversations": [{"role": "user", "content": "问"}], "sql_type": "mysql", "db_name": None}
    (tmp_path / "rows.jsonl").write_text(json.dumps(row, ensure_ascii=False) + "\n", encoding="utf-8")
    got = files.read_json_lines(spark, str(tmp_path / "rows.jsonl"), files.CHAT_ROW).first()
    assert got["conversations"][0]["content"] == "问" and got["db_name"] is None


def test_vocab_lines_and_missing_file(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("[PAD]\n the \nzebra\n", encoding="utf-8")
    got = files.read_vocab(spark, str(tmp_path / "vocab.txt")).orderBy("id").collect()
    assert [(r["id"], r["token"]) for r in got] == [(0, "[PAD]"), (1, "the"), (2, "zebra")]
    assert files.read_whole(spark, str(tmp_path / "vocab.txt")).first()["value"] == "[PAD]\n the \nzebra\n"
    assert files.read_whole(spark, str(tmp_path / "none.txt")).first()["value"] == ""


def test_run_pairs_keeps_failures_as_rows(spark):
    spark.range(3).createOrReplaceTempView("three")
    pairs = spark.createDataFrame(
        [(1, "select id, id + 1 as b from three order by id desc", "select nope from three"),
         (2, "select id, id + 1 as b from three order by id desc", "drop table three")],
        "pair_id long, gold_sql string, pred_sql string",
    )
    cases, cells, errors = runner.run_pairs(spark, pairs)
    known = cases.join(cells, "case_id").filter("pair_id = 1 and side = 'gold' and col_idx = 0").orderBy("row_idx")
    assert [r["cell"] for r in known.collect()] == ["num:2.0", "num:1.0", "num:0.0"]
    failed = {r["pair_id"]: r["err"] for r in cases.join(errors, "case_id").filter("side = 'pred'").collect()}
    assert "UNRESOLVED_COLUMN" in failed[1] and failed[2] == "not a read-only query"


def test_run_queries_stops_late_ones(spark):
    slow = spark.createDataFrame([("select sum(hash(id)) as s from range(900000000000)",)], "sql string")
    _, errors = runner.run_queries(spark, slow, seconds=2)
    assert errors.count() == 1


def test_many_queries_run_at_once_and_leave_nothing_behind(spark):
    spark.range(40).createOrReplaceTempView("forty")
    good = [f"select id, id * {k} as b from forty where id < {k} order by id desc" for k in range(1, 13)]
    bad = ["select none from forty", "select", "select raise_error('late') as x from forty", None]
    frame = spark.createDataFrame([(t,) for t in [*good, *good, *bad]], "sql string")
    root = stage_root(spark)
    before = set(os.listdir(root))
    cells, errors = runner.run_queries(spark, frame, at_once=3, batch=4)
    assert {n.split("-")[0] for n in set(os.listdir(root)) - before} == {"results", "errors"}
    sizes = {r["query_id"]: r["count"] for r in cells.groupBy("query_id").count().collect()}
    assert sizes == {hashlib.md5(t.encode()).hexdigest(): 2 * k for k, t in enumerate(good, 1)}
    first = cells.filter((F.col("query_id") == hashlib.md5(good[11].encode()).hexdigest()) & (F.col("col_idx") == 1))
    assert [r["cell"] for r in first.orderBy("row_idx").collect()] == [f"num:{12.0 * i}" for i in range(11, -1, -1)]
    failed = {r["query_id"]: r["err"] for r in errors.collect()}
    assert set(failed) == {hashlib.md5(t.encode()).hexdigest() for t in bad if t} and errors.count() == 3


def test_a_late_query_does_not_stop_those_beside_it(spark):
    texts = ["select sum(hash(id)) as s from range(0, 900000000000, 1, 2)", *[f"select {k} as k" for k in range(5)]]
    cells, errors = runner.run_queries(spark, spark.createDataFrame([(t,) for t in texts], "sql string"), seconds=15, at_once=2)
    assert errors.count() == 1 and cells.select("query_id").distinct().count() == 5


def test_interval_means(spark):
    log = spark.createDataFrame([(1, 0, 2.0), (2, 1, 4.0), (3, 0, 6.0)], "step long, process long, loss double")
    got = jobs.interval_means(log, ["loss"], 2).orderBy("interval").collect()
    assert [(r["step"], r["loss"]) for r in got] == [(2, 1.5), (3, 6.0)]


def test_interval_means_follow_files_in_any_order(spark):
    path = stage_path(spark, "log")
    rows = [(step, process, float(step * 3 % 7 + process)) for step in range(1, 38) for process in range(3)]
    for part in (rows[60:], rows[10:30], rows[:10], rows[30:60]):
        spark.createDataFrame(part, "step long, process long, loss double").coalesce(1).write.mode("append").parquet(path)
    log = spark.read.parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.drain_interval_means(stream, ["loss"], 10).orderBy("interval").collect()
    assert got == jobs.interval_means(log, ["loss"], 10).orderBy("interval").collect() and len(got) == 4


def test_interval_means_after_a_restart(spark):
    path, name = stage_path(spark, "log"), stage_path(spark, "means")
    schema = "step long, process long, loss double"
    for part in ([(1, 0, 2.0), (2, 0, 3.0)], [(3, 0, 5.0), (2, 1, 7.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        got = jobs.drain_interval_means(stream, ["loss"], 2, folder=name).orderBy("interval").collect()
    assert [(r["step"], r["loss"]) for r in got] == [(2, 3.0), (3, 5.0)]


def test_append_mode_drops_late_rows_and_keeps_closed_windows(spark):
    path = stage_path(spark, "events")
    rows = [("2024-01-01 00:00:00", 1.0), ("2024-01-01 12:00:00", 3.0), ("2024-01-03 00:00:00", 5.0)]
    # A batch judges lateness by the watermark two batches back.
    middle = [("2024-01-03 01:00:00", 5.0)]
    late = [("2024-01-01 06:00:00", 100.0), ("2024-01-05 00:00:00", 7.0)]
    for part in (rows, middle, late):
        df = spark.createDataFrame(part, "ts string, value double").withColumn("ts", F.to_timestamp("ts"))
        df.withColumn("event_type", F.lit("x")).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.drain_append(jobs.window_means(stream), "late").orderBy("window_start").collect()
    assert [(str(r["window_start"])[:10], r["mean_value"], r["n"]) for r in got] == [
        ("2024-01-01", 2.0, 2), ("2024-01-03", 5.0, 2),
    ]


def test_writes_are_refused_at_any_depth(spark):
    spark.sql("create or replace temporary view given as select 1 as a")
    path = stage_path(spark, "guarded")
    spark.sql("select 1 as a").write.parquet(path)
    texts = [
        "/* a comment */ select a from given",
        f"with q as (select 7 as a) insert into parquet.`{path}` select * from q",
        "set spark.sql.shuffle.partitions = 1",
        "select transform(a) using 'cat' as (b) from given",
        "table given",
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "sql string")
    cells, errors = runner.run_queries(spark, frame)
    assert cells.select("query_id").distinct().count() == 2
    assert {r["err"] for r in errors.collect()} == {"not a read-only query"} and errors.count() == 3
    assert spark.read.parquet(path).count() == 1


def test_lines_lose_every_kind_of_blank(spark, tmp_path):
    for name, lines in (("b.txt", ["\u3000c\u00a0", "d"]), ("a.txt", [" a\t", "b\u2003"])):
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    assert sorted(r["value"] for r in files.read_lines(spark, str(tmp_path)).collect()) == ["a", "b", "c", "d"]
    vocab = files.read_vocab(spark, str(tmp_path))
    assert [(r["id"], r["token"]) for r in vocab.orderBy("id").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_step_log_arrives_in_four_batches_from_any_number_of_files(spark, tmp_path):
    events = spark.range(4000).selectExpr(
        "id as event_id", "timestamp_seconds(id) as ts", "id % 7 as user_id", "'click' as event_type", "cast(id % 3 as double) as value", "'' as props"
    )
    events.repartition(12).write.parquet(f"{tmp_path}/events.parquet")
    before = set(os.listdir(stage_root(spark)))
    queries = entrypoint.queries()
    got = queries["steplog_interval_stream"](spark, str(tmp_path))
    assert sorted(got.collect()) == sorted(queries["steplog_interval_mean"](spark, str(tmp_path)).collect())
    sums = [n for n in set(os.listdir(stage_root(spark))) - before if n.startswith("interval-sums-") and "state" not in n]
    assert len(sums) == 1
    batches = [n for n in os.listdir(f"{stage_root(spark)}/{sums[0]}") if n.startswith("batch=")]
    assert 2 <= len(batches) <= 4
