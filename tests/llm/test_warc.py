import hashlib
import uuid

import pytest

import __spark_entry__ as entrypoint
from odd import SF
from oracle_compare import compare, duck
from querylight.llm.warc import give_name, open_store, read_archives, with_revisits, write_archives
from querylight.session import stage_path

ROWS = [
    (3, "http://a/3", "x" * 1500),
    (1, "http://a/1", "x" * 1500),
    (2, "http://a/2\r\nInjected: yes", "small"),
    (5, "http://a/5", "small"),
    (3, "http://a/3", "x" * 1500),
    (4, None, None),
    (None, "http://a/null", "y" * 1200),
    (None, "http://b/null", "y" * 1200),
    (6, "http://a/ü", "é\r\n\r\n" * 400_000),
    (7, "http://a/7", ""),
]


def pages(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, "page_id long, url string, html string")


def written(spark, frame, **options):
    folder = stage_path(spark, "warc")
    manifest = write_archives(with_revisits(frame, "page_id", "url", "html"), folder, **options)
    return folder, manifest


def test_query_matches_sql(spark):
    ok, note = compare(spark, duck(SF), "op5_warc", SF)
    assert ok, note


def test_round_trip_of_odd_rows(spark):
    folder, manifest = written(spark, pages(spark), roll_bytes=300, shard_bytes=4000)
    assert manifest.count() > 1
    read = read_archives(manifest, folder).collect()
    assert len(read) == len(ROWS)
    for page, url, html in ROWS:
        data = (html or "").encode()
        same = [r for r in read if r["page"] == page and r["url"] == " ".join((url or "").split())]
        assert same
        for r in same:
            assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
            revisit = page == 1
            assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (3 if revisit else None)
            assert r["payload"] == (None if revisit else data)


def test_equal_tables_give_equal_files(spark, monkeypatch):
    first = sorted(map(tuple, written(spark, pages(spark), shard_bytes=4000)[1].collect()))
    again = pages(spark, ROWS[::-1]).repartition(3)
    assert sorted(map(tuple, written(spark, again, shard_bytes=4000)[1].collect())) == first


def test_revisits_name_a_record_that_is_there(spark):
    rows = [(1, "http://a/1", "x" * 1500), (2, "http://a/2", "x" * 1500), (9, "http://a/  9", "x" * 1500), (9, "http://a/8", "x" * 1500)]
    folder, manifest = written(spark, pages(spark, rows))
    read = read_archives(manifest, folder).collect()
    responses = {r["record_id"]: r for r in read if r["record_type"] == "response"}
    revisits = [r for r in read if r["record_type"] == "revisit"]
    assert len(revisits) == 2 and all(responses[r["refers_to_id"]]["page"] == 9 for r in revisits)
    assert all(r["refers_to_id"] is None for r in responses.values())


def test_clashing_columns_do_no_harm(spark):
    clash = pages(spark).selectExpr("*", "1 as digest", "2 as shard", "'k' as kept", "'u' as kept_url", "3 as page", "4 as refers_to", "5 as payload")
    folder, manifest = written(spark, clash)
    assert read_archives(manifest, folder).count() == len(ROWS)


def test_each_shard_is_one_task(spark):
    rows = [(i, f"http://a/{i}", f"{i}" * 3000) for i in range(40)]
    _, manifest = written(spark, pages(spark, rows), shard_bytes=6000)
    got = manifest.orderBy("shard").collect()
    assert [r["part"] for r in got] == [0] * len(got) and len(got) > 10 and sum(r["records"] for r in got) == 40


def test_a_commit_can_be_repeated_but_not_made_up(tmp_path):
    store, root = open_store(str(tmp_path))
    (tmp_path / "t").write_bytes(b"12345")
    for _ in range(2):
        give_name(store, f"{root}/t", f"{root}/f", 5)
    assert (tmp_path / "f").read_bytes() == b"12345" and not (tmp_path / "t").exists()
    for final, size in (("f", 6), ("none", 5)):
        with pytest.raises(FileNotFoundError):
            give_name(store, f"{root}/t", f"{root}/{final}", size)


def test_only_committed_files_are_read(spark):
    folder, manifest = written(spark, pages(spark))
    store, root = open_store(folder)
    with store.open_output_stream(f"{root}/data/.{uuid.uuid4().hex}.tmp") as out:
        out.write(b"a lost attempt")
    assert read_archives(manifest, folder).count() == len(ROWS)


def test_empty_table(spark):
    folder, manifest = written(spark, pages(spark).limit(0))
    assert manifest.count() == 0 and read_archives(manifest, folder).count() == 0
    assert "op5_warc" in entrypoint.oracle_sql()


def test_large_pages_get_shards_of_their_own(spark):
    rows = [(i, f"http://a/{i}", f"{i}" * 3000) for i in range(6)]
    folder, manifest = written(spark, pages(spark, rows), shard_bytes=1000)
    assert sorted(r["shard"] for r in manifest.collect()) == [0, 1, 2, 3, 4, 5]
    assert read_archives(manifest, folder).count() == 6
