import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
from odd import LOW, SF, no_documents, odd_documents
from querylight.llm.merkle import manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return h("".join(parts))


def tree(nodes):
    """The root, and the (left, right) siblings of every node from the bottom up."""
    paths, at, here = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(here) > 1:
        for i, p in enumerate(at):
            first = p - p % 16
            paths[i].append(("".join(here[first:p]), "".join(here[p + 1 : first + 16])))
        here = [h("".join(here[i : i + 16])) for i in range(0, len(here), 16)]
        at = [p // 16 for p in at]
    return here[0], paths


def brute(rows, tamper):
    groups = {}
    for row in rows:
        groups.setdefault((row[1] is not None, (row[1] or "").encode()), []).append(row)
    order = sorted(groups)
    for key in order:
        groups[key].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {key: tree([leaf_of(r) for r in groups[key]]) for key in order}
    root, tops = tree([trees[key][0] for key in order])
    out = []
    for key, above in zip(order, tops):
        subroot, paths = trees[key]
        for row, path in zip(groups[key], paths):
            whole = path + above
            now = leaf_of(tamper(row))
            for left, right in whole:
                now = h(left + now + right)
            proof = h("".join(a + b for a, b in whole))
            out.append((row[0], leaf_of(row), subroot, root, proof, now, now == root))
    return out


def lowered(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 5 or row[4] is None:
        return row
    return (*row[:4], row[4].translate(LOW))


def key(row):
    return tuple((v is not None, v) for v in row)


def run(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    return entrypoint.queries()["op12_merkle_manifest"](spark, str(folder)).collect()


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*FIELDS).collect()]
    got = [tuple(r) for r in entrypoint.queries()["op12_merkle_manifest"](spark, SF).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, lowered), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows_and_empty_table(spark, tmp_path):
    docs = odd_documents(spark)
    rows = [tuple(r) for r in docs.select(*FIELDS).collect()]
    got = run(spark, tmp_path / "odd", docs)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, lowered), key=key)
    assert run(spark, tmp_path / "none", no_documents(spark)) == []


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (16, 17), (256, 257, 1, 4097), (16 * 16 * 16 + 256 + 1, 15)])
def test_block_borders(spark, sizes):
    rows = [(100000 * g + i, f"s{g}", None, i, f"Text {g} {i}") for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [tuple(r) for r in manifest(docs).collect()]
    assert sorted(got) == sorted(brute(rows, lambda r: r))
    assert all(r[-1] for r in got)


def test_more_subroots_than_a_block(spark):
    docs = spark.range(700).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("ä"), F.col("id") % 350).alias("source"), F.lit("x").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("T").alias("text")
    )
    rows = [tuple(r) for r in docs.collect()]
    altered = F.when(F.col("doc_id") == 3, F.lit("t")).otherwise(F.col("text"))
    got = [tuple(r) for r in manifest(docs, changed={"text": altered}).collect()]
    assert sorted(got) == sorted(brute(rows, lambda r: (*r[:4], "t") if r[0] == 3 else r))
    assert [r[0] for r in got if not r[-1]] == [3]
