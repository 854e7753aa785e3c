from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
import corpus_pipeline
from odd import SF, no_documents, odd_documents, odd_items
from test_dart_minhash import brute_classes
from test_decontaminate import brute
from test_packing import check
from querylight.session import stage


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, SF), name)
        kept[name] = (docs, out)
        assert name == "packing" or out.columns == docs.columns
        docs = out
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]

    before, after = kept["language_id"]
    assert after.count() >= before.count() - 2
    before, after = kept["line_templates"]
    assert after.count() == before.count() and after.filter("n_chars <> char_length(text)").count() == 0
    before, after = kept["near_duplicates"]
    given = rows(before)
    assert rows(after) == [d for d, c in zip(given, brute_classes(given)) if d[0] == c]
    before, after = kept["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute(rows(before), items)
    assert rows(after) == [d for d in rows(before) if not (hits[d[0]][1] > 0 and 20 * hits[d[0]][1] >= hits[d[0]][0])]
    before, after = kept["packing"]
    check(after.collect(), rows(before))


def test_run_equals_its_stages(spark):
    assert entrypoint.queries()["pipeline"] is corpus_pipeline.run
    tokens = corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0]
    assert tokens > 0


def test_odd_and_empty_tables(spark, tmp_path):
    odd_items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_documents(spark), no_documents(spark)):
        for name, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, str(tmp_path)), name)
        assert docs.columns[0] == "doc_id"


def test_python_gets_small_batches_of_large_rows(spark):
    docs = spark.range(0, 2000, 1, 1).select(
        F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), 2000), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang")
    )

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(name)
    for step in (corpus_pipeline.language_id, corpus_pipeline.near_duplicates, corpus_pipeline.packing):
        spark.conf.set(name, usual)
        step(spark, docs.limit(5), SF)
        assert docs.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0] < 6 << 20
    spark.conf.set(name, usual)
