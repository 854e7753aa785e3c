from pyspark.sql import functions as F

from querylight.operators import encode


def test_labels_are_two_runs_without_a_function_per_id(spark):
    rows = [([1, 2, 3], 0), ([1, 2, 3], 2), ([1, 2, 3], 3), ([1, 2, 3], 9), ([], 2), (None, 1), ([4, None], 1), ([5], None), ([5], -1)]
    made = spark.createDataFrame(rows, "ids array<long>, n int").select(encode.label_mask(F.col("ids"), F.col("n")).alias("l"))
    want = [None if ids is None else [-100 if i < (n or 0) else x for i, x in enumerate(ids)] for ids, n in rows]
    assert [r["l"] for r in made.collect()] == want
    assert "lambda" not in made._jdf.queryExecution().toString()
