from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
from odd import no_documents, odd_documents
from querylight.llm.language_id import CharModels, drop_rejected, judge_texts, train_models

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    judged = entrypoint.queries()["op4_language_id"](spark, SF).join(docs, "doc_id").filter("held_out")
    right = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.99
    assert judged.filter("rejected").count() == 0


def test_word_chances_sum_to_at_most_one():
    words = {"a": (["abba", "abab", "baab", "bb"], np.array([3, 1, 2, 5])), "b": (["aab", "a"], np.array([2, 7]))}
    models = CharModels.train(words, order=3)
    every = ["".join(signs) for n in range(1, 13) for signs in product("ab", repeat=n)]
    chances = np.exp(models.word_scores(every)).sum(axis=0)
    assert (chances <= 1 + 1e-5).all() and (chances > 0.4).all()
    scores = models.word_scores(["abba", "aab"])
    assert scores[0, 0] > scores[0, 1] and scores[1, 1] > scores[1, 0]


def test_noise_is_rejected_and_order_does_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = train_models(docs)
    rng = np.random.default_rng(1)
    noise = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(200))
    out = models.judge(pa.array([noise, None, "", "123 !?", "the and of that this"]))
    assert out["rejected"][:4].all() and not out["rejected"][4]
    assert list(out["lang"][1:4]) == ["und"] * 3 and out["lang"][4] == "en"
    again = models.judge(pa.array(["the and of that this", noise]))
    assert again["cross_entropy"][0] == out["cross_entropy"][4] and again["score"][0] == out["score"][4]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    kept = drop_rejected(docs)
    assert kept.columns == docs.columns
    assert kept.filter("text is null or text = ''").count() == 0
    none = no_documents(spark)
    assert drop_rejected(none).count() == 0
    untaught = judge_texts(docs, "text", train_models(none))
    assert untaught.filter("lang_pred <> 'und' or not rejected").count() == 0
