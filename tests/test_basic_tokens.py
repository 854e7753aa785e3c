"""Marks and tokens as the plain passes give them, few texts through Python, small pieces of batches."""

import unicodedata

from pyspark.sql import functions as F

from querylight.functions import text as tx
from querylight.operators import prompts
from querylight.operators import vocab
from querylight.session import SLICE_ROWS

ODD = ["A\x0bb\x00c", "x\u0085y z w", "Café ́Ȩ́", "한글 Text", "ো̈́", "ΟΔΟΣ.", "漢́x，﨎\U0002f800y",
       "\U0001d16d\U0001d165a", "don't [a]^b`c", "", "‍ı İ ß�", "a　b¡c", "\t\n"]


def test_every_character_loses_its_marks(spark):
    chars = [c for c in map(chr, range(0x20, 0x30000)) if not 0xD800 <= ord(c) < 0xE000]
    texts = ["".join(chars[i : i + 40]) for i in range(0, len(chars), 40)] + chars[0x80:0x500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.strip_accents("t").alias("s"))
    want = F.regexp_replace(tx.decompose("t"), r"\p{Mn}+", "")
    assert got.filter(~F.col("s").eqNullSafe(want)).isEmpty()
    assert not any(c.lower() != c or c.upper() != c for c in map(chr, range(0x80, 0x30000)) if c not in tx.MARKED and unicodedata.normalize("NFD", c) != c and c != "̈́")


def test_plain_texts_stay_out_of_python(spark):
    @F.pandas_udf("string")
    def refuse(text):
        assert text.isna().all()
        return text

    held, tx.decompose = tx.decompose, refuse
    try:
        got = spark.createDataFrame([("Crème brûlée",)], "t string").select(tx.strip_accents("t"), tx.basic_tokens(F.col("t"))).first()
    finally:
        tx.decompose = held
    assert got[0] == "Creme brulee" and got[1] == ["creme", "brulee"]


def test_tokens_of_one_pass(spark):
    given = spark.createDataFrame([(t,) for t in [*ODD, "".join(ODD), None]], "t string")
    both = given.select("t", tx.basic_tokens(F.col("t")).alias("one"), tx.words(tx.basic_text(F.col("t"))).alias("many")).collect()
    assert [(r["t"], r["one"]) for r in both] == [(r["t"], r["many"]) for r in both]


def test_tokens_of_a_chat_are_those_of_its_parts(spark):
    given = spark.createDataFrame([(t,) for t in ODD], "t string")
    start, end = f"{prompts.DEFAULT_SYSTEM}{prompts.TURN_START}user\n", prompts.TURN_END + prompts.GENERATION_PROMPT
    parts = F.concat(tx.basic_tokens(F.lit(start)), tx.basic_tokens(F.col("t")), tx.basic_tokens(F.lit(end)))
    assert given.filter(parts != tx.basic_tokens(F.concat(F.lit(start), "t", F.lit(end)))).isEmpty()


def test_lists_of_several_slices(spark):
    n = 2 * SLICE_ROWS + 88
    lists = spark.range(0, n, 1, 1).selectExpr("id as k", "case when id % 7 = 0 then null else transform(sequence(0, id % 5), i -> concat('t', id + i)) end as tokens")
    known = spark.range(0, n, 1, 1).selectExpr("id", "concat('t', id) as token")
    got = {r["k"]: r["ids"] for r in vocab.id_lists(lists, known, "k", unknown=-1).collect()}
    assert got == {k: None if k % 7 == 0 else [k + i if k + i < n else -1 for i in range(k % 5 + 1)] for k in range(n)}
