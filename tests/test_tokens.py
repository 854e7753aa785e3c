import random
import unicodedata

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querylight.functions import text as tx
from querylight.operators import vocab as vb

SAMPLES = ["Don't stop, it's 12,5  %\n\n  now!\n", "  Émile naïve\tß ", "数据库ab查询　x", "a\u0000b�c​d", "", "   \n"]


def plain_basic(text):
    """Basic tokens the long way round."""
    kept = "".join(
        " " if c in "\t\n\r" or unicodedata.category(c) == "Zs" else c
        for c in text
        if c in "\t\n\r" or (c != "�" and unicodedata.category(c) not in ("Cc", "Cf"))
    )
    kept = "".join(f" {c} " if "一" <= c <= "鿿" else c for c in kept)
    folded = "".join(c for c in unicodedata.normalize("NFD", kept.lower()) if unicodedata.category(c) != "Mn")
    ascii_marks = set(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
    return "".join(f" {c} " if c in ascii_marks or unicodedata.category(c)[0] == "P" else c for c in folded).split()


def test_basic_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", tx.basic_tokens(F.col("t")).alias("x")).collect()}
    assert got == {i: plain_basic(t) for i, t in enumerate(SAMPLES)}


def test_pretokens_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    docs = docs.union(spark.createDataFrame([(t,) for t in SAMPLES], "text string"))
    for digits, pattern in ((False, tx.PRETOKEN), (True, tx.PRETOKEN_DIGITS)):
        rows = docs.select("text", tx.pretokens(F.col("text"), digits).alias("l")).collect()
        assert all(r["l"] == regex.findall(pattern, r["text"]) for r in rows)


def test_paragraphs(spark):
    df = spark.createDataFrame([("a\n\nb\n\n",), ("数x",)], "t string")
    rows = [r["x"] for r in df.select(F.transform(tx.paragraphs(F.col("t")), lambda t: tx.mark_ideographs(t)).alias("x")).collect()]
    assert rows == [["a\n\n", "b\n\n", ""], ["¦数¦x"]]


def word_frame(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def test_wordpiece_both_ways(spark):
    tokens = ["un", "##aff", "##able", "a", "b", "##b", "##c", "ab", "##bc"]
    vocab = spark.createDataFrame(list(enumerate(tokens)), "id long, token string")
    rng = random.Random(3)
    words = ["unaffable", "x", "a" * 201] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    local = {r["word"]: r["pieces"] for r in vb.wordpiece(word_frame(spark, words), vocab).collect()}
    joined = {r["word"]: r["pieces"] for r in vb.wordpiece(word_frame(spark, words), vocab).collect()}
    assert local == joined and len(local) == len(set(words))
    assert local["unaffable"] == ["un", "##aff", "##able"] and local["x"] == local["a" * 201] == ["[UNK]"]


def plain_bpe(word, ranks):
    parts = list(word)
    while True:
        found = [ranks[p] for p in zip(parts, parts[1:]) if p in ranks]
        if not found:
            return parts
        left, right = next(p for p, r in ranks.items() if r == min(found))
        i, out = 0, []
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (left, right):
                out.append(left + right)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


RANKS = {("a", "b"): 0, ("ab", "c"): 1, ("b", "c"): 2, ("a", "a"): 3, ("aa", "aa"): 4, ("c", "ab"): 5}


@settings(deadline=None, max_examples=300)
@given(st.text("abc", max_size=12))
def test_merge_word(word):
    assert vb.merge_word(word, RANKS) == plain_bpe(word, RANKS)


def test_bpe_and_pair_counts(spark):
    counts = spark.createDataFrame([("aba", 2), ("abab", 1), ("z", 9)], "word string, n long")
    pairs = {(r["left"], r["right"]): r["n"] for r in vb.pair_counts(counts).collect()}
    assert pairs == {("a", "b"): 3, ("b", "a"): 3}
    merges = vb.top_merges(vb.pair_counts(counts), 1)
    assert {r["word"]: r["pieces"] for r in vb.bpe(counts, merges).collect()} == {
        "aba": ["ab", "a"], "abab": ["ab", "ab"], "z": ["z"],
    }


def test_ids_and_text_both_ways(spark):
    vocab = vb.build_vocab(spark.createDataFrame([(["it", "is", "it", "!"],)], "tokens array<string>"), 2)
    lists = spark.createDataFrame([(1, ["it", "is", "##i", "!", "?"]), (2, [])], "k int, tokens array<string>")
    local = {r["k"]: r["ids"] for r in vb.id_lists(lists, vocab, "k").collect()}
    joined = {r["k"]: r["ids"] for r in vb.id_lists(lists, vocab, "k").collect()}
    assert local == joined and local[1][4] == 1 and local[2] == []
    assert vb.id_lists(lists, vocab, "k", unknown=0).filter("k = 1").first()["ids"][4] == 0
    ids = vb.id_lists(lists, vocab, "k")
    back = vb.token_lists(ids, vocab, "k").filter("k = 1")
    row = back.select(vb.tokens_to_text(F.col("tokens")).alias("t"), vb.pieces_to_text(F.col("tokens")).alias("p")).first()
    assert (row["t"], row["p"]) == ("it isi! [UNK]", " it isi ! [UNK]")


def test_only_unified_ideographs_stand_alone(spark):
    texts = {"a中㐀b": "a¦中¦¦㐀¦b", "\U00020000x": "¦\U00020000¦x", "豈y": "豈y", "\U00017000z": "\U00017000z", "﨎": "¦﨎¦"}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["m"] for r in frame.select("t", tx.mark_ideographs(F.col("t")).alias("m")).collect()}
    assert got == texts


def test_paragraph_tokens(spark):
    frame = spark.createDataFrame([("I'm at 北京站 42!\n\n中 ok\n\nend",)], "t string")
    tokens = frame.select(tx.paragraph_tokens(F.col("t")).alias("l")).first()["l"]
    assert tokens == ["I", "'m", " at", " ", "北", "京", "站", " 42", "!", "\n\n", "中", " ok", "\n\n", "end"]
    assert "".join(tokens) == "I'm at 北京站 42!\n\n中 ok\n\nend"


def test_special_tokens_follow_the_vocabulary(spark):
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "id long, token string")
    lists = spark.createDataFrame([(1, ["b", "<x>", "c", "<y>"]), (2, None), (3, [])], "k long, tokens array<string>")
    ids = {r["k"]: r["ids"] for r in vb.id_lists(lists, vocab, "k", unknown=0, specials=["<x>", "<y>"]).collect()}
    assert ids == {1: [1, 2, 0, 3], 2: None, 3: []}
