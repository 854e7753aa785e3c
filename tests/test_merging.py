import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querylight.functions import text as tx
from querylight.operators import merging, vocab
from querylight.operators.pieces import PieceAutomaton
from querylight.sources.files import read_tokenizer
from test_tokens import plain_bpe

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SAMPLES = ["I'm here,  now!\n\nüber 12,5 % 北京 🙂", "", " ", "a\x00b", "x" * 3000, "der die das und ein eine Größe"]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=3), st.text("abc", min_size=1, max_size=3)), max_size=12, unique=True), st.text("abcd", max_size=16))
def test_any_table_of_merges(pairs, word):
    ranks = {pair: rank for rank, pair in enumerate(pairs)}
    assert merging.merge_word(word, ranks) == plain_bpe(word, ranks)


def test_long_words_take_no_square_time():
    word = "ab" * 100_000
    assert merging.merge_word(word, {("a", "b"): 0, ("ab", "ab"): 1}) == ["abab"] * 50_000


def test_arrays_and_joins_agree(spark, monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(120)})
    pairs = [("a", "b"), ("ab", "c"), ("b", "c"), ("a", "a"), ("aa", "aa"), ("c", "ab"), ("abc", "abc"), ("a", "b")]
    merges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "left string, right string, rank int")
    frame = spark.createDataFrame([(w,) for w in [*words, *words, None]], "word string")
    near = {r["word"]: r["pieces"] for r in vocab.bpe(frame, merges).collect()}
    monkeypatch.setattr(merging, "MERGE_BYTES", 0)
    far = {r["word"]: r["pieces"] for r in vocab.bpe(frame.filter("word is not null"), merges).collect()}
    assert near.pop(None) is None and near == far
    assert near == {w: plain_bpe(w, {p: pairs.index(p) for p in pairs}) for w in words}


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_corpus_ids_match_the_tokenizer(spark, monkeypatch, limit):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"))
    docs = docs.limit(30).union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(SAMPLES)], "doc_id long, text string"))
    docs = docs.union(spark.createDataFrame([(2 * 10**6, None)], "doc_id long, text string"))
    merges, entries = read_tokenizer(spark, f"file://{TOKENIZER}")
    monkeypatch.setattr(merging, "MERGE_BYTES", limit)
    lists = docs.select("doc_id", "text", F.transform(tx.pretokens(F.col("text")), merging.byte_text).alias("tokens"))
    got = {r["doc_id"]: r["ids"] for r in merging.encode_lists(lists, "doc_id", "tokens", merges, entries).collect()}
    exact = Tokenizer.from_file(TOKENIZER)
    want = {r["doc_id"]: None if r["text"] is None else exact.encode(r["text"], add_special_tokens=False).ids for r in docs.collect()}
    assert got == want
    lost = spark.createDataFrame([(1, ["zz", "<x>", "a"]), (2, ["<x>"]), (3, [])], "k int, tokens array<string>")
    few = spark.createDataFrame([("a", 7)], "token string, id long")
    ids = {r["k"]: r["ids"] for r in merging.encode_lists(lost, "k", "tokens", merges, few, unknown=0, specials=["<x>"]).collect()}
    assert ids[1] in ([0, 8, 7], [0, 0, 8, 7]) and ids[2] == [8] and ids[3] == []


def test_bytes_shown_and_read(spark):
    frame = spark.createDataFrame([(t,) for t in [*SAMPLES, "".join(map(chr, range(300)))]], "t string")
    shown = frame.select("t", merging.byte_text(F.col("t")).alias("b")).withColumn("back", merging.text_of_bytes(F.col("b")))
    for row in shown.collect():
        assert row["back"] == row["t"] and len(row["b"]) == len(row["t"].encode())


def longest_first(word, tokens):
    start, out = 0, []
    while start < len(word):
        end = next((e for e in range(len(word), start, -1) if ("##" if start else "") + word[start:e] in tokens), None)
        if end is None:
            return None
        out.append(("##" if start else "") + word[start:end])
        start = end
    return out


PIECE = st.text("ab#", min_size=1, max_size=4)


@settings(deadline=None, max_examples=500)
@given(st.lists(st.one_of(PIECE, PIECE.map(lambda t: "##" + t)), max_size=14), st.lists(st.text("ab#c", max_size=10), max_size=8))
def test_automaton_splits_longest_first(tokens, words):
    automaton = PieceAutomaton(tokens)
    for word in words:
        assert automaton.pieces(word) == longest_first(word, set(tokens))


def test_wordpiece_by_join_agrees(spark, monkeypatch):
    rng = random.Random(3)
    tokens = ["un", "##aff", "##able", "a", "b", "##b", "##c", "ab", "##bc", "#", "###"]
    words = ["unaffable", "x", "a" * 201, "ab" * 100, "##", ""] + ["".join(rng.choice("abc#") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    entries = spark.createDataFrame(list(enumerate(tokens)), "id long, token string")
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    near = {r["word"]: r["pieces"] for r in vocab.wordpiece(frame, entries).collect()}
    monkeypatch.setattr(vocab, "VOCAB_BYTES", 0)
    assert near == {r["word"]: r["pieces"] for r in vocab.wordpiece(frame, entries).collect()}
    assert near["a" * 201] == ["[UNK]"] and near[""] == []


def test_ids_by_join_agree(spark, monkeypatch):
    entries = spark.createDataFrame([(0, "a"), (5, "b"), (2, "b"), (9, None)], "id long, token string")
    lists = spark.createDataFrame([(1, ["a", "b", "c", None]), (2, None), (3, []), (4, ["<x>", "a"])], "k long, tokens array<string>")
    ids = lambda: {r["k"]: r["ids"] for r in vocab.id_lists(lists, entries, "k", unknown=0, specials=["<x>"]).collect()}
    near = ids()
    monkeypatch.setattr(vocab, "VOCAB_BYTES", 0)
    assert near == ids() == {1: [0, 2, 0, 0], 2: None, 3: [], 4: [10, 0]}
