"""Rows that operators must survive, and plain statements of what words are."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over a lazy dog and runs far away from here " * 3000


def words(text):
    return WORD.findall((text or "").translate(LOW))


def odd_documents(spark):
    """Null ids and texts, empty and long texts, repeated rows, and extra columns named like inner ones."""
    rows = [
        (1, "One fish two fish red fish blue fish, this one has a little star.", "en", "a", 64),
        (1, "One fish two fish red fish blue fish, this one has a little star.", "en", "a", 64),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (None, "a text without an id that has more than five words in it", None, "a", 10),
        (None, "a text without an id that has more than five words in it", None, "a", 10),
        (4, "!!! ??? ...", "en", None, 11),
        (4, "the id four again with another text of some more words", "en", None, 11),
        (5, LONG, "en", "b", len(LONG)),
        (6, LONG + "end", "en", "b", len(LONG) + 3),
        (7, "Größe und Höhe, été à la plage\n\n  \n123 456\nende", "de", "b", 30),
        (8, "x", "en", "b", 1),
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "id string, h int, node string, tokens string, score string, n_lines string, bucket long, rank int, length int"
    names = [c.split()[0] for c in extra.split(", ")]
    docs = spark.createDataFrame(rows, columns)
    casts = [f"cast(null as {c.split()[1]}) as `{c.split()[0]}`" for c in extra.split(", ")]
    return docs.selectExpr("*", *casts).select("doc_id", "text", "lang", "source", "n_chars", *names)


def no_documents(spark):
    return odd_documents(spark).limit(0)


def odd_items(spark):
    rows = [(1, "this one has a little star"), (2, "This one has a little star!"), (None, "jumps over a lazy dog"), (3, None), (4, "?"), (5, "")]
    return spark.createDataFrame(rows, "item_id long, text string")
