import __spark_entry__ as entrypoint
from odd import SF, no_documents, odd_documents
from oracle_compare import compare, duck
from querylight.llm.line_templates import drop_recurring_lines, drop_templates


def test_query_matches_sql(spark):
    ok, note = compare(spark, duck(SF), "op9_line_templates", SF)
    assert ok, note


def kept(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = drop_templates(docs, **options).orderBy("doc_id").collect()
    return [(r["text"], r["n_dropped"]) for r in rows]


def test_recurring_lines_stay_once(spark):
    texts = [f"{w} {w * 2} {w * 3}\nAll rights reserved.\n\n{w} last" for w in "abcdef"]
    got = kept(spark, texts)
    assert got[0] == (texts[0], 0)
    assert all(t == x.replace("All rights reserved.\n", "") and n == 1 for (t, n), x in zip(got[1:], texts[1:]))


def test_variable_fields_share_a_template(spark):
    numbers = [f"Page {i} of {i + 7}\nbody {'xyzuvw'[i] * 3}" for i in range(6)]
    assert [n for _, n in kept(spark, numbers)] == [0, 1, 1, 1, 1, 1]
    names = [f"Posted by user {w} on our great community board\n{w} wrote" for w in ("anna", "bert", "cleo", "dora", "emil", "fritz")]
    assert [n for _, n in kept(spark, names)] == [0, 1, 1, 1, 1, 1]
    prose = [f"The {a} went to {b} and saw the {c}" for a, b, c in zip("abcdef", "ghijkl", "mnopqr")]
    assert [n for _, n in kept(spark, prose)] == [0] * 6


def test_a_document_counts_once_for_a_template(spark):
    said = [f"Posted by user {w} on our great community board" for w in ("anna", "bert", "cleo", "dora", "emil", "fritz")]
    assert [n for _, n in kept(spark, ["\n".join(said[:4]), said[4]])] == [0, 0]
    assert [n for _, n in kept(spark, ["\n".join(said[:2]), *said[2:5]])] == [0, 0, 0, 0]
    assert [n for _, n in kept(spark, ["\n".join(said[:2]), *said[2:]])] == [0, 1, 1, 1, 1]


def test_long_lines_are_read_whole(spark):
    long = " ".join(f"w{chr(97 + i % 26)}x" for i in range(60_000))
    texts = [f"start of it {long} {w}" for w in ("anna", "bert", "cleo", "dora", "emil")]
    # The last line lacks a word that the others hold at their 60,003rd place, so it is no line of their template.
    assert [n for _, n in kept(spark, [*texts, f"start of it {long[:-2]} emil"])] == [0, 1, 1, 1, 1, 0]


def test_repetition_inside_one_document_stays(spark):
    assert kept(spark, ["same line here\n" * 50, "other"])[0][1] == 0


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = drop_templates(docs, min_docs=2)
    rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.count() == 12 and rows[(2, None)]["n_dropped"] == 0
    assert drop_recurring_lines(docs).columns == docs.columns
    assert drop_recurring_lines(no_documents(spark)).count() == 0
    assert set(entrypoint.oracle_sql()) >= {"op9_line_templates"}
