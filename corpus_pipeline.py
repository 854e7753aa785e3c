"""The corpus pipeline: documents in, packed token windows out.

Each stage works on the rows that the one before has kept and wrote:

- `language_id` drops documents without a recognisable language;
- `line_templates` drops recurring lines from all documents but the first that holds them, and
  brings n_chars up to date; a document whose lines all go stays with an empty text;
- `near_duplicates` keeps the smallest doc_id of each near-duplicate class;
- `decontamination` drops documents with benchmark passages in a twentieth of their words or more;
- `packing` cuts and packs the tokens of what is left.

Null and empty texts go at the first stage. Repeated rows are copies of each other, of which the third stage
keeps one; ties there go to the smallest id, then to the smallest hash of the row. Texts of any length are judged
whole by each stage. Extra columns are carried through all stages but the last. An empty table passes through all stages
as an empty table.

What a stage writes on its way is deleted when its result is written, and each result when the next one is. Stages that run
Python set the session to small Arrow batches, so that rows on their way there take little memory beside the heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querylight.llm.dart_minhash import keep_one
from querylight.llm.decontaminate import drop_contaminated
from querylight.llm.language_id import drop_rejected
from querylight.llm.line_templates import drop_recurring_lines
from querylight.llm.packing import pack_documents
from querylight.llm.registry import table
from querylight.session import release, scratch, small_arrow_batches, stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_arrow_batches(spark)
    return drop_rejected(docs)


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_arrow_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_arrow_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_templates", line_templates),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Trained models, hashed signatures and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(step(spark, docs, sf_dir), name))
        if before is not None:
            release(before)
        before = docs
    name, step = STAGES[-1]
    return step(spark, docs, sf_dir)
