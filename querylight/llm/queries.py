"""The queries opN_<name> over the given tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from querylight.llm import (  # noqa: F401
    dart_minhash,
    decontaminate,
    exact_fill,
    language_id,
    line_templates,
    lm_score,
    merkle,
    packing,
    prefix_trie,
    repeat_index,
    simhash,
    url_reputation,
    warc,
)
from querylight.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
