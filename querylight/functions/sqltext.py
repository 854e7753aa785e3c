"""Expressions on query texts; none of them parses a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylight.functions.strings import strip_blank

# The patterns that decide the results below.
FENCE_PATTERN = r"(?s)```sql(.*?)```"
KEYWORD_PATTERN = r"(?i)\b(JOIN|GROUP BY|WHERE)\b"
LIMIT_PATTERN = r"(?i)\bLIMIT\b\s*\d+"


def last_fence(text: Column) -> Column:
    """Content of the last fenced sql block, or the whole text when there is none."""
    blocks = F.regexp_extract_all(text, F.lit(FENCE_PATTERN), F.lit(1))
    return F.coalesce(strip_blank(F.try_element_at(blocks, F.lit(-1))), text)


def has_keywords(sql: Column) -> Column:
    """A join, grouping or filter keyword occurs as a word."""
    return sql.rlike(KEYWORD_PATTERN)


def add_limit(sql: Column, limit: int = 100) -> Column:
    """End with `LIMIT n;` unless a row limit is there already."""
    bare = F.regexp_replace(sql, r"[ ;\t\n\r]+$", "")
    return F.concat(bare, F.when(bare.rlike(LIMIT_PATTERN), ";").otherwise(f" LIMIT {limit};"))


def terminate(sql: Column) -> Column:
    """End with a semicolon."""
    return F.when(strip_blank(sql).endswith(";"), sql).otherwise(F.concat(sql, F.lit(";")))


def identifiers(sql: Column) -> Column:
    """Distinct identifier-like words of any script, lower-cased."""
    words = F.regexp_extract_all(sql, F.lit(r"(?U)[\p{L}_]\w*"), F.lit(0))
    return F.array_distinct(F.transform(words, F.lower))


def normal_text(sql: Column) -> Column:
    """Comments, identifier quotes, final semicolons and extra blanks removed, lower case outside string literals."""
    bare = F.regexp_replace(sql, r"('[^']*')|--[^\n]*|/\*[\s\S]*?\*/", "$1")
    pieces = F.regexp_extract_all(bare, F.lit(r"'[^']*'|[^']+|'"), F.lit(0))

    def tidy(piece: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.lower(piece), r'["`]', ""), r"\s+", " ")
        return F.when(piece.startswith("'"), piece).otherwise(plain)

    return F.regexp_replace(F.array_join(F.transform(pieces, tidy), ""), r"^\s+|[\s;]+$", "")
