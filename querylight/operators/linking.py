"""Schema linking: the catalogue entries a query text mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylight.functions.sqltext import identifiers
from querylight.session import by_merge


def schema_link(examples: DataFrame, cols: DataFrame) -> DataFrame:
    """`(id, kind, name)`: tables and columns of the example's database whose name occurs in its query."""
    entry = F.array(
        F.struct(F.lit("table").alias("kind"), F.lower("tab").alias("name")),
        F.struct(F.lit("column").alias("kind"), F.lower("col").alias("name")),
    )
    names = cols.select("db_id", F.explode(entry).alias("e")).select("db_id", "e.*").distinct()
    tokens = examples.select("id", "db_id", F.explode(identifiers(F.col("sql"))).alias("name"))
    return tokens.join(by_merge(names), ["db_id", "name"]).select("id", "kind", "name")
