"""Catalogues in dict form: one JSON object per database, tables as its keys, read as VARIANT.

A table is `{header, type, column_description, table_description, enumerations}`, all but `header`
optional; `enumerations` has a list of values per column, or `{values, desc}`. The reserved key
`foreign_key_map` holds pairs `[a.x, b.y]`. The results are the flat forms of `operators.catalog`.

Tables without content are skipped. A type or description beyond the end of its list is missing. A JSON text
that cannot be read gives no rows and is listed by `unreadable`; entries that are no objects are skipped, and values
that are no texts become texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the reserved key.
KEY_MAP = "foreign_key_map"


def unreadable(catalogs: DataFrame) -> DataFrame:
    """The databases of (db_id, catalog) whose JSON text is missing or malformed."""
    return catalogs.filter(F.try_parse_json("catalog").isNull()).select("db_id")


def _part(variant: str | Column, path: str, kind: str) -> Column:
    return F.try_variant_get(variant, path, kind)


def layout(catalogs: DataFrame) -> DataFrame:
    """(db_id, tab_idx, tab, header, types, descriptions, table_description, enums, pairs): one row per key of each catalogue.

    `enums` has the values and the description of each enumerated column; `pairs` is the key map, in the row of that key.
    Each text is parsed once, and each part taken from the VARIANT once: nothing is filtered by what is parsed, as a filter
    would parse again below. A VARIANT keeps its fields sorted by name, so the place of a table comes from the text's own keys.
    """
    parsed = catalogs.select("db_id", F.json_object_keys("catalog").alias("names"), F.try_parse_json("catalog").alias("v"))
    fields = catalogs.sparkSession.tvf.variant_explode(F.col("v").outer())
    tab, content = F.col("key"), F.col("value")
    is_table = tab != KEY_MAP
    # A list has no description: a path into it leads nowhere.
    listed = F.transform_values(
        _part(content, "$.enumerations", "map<string, variant>"),
        lambda _, e: F.struct(F.coalesce(_part(e, "$", "array<string>"), _part(e, "$.values", "array<string>")).alias("values"), _part(e, "$.desc", "string").alias("desc")),
    )
    return parsed.lateralJoin(fields).filter(tab.isNotNull()).select(
        "db_id",
        (F.array_position("names", tab) - 1).cast("int").alias("tab_idx"),
        tab.alias("tab"),
        F.when(is_table, _part(content, "$.header", "array<string>")).alias("header"),
        _part(content, "$.type", "array<string>").alias("types"),
        _part(content, "$.column_description", "array<string>").alias("descriptions"),
        F.coalesce(_part(content, "$.table_description", "string"), F.lit("")).alias("table_description"),
        F.when(is_table, listed).alias("enums"),
        F.when(~is_table, _part(content, "$", "array<array<string>>")).alias("pairs"),
    )


def as_layout(catalogs: DataFrame) -> DataFrame:
    """The layout of catalogues; a layout passes through, so that a caller who needs several forms parses once."""
    return catalogs if "header" in catalogs.columns else layout(catalogs)


def _each(column: str, rows: DataFrame, make: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows that `make` gives for the elements of an array; an outer explode brings no filter that reads the array twice."""
    made = rows.select("db_id", "tab_idx", "tab", F.transform(column, make).alias("made"))
    return made.select("db_id", "tab_idx", "tab", F.explode_outer("made").alias("made")).filter("made is not null")


def _column(col: Column, i: Column) -> list[Column]:
    return [
        i.alias("col_idx"),
        col.alias("col"),
        F.get("types", i).alias("type"),
        F.get("descriptions", i).alias("description"),
        F.col("table_description").alias("table_description"),
    ]


def _key(pair: Column, i: Column) -> list[Column]:
    one, two = (F.split(F.get(pair, F.lit(k)), r"\.") for k in (0, 1))
    return [i.alias("fk_idx"), F.get(one, F.lit(0)).alias("t1"), F.get(one, F.lit(1)).alias("c1"), F.get(two, F.lit(0)).alias("t2"), F.get(two, F.lit(1)).alias("c2")]


def flatten_dict(catalogs: DataFrame) -> DataFrame:
    """(db_id, tab_idx, tab, col_idx, col, type, description, table_description) of (db_id, catalog)."""
    return _each("header", as_layout(catalogs), lambda c, i: F.struct(*_column(c, i))).select("db_id", "tab_idx", "tab", "made.*")


def enum_lists(catalogs: DataFrame) -> DataFrame:
    """(db_id, tab, col, values, enum_desc): the values of each column as one list; a plain list has no description."""
    given = as_layout(catalogs).select("db_id", "tab", F.explode_outer("enums").alias("col", "entry")).filter("col is not null")
    return given.select("db_id", "tab", "col", "entry.values", F.col("entry.desc").alias("enum_desc"))


def enumerations(catalogs: DataFrame) -> DataFrame:
    """(db_id, tab, col, value, enum_desc): every listed value."""
    return enum_lists(catalogs).select("db_id", "tab", "col", F.explode("values").alias("value"), "enum_desc")


def foreign_keys(catalogs: DataFrame) -> DataFrame:
    """(db_id, fk_idx, t1, c1, t2, c2) of the key map."""
    return _each("pairs", as_layout(catalogs), lambda p, i: F.struct(*_key(p, i))).select("db_id", "made.*")


def flatten_all(catalogs: DataFrame) -> DataFrame:
    """The columns of `flatten_dict` with n_values, enum_desc and the sorted enum_text of their enumeration, and the keys as
    rows of table -1: fk_idx, c1, t2 and c2 stand for col_idx, col, type and description, t1 for tab.

    One pass over the texts, without join or shuffle.
    """
    nothing = F.lit(None).cast("string")

    def column(col: Column, i: Column) -> Column:
        entry = F.try_element_at("enums", col)
        entry = F.when(F.size(entry["values"]) > 0, entry)
        return F.struct(
            F.col("tab_idx").alias("tab_idx"), F.col("tab").alias("tab"), *_column(col, i),
            F.coalesce(F.size(entry["values"]).cast("long"), F.lit(0).cast("long")).alias("n_values"), entry["desc"].alias("enum_desc"),
            F.array_join(F.sort_array(entry["values"]), "|").alias("enum_text"),
        )

    def key(pair: Column, i: Column) -> Column:
        fk_idx, t1, c1, t2, c2 = _key(pair, i)
        return F.struct(
            F.lit(-1).alias("tab_idx"), t1.alias("tab"), fk_idx.alias("col_idx"), c1.alias("col"), t2.alias("type"), c2.alias("description"),
            F.lit("").alias("table_description"), F.lit(0).cast("long").alias("n_values"), nothing.alias("enum_desc"), nothing.alias("enum_text"),
        )

    rows = F.when(F.col("pairs").isNotNull(), F.transform("pairs", key)).otherwise(F.transform("header", column))
    made = as_layout(catalogs).select("db_id", rows.alias("made"))
    return made.select("db_id", F.explode_outer("made").alias("made")).filter("made is not null").select("db_id", "made.*")
