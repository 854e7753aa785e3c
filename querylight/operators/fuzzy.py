"""Similarity join of names under Jaro-Winkler, by an index with a proven bound.

Two names of lengths a and b that share o characters (as multisets) have a Jaro similarity of at most
(o/a + o/b + 1) / 3, so a similarity of j needs o >= (3j - 1) ab / (a + b), and lengths within a factor of 3j - 2.
Jaro-Winkler adds to Jaro above 0.7 only, and at most leads to 0.6 j + 0.4.

A name's elements are its characters with their occurrence (the second `a` is an element of its own), rarest first. Names
that share o elements also share one among the first a - o + 1 of the one and b - o + 1 of the other, so only those are
index keys, apart for each pair of length bands, with the overlap that the shortest names of the other band need.
Names that meet in a key are then bounded by 128-bit masks of their elements, and what is left is computed exactly.
Keys with many names are dealt out by salt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylight.functions.strings import jaro_winkler
from querylight.session import fan_out, stage

RANKED_ELEMENTS = 4096  # most frequent elements that get a rank; all others are rarer and come first
BAND = 1.5  # lengths of a band lie within this factor
PER_SALT = 2000
SLACK = 1e-9


def text_similarity(pairs: DataFrame, left: str, right: str, out: str = "similarity") -> DataFrame:
    """Jaro-Winkler similarity of two text columns, computed once per distinct text pair."""
    distinct = fan_out(pairs.filter(F.col(left) != F.col(right)).select(left, right).distinct())
    scored = distinct.withColumn(out, jaro_winkler(F.col(left), F.col(right)))
    same = F.when(F.col(left) == F.col(right), 1.0)
    return pairs.join(scored, [left, right], "left").withColumn(out, F.coalesce(F.col(out), same))


def least_jaro(at_least: float) -> float:
    """The Jaro similarity that a Jaro-Winkler similarity of `at_least` needs."""
    return at_least if at_least <= 0.7 else max(0.7, (at_least - 0.4) / 0.6)


def _needed(jaro: float, a: Column, b: Column) -> Column:
    """Characters that names of these lengths must share at least."""
    return F.greatest(F.lit(1), F.ceil((3 * jaro - 1) * a * b / (a + b) - SLACK))


def _mask(elements: Column, half: int) -> Column:
    """The elements' bits among 128, the lower or the upper 64 of them."""

    def bit(e: Column) -> Column:
        place = F.pmod(F.xxhash64(F.lit(1), e), F.lit(128))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
        return F.when(F.floor(place / 64) == half, one).otherwise(F.lit(0).cast("long"))

    return F.aggregate(elements, F.lit(0).cast("long"), lambda acc, e: acc.bitwiseOR(bit(e)))


def _indexed(names: DataFrame, name: str, block: list[str]) -> DataFrame:
    """Distinct names of a block: (block, name, n, id, len, band, elements rarest first, mask0, mask1)."""
    counted = names.filter(F.col(name).isNotNull()).groupBy(*block, F.col(name).alias("name")).agg(F.count("*").alias("n"))
    chars = F.array_sort(F.filter(F.split("name", ""), lambda c: c != ""))
    listed = counted.withColumn("chars", chars).withColumn("id", F.xxhash64(F.lit(3), *block, "name"))
    occurrence = F.transform("chars", lambda c, i: F.concat(c, (i - F.array_position("chars", c) + 2).cast("string")))
    listed = stage(listed.withColumn("elements", occurrence).drop("chars"), "names")
    each = listed.select("id", *block, "name", F.explode("elements").alias("e"))
    # Any one order gives right results; frequent elements last keeps the keys small.
    ranks = each.groupBy("e").agg(F.count("*").alias("often")).orderBy(F.desc("often"), "e").limit(RANKED_ELEMENTS)
    ordered = each.join(F.broadcast(ranks), "e", "left").groupBy("id", *block, "name").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "e"))).alias("l")
    )
    with_order = listed.drop("elements").join(ordered, ["id", *block, "name"])
    elements = F.transform("l", lambda x: x["e"])
    whole = with_order.withColumn("elements", elements).drop("l").withColumn("len", F.size("elements"))
    band = F.floor(F.log(F.col("len").cast("double")) / math.log(BAND) + SLACK).cast("int")
    return stage(whole.withColumn("band", band).withColumn("mask0", _mask(F.col("elements"), 0)).withColumn("mask1", _mask(F.col("elements"), 1)), "index")


def candidates(names: DataFrame, name: str, block: list[str], at_least: float) -> DataFrame:
    """Pairs of different names of a block that the bounds leave: (block, left_name, right_name, left_rows, right_rows).

    A similarity of 0 or more asks for every pair there is.
    """
    if at_least <= 0:
        counted = names.filter(F.col(name).isNotNull()).groupBy(*block, F.col(name).alias("name")).agg(F.count("*").alias("n"))
        left, right = (counted.select(*block, F.col("name").alias(f"{x}_name"), F.col("n").alias(f"{x}_rows")) for x in ("left", "right"))
        return left.join(right, block).filter("left_name < right_name").select(*block, "left_name", "right_name", "left_rows", "right_rows")
    jaro = least_jaro(at_least)
    index = _indexed(names, name, block)
    bands = index.select(*block, F.col("band").alias("other"), F.col("len").alias("l")).groupBy(*block, "other").agg(F.min("l").alias("low"), F.max("l").alias("high"))
    met = index.join(bands, block).filter(
        (F.col("high") >= (3 * jaro - 2) * F.col("len") - SLACK) & (F.col("len") >= (3 * jaro - 2) * F.col("low") - SLACK)
    )
    first = F.col("len") - _needed(jaro, F.col("len"), F.col("low")) + 1
    bits = ["id", "name", "n", "len", "mask0", "mask1"]
    keys = met.filter(first > 0).select(
        *block, F.least("band", "other").alias("b0"), F.greatest("band", "other").alias("b1"), "band", *bits,
        F.explode(F.slice("elements", F.lit(1), first.cast("int"))).alias("e"),
    )
    keys = stage(keys, "keys")
    key = [*block, "b0", "b1", "e"]
    sizes = keys.groupBy(*key).agg(F.count("*").alias("size"))
    # Fewer than a row in PER_SALT of the index: keys of at least that many names.
    hot = sizes.filter(F.col("size") >= PER_SALT).withColumn("salts", F.ceil(F.col("size") / PER_SALT).cast("int"))
    salted = keys.join(hot.drop("size"), key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))

    def side(tag: str, salt: Column) -> DataFrame:
        return salted.select(*key, salt.alias("salt"), F.col("band").alias(f"{tag}_band"), *[F.col(c).alias(f"{tag}_{c}") for c in bits])

    left = side("left", F.pmod("id", F.col("salts")).cast("int"))
    right = side("right", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    apart = (F.col("b0") == F.col("b1")) | (F.col("left_band") != F.col("right_band"))
    a, b = F.col("left_len"), F.col("right_len")
    missing = [
        sum((F.bit_count(F.col(f"{x}_mask{i}").bitwiseAND(F.bitwise_not(f"{y}_mask{i}"))) for i in (0, 1)), F.lit(0))
        for x, y in (("left", "right"), ("right", "left"))
    ]
    # Every bit that only one of the two has is an element, at least, that the other lacks.
    shared = F.least(a - missing[0], b - missing[1])
    close = (shared / a + shared / b + 1) / 3 >= jaro - SLACK
    pairs = left.join(right, [*key, "salt"]).filter(apart & (F.col("left_name") < F.col("right_name")) & close)
    return pairs.select(*block, "left_name", "right_name", F.col("left_n").alias("left_rows"), F.col("right_n").alias("right_rows")).distinct()


def fuzzy_pairs(names: DataFrame, name: str, block: list[str], at_least: float) -> DataFrame:
    """All pairs of names that resemble each other within their block, each with how many rows hold it.

    (block, left_name, right_name, left_rows, right_rows, similarity), left_name before right_name; a name of several
    rows is paired with itself, so that the copies are those rows. Rows without a name or block have no pair.
    """
    met = stage(candidates(names, name, block, at_least), "candidates")
    scored = text_similarity(met, "left_name", "right_name").filter(F.col("similarity") >= at_least)
    copies = names.filter(F.col(name).isNotNull()).dropna(subset=block).groupBy(*block, F.col(name).alias("left_name")).agg(F.count("*").alias("left_rows"))
    same = copies.filter("left_rows > 1").select(
        *block, "left_name", F.col("left_name").alias("right_name"), "left_rows", F.col("left_rows").alias("right_rows"), F.lit(1.0).alias("similarity")
    )
    return scored.select(*block, "left_name", "right_name", "left_rows", "right_rows", "similarity").unionByName(same)


def fuzzy_join(names: DataFrame, key: str, name: str, block: list[str], at_least: float) -> DataFrame:
    """All similar pairs of different names, and each row's name, as rows of kind `pair` and `member`.

    (kind, block, key, left_name, right_name, similarity): a member has its key and name, a pair both names. Rows
    of the same name are members of one name, so copies are not multiplied.
    """
    nothing = F.lit(None)
    pairs = fuzzy_pairs(names, name, block, at_least).filter("left_name < right_name").select(
        F.lit("pair").alias("kind"), *block, nothing.cast(names.schema[key].dataType).alias(key), "left_name", "right_name", "similarity"
    )
    members = names.select(
        F.lit("member").alias("kind"), *block, key, F.col(name).alias("left_name"), nothing.cast("string").alias("right_name"), nothing.cast("double").alias("similarity")
    )
    return pairs.unionByName(members)
