"""Expressions on arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, not once per array element that uses it."""
    return F.transform(F.array(value), body)[0]


def _shifted(values: Column | str) -> Column:
    values = F.col(values) if isinstance(values, str) else values
    return F.struct(values.alias("v"), F.array_max(values).alias("m"))


def softmax(values: Column | str) -> Column:
    """Softmax, shifted by the maximum."""
    powers = let(_shifted(values), lambda s: F.transform(s["v"], lambda v: F.exp(v - s["m"])))
    summed = let(powers, lambda x: F.struct(x.alias("x"), total(x).alias("t")))
    return let(summed, lambda s: F.transform(s["x"], lambda x: x / s["t"]))


def log_softmax(values: Column | str) -> Column:
    def normed(s: Column) -> Column:
        norm = F.log(total(F.transform(s["v"], lambda v: F.exp(v - s["m"]))))
        return F.struct(s["v"].alias("v"), (s["m"] + norm).alias("n"))

    return let(let(_shifted(values), normed), lambda s: F.transform(s["v"], lambda v: v - s["n"]))


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def top_k(values: Column, k: int) -> Column:
    """The k largest as structs `(w, e)`: weight descending, then position ascending."""
    marked = F.transform(values, lambda w, i: F.struct((-w).alias("m"), i.alias("e"), w.alias("w")))
    best = F.slice(F.array_sort(marked), 1, k)
    return F.transform(best, lambda c: F.struct(c["e"].alias("e"), c["w"].alias("w")))
