"""Functions of array columns: norms, divergences, distances of label sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def p_norm(v: Column, p: float | str = 2) -> Column:
    """The p-norm of an array; 'INF' gives its largest magnitude."""
    if p == "INF":
        return F.array_max(F.transform(v, F.abs))
    if p == 1:
        return total(F.transform(v, F.abs))
    if p == 2:
        return F.sqrt(total(F.transform(v, lambda x: x * x)))
    return F.pow(total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(1.0 / p))


def unit(v: Column, p: float | str = 1) -> Column:
    """v over its p-norm; null for a norm of 0."""
    norm = p_norm(v, p)
    return F.when(norm != 0, F.transform(v, lambda x: x / norm))


def smoothed(q: Column) -> Column:
    """Absolute discounting: a hundredth of the least positive value is added to all, then the sum is made 1."""
    least = F.array_min(F.filter(q, lambda x: x > 0)) / 100
    raised = F.transform(q, lambda x: x + least)
    return F.transform(raised, lambda x: x / total(raised))


def kl_divergence(p: Column, q: Column, base: float | None = None) -> Column:
    """sum p log(p/q) where p > 1e-7; q is smoothed if it has an exact 0."""
    q = F.when(F.array_contains(q, 0.0), smoothed(q)).otherwise(q)
    d = total(F.zip_with(p, q, lambda a, b: F.when(a > 1e-7, a * (F.log(a) - F.log(b))).otherwise(0.0)))
    return d if base is None else d / F.log(F.lit(float(base)))


def symmetric_kl(p: Column, q: Column, base: float | None = None) -> Column:
    """sum (p - q) log(p/q); null where a value is 0."""
    d = total(F.zip_with(p, q, lambda a, b: (a - b) * F.log(F.try_divide(a, b))))
    return d if base is None else d / F.log(F.lit(float(base)))


def js_divergence(p: Column, q: Column, base: float = 2.0) -> Column:
    """Half the divergences of both from their mean."""
    mean = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    return (kl_divergence(p, mean, base) + kl_divergence(q, mean, base)) / 2


def _size(a: Column) -> Column:
    return F.size(a).cast("double")


def masi(a: Column, b: Column) -> Column:
    return 1 - _size(F.array_intersect(a, b)) / F.greatest(_size(a), _size(b))


def binary(a: Column, b: Column) -> Column:
    return F.when(F.array_sort(a) == F.array_sort(b), 0.0).otherwise(1.0)


def interval(a: Column, b: Column) -> Column:
    """Squared count of labels of a that b lacks; not symmetric."""
    return F.pow(_size(F.array_except(a, b)), F.lit(2.0))


def numeric(a: Column, b: Column) -> Column:
    """Squared difference of single numeric labels."""
    return F.pow(a[0].cast("double") - b[0].cast("double"), F.lit(2.0))


def example(a: Column, b: Column) -> Column:
    """1 between stat and ireq, a half between either and chck, 0 between equals, else 1 (fixed values)."""
    has = lambda x, y: (F.array_contains(a, x) & F.array_contains(b, y)) | (F.array_contains(a, y) & F.array_contains(b, x))
    return F.when(F.array_sort(a) == F.array_sort(b), 0.0).when(has("stat", "ireq"), 1.0).when(has("stat", "chck") | has("ireq", "chck"), 0.5).otherwise(1.0)


#: Distances by name.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {"masi": masi, "binary": binary, "interval": interval, "example": example, "numeric": numeric}
