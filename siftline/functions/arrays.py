"""Array, map and interval functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftline.functions.seq import col, ratio


def fit_length(a: Column | str, n: int, fill: Column) -> Column:
    """Cut or filled to n entries."""
    return F.slice(F.concat(col(a), F.array_repeat(fill, n)), 1, n)


def project(a: Column | str, inverse: Column | str, fill: Column) -> Column:
    """Entries of ``a`` at the places ``inverse`` names, ``fill`` where it is null or out of range."""
    return F.transform(col(inverse), lambda i: F.when(i >= 0, F.coalesce(F.get(col(a), i.cast("int")), fill)).otherwise(fill))


def invert(places: Column | str, n: Column | int) -> Column:
    """For each of n targets the least index that maps to it, else null."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.nullif(F.array_position(col(places), k), F.lit(0)) - 1)


def mean_valid(a: Column | str, start: Column | int, n: Column | int) -> Column:
    """struct(mean, valid): of entries that are neither null nor NaN, and their share."""
    as_col = lambda v: F.lit(v) if isinstance(v, int) else v
    part = F.slice(col(a), as_col(start) + 1, as_col(n))
    good = F.filter(part, lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(good, F.lit(0.0), lambda t, x: t + x)
    return F.struct(F.when(F.size(good) > 0, total / F.size(good)).alias("mean"), ratio(F.size(good).cast("double"), F.size(part)).alias("valid"))


def running_sum(a: Column | str) -> Column:
    return F.aggregate(col(a), F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x.cast("double")).otherwise(F.element_at(acc, -1) + x))))


def log_sum_exp(a: Column | str) -> Column:
    most = F.array_max(col(a))
    return most + F.log(F.aggregate(col(a), F.lit(0.0), lambda t, x: t + F.exp(x - most)))


def softmax(a: Column | str) -> Column:
    """Empty in, empty out."""
    return F.transform(col(a), lambda x: F.exp(x - log_sum_exp(a)))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(F.least(hi1, hi2) - F.greatest(lo1, lo2), F.lit(0))


def iou(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    both = overlap(lo1, hi1, lo2, hi2)
    return ratio(both.cast("double"), (hi1 - lo1) + (hi2 - lo2) - both)


def jaccard(a: Column | str, b: Column | str) -> Column:
    return ratio(F.size(F.array_intersect(col(a), col(b))).cast("double"), F.size(F.array_union(col(a), col(b))))


def counter(values: Column | str) -> Column:
    """map<value, count> with sorted keys, of an array."""
    keys = F.array_sort(F.array_distinct(col(values)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(col(values), lambda v: v == k))))


def reasons(**tests: Column) -> Column:
    """The names of the tests that hold."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def floor_percentile(sorted_values: Column, p: float) -> Column:
    """xs[min(int(n p / 100), n - 1)] of a sorted array: not interpolated."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.least(F.floor(n * F.lit(p) / 100).cast("int"), n - 1))
