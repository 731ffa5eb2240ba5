"""Checks as queries: each gives rows only for what is wrong, or raises when a row is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def allow_columns(df: DataFrame, allowed: list[str], forbidden: list[str] = ()) -> DataFrame:
    """Refuses, before anything runs, columns that are not allowed."""
    odd = [c for c in df.columns if c not in allowed or c in forbidden]
    if odd:
        raise ValueError(f"columns not allowed: {', '.join(odd)}")
    return df


def no_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of keys that several rows have."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def refuse(df: DataFrame, wrong: Column, message: str) -> DataFrame:
    """df; running it raises if ``wrong`` holds anywhere."""
    return df.where(F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, check: one row for every check that a row fails (a null test counts as failed)."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return df.select(key, F.explode(failed).alias("check"))


def summary(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, n_failed, n, for all checks, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"__{name}") for name, ok in checks.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"__{name}").alias("n_failed")) for name in checks])
    return counts.select("n", F.explode(rows).alias("r")).select("r.check", "r.n_failed", "n")


def conditions_complete(df: DataFrame, unit: str, condition: str, expected: list[str], fingerprint: str) -> DataFrame:
    """unit, problem: duplicate, unknown or missing conditions, and mixed fingerprints."""
    g = df.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.collect_set(condition).alias("c"), F.countDistinct(fingerprint).alias("f"))
    want = F.lit(expected)
    problems = {"duplicate": F.col("n") > F.size("c"), "unknown": F.size(F.array_except("c", want)) > 0, "missing": F.size(F.array_except(want, "c")) > 0, "fingerprints": F.col("f") > 1}
    return g.select(unit, F.explode(F.array_compact(F.array(*[F.when(t, F.lit(p)) for p, t in problems.items()]))).alias("problem"))


def degenerate(df: DataFrame, metrics: list[str], n: str, least: int) -> DataFrame:
    """Strata of at least ``least`` rows whose metrics are all 0 or all 1."""
    same = lambda v: reduce(lambda a, b: a & b, [F.col(m) == v for m in metrics])
    return df.where((F.col(n) >= least) & (same(0.0) | same(1.0)))


def attach_verified(df: DataFrame, sidecar: DataFrame, keys: list[str], content: Column, digest: str) -> DataFrame:
    """df with its sidecar row; a sidecar with several rows of a key, without a row in df or with
    another digest of the content raises."""
    counted = sidecar.join(sidecar.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys)
    both = df.withColumn("__own", F.lit(True)).join(counted, keys, "full")
    both = refuse(both, F.col("__n") > 1, "several sidecar rows of one key")
    both = refuse(both, F.col("__own").isNull(), "a sidecar row without a record")
    both = refuse(both, F.col(digest).isNotNull() & (F.sha2(content.cast("binary"), 256) != F.col(digest)), "content does not match its digest")
    return both.drop("__n", "__own")
