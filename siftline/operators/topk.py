"""Top-k, first-seen and hash-sampled rows. Every order ends with a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.functions.seq import hash_uniform, slice_at, starts
from siftline.operators.windows import running


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group with their rank (each task keeps k before the shuffle)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def best_row(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The row of largest ``order``, by aggregation (no sort)."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*by, "__r.*")


def first_groups(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """All rows of the n groups first seen in ``order``."""
    first = df.groupBy(group).agg(F.min(order).alias("__first")).orderBy("__first", group).limit(n)
    return df.join(first.select(group), group, "left_semi")


def sample_groups(df: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """All rows of the n groups of least hash."""
    kept = df.select(group).distinct().orderBy(hash_uniform(group, salt=str(seed)), group).limit(n)
    return df.join(kept, group, "left_semi")


def sample_rows(df: DataFrame, by: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """Up to n rows of each group, those whose keys hash lowest."""
    return top_k(df, by, [hash_uniform(key, salt=str(seed)).asc(), F.col(key).asc()], n).drop("rank")


def exactly(df: DataFrame, by: list[str], n: int) -> DataFrame:
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("__n") == n).drop("__n")


def flat_top(df: DataFrame, by: list[str], x: str, k: int) -> DataFrame:
    """by, best, top: the k largest values, filled with zeros."""
    kept = top_k(df.where(F.col(x).isNotNull()), by, [F.desc(x)], k)
    out = kept.groupBy(*by).agg(F.max(x).alias("best"), F.sort_array(F.collect_list(x), False).alias("top"))
    return out.withColumn("top", F.slice(F.concat("top", F.array_repeat(F.lit(0.0), k)), 1, k))


def stratified_split(df: DataFrame, key: str, stratum: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """train, val or test by hash order within strata; sizes are rounded half to even, test takes the rest."""
    placed = running(df, [stratum], [hash_uniform(key, salt=str(seed)), key])
    a, b = F.bround(F.col("__n") * ratios[0]), F.bround(F.col("__n") * ratios[1])
    split = F.when(F.col("__place") <= a, "train").when(F.col("__place") <= a + b, "val").otherwise("test")
    return placed.withColumn("split", split).drop("__place", "__n", "__sum")


def sample_windows(df: DataFrame, by: list[str], keys: list[str], s: str, length: int, n: int, seed: int = 0, accept: Column | None = None, weight: Column | None = None) -> DataFrame:
    """by, keys, start, word: n windows of ``length`` letters of each group, without replacement: of all windows of all
    its sequences that ``accept`` (a test of the column word; plain bases unless given) lets pass, each as likely
    as its ``weight`` (of the row and word; 1 unless given), so longer sequences give more. Weighted sampling by
    exponential keys: the n least of -ln(u) / weight are taken, u from a hash, so any engine repeats it."""
    rows = df.select(*dict.fromkeys([*by, *keys]), F.col(s).alias("__s"), F.explode(starts(s, length)).alias("start")).withColumn("word", slice_at("__s", F.col("start"), F.lit(length))).drop("__s")
    rows = rows.where(F.col("word").rlike("^[ACGT]+$") if accept is None else accept).withColumn("__w", (F.lit(1.0) if weight is None else weight).cast("double")).where("__w > 0")
    key = -F.log(1 - hash_uniform(*keys, "start", salt=str(seed))) / F.col("__w")
    first = Window.partitionBy(*by).orderBy(key, *keys, "start")
    return rows.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= n).drop("__n", "__w")
