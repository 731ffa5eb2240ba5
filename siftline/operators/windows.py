"""Positional window functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.session import cut, partitions


def running(df: DataFrame, by: list[str], order: list[Column | str], value: Column | None = None) -> DataFrame:
    """Adds __place (from 1), __n (rows of the group) and __sum (``value`` up to the row), for groups of
    any size: rows are dealt by range of (by, order) and numbered in their part, and the sums of the
    parts before are added. ``order`` ends with a unique key. ``by`` may be empty."""
    n = max(partitions(df.sparkSession), 2)
    dealt = cut(df.withColumn("__v", F.lit(0) if value is None else value).repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row for each group and each part: groups that lie in one part need no more than that
    sums = dealt.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__c"), F.sum("__v").alias("__s"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c0"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"), F.sum("__c").over(Window.partitionBy(*by)).alias("__n"))
    on = reduce(lambda x, y: x & y, [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*by, "__part"]])
    rows = dealt.withColumns({"__place": F.row_number().over(own), "__sum": F.sum("__v").over(own)}).alias("r").join(offsets.alias("o"), on)
    return rows.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r.__place") + F.col("o.__c0")).alias("__place"), (F.col("r.__sum") + F.col("o.__s0")).alias("__sum"), F.col("o.__n").alias("__n"))


def following(df: DataFrame, by: list[str], order: list[Column | str], take: str) -> DataFrame:
    """Adds __next: ``take`` of the next row of the group in ``order``, of the first after the last."""
    placed = cut(running(df, by, order), "places")
    after = placed.select(*by, (F.pmod(F.col("__place") - 2, F.col("__n")) + 1).alias("__place"), F.col(take).alias("__next"))
    return placed.join(after, [*by, "__place"]).drop("__place", "__n", "__sum")


def peaks(df: DataFrame, by: list[str], pos: str, height: str, distance: int, least: float | None = None) -> DataFrame:
    """Rows that no other within ``distance`` positions exceeds; every row of a plateau is one."""
    around = Window.partitionBy(*by).orderBy(pos).rangeBetween(-distance, distance)
    top = df.withColumn("__top", F.max(height).over(around)).where(F.col(height) == F.col("__top")).drop("__top")
    return top if least is None else top.where(F.col(height) >= least)


def sliding_mean(df: DataFrame, by: list[str], pos: str, x: str, before: int, after: int, full: bool = False) -> DataFrame:
    """Mean of x over rows from ``before`` back to ``after`` on; with ``full``, null for shorter frames."""
    frame = Window.partitionBy(*by).orderBy(pos).rowsBetween(-before, after)
    mean = F.avg(x).over(frame)
    if full:
        mean = F.when(F.count(F.lit(1)).over(frame) == before + after + 1, mean)
    return df.withColumn("window_mean", mean)


def weighted_mean(df: DataFrame, by: list[str], pos: str, x: str, w: str, length: int, eps: float = 1e-9) -> DataFrame:
    """sum(x w) / sum(w) of the window that begins at a row; null where the weight is below eps or rows are missing."""
    frame = Window.partitionBy(*by).orderBy(pos).rowsBetween(0, length - 1)
    total = F.sum(F.when(F.col(x).isNotNull(), F.col(w))).over(frame)
    full = F.count(F.lit(1)).over(frame) == length
    return df.withColumn("weighted_mean", F.when(full & (total >= eps), F.sum(F.col(x) * F.col(w)).over(frame) / total))


def box_sum(df: DataFrame, by: list[str], i: str, j: str, x: str, radius: int) -> DataFrame:
    """Sum over the (2 radius + 1)^2 cells around each row of a grid; missing cells count 0. Two
    one-dimensional range frames: along i for every j that a row needs, then along j."""
    along = df.groupBy(*by, i, j).agg(F.sum(x).alias("v"))
    spread = along.withColumn("__i", F.explode(F.sequence(F.col(i) - radius, F.col(i) + radius))).groupBy(*by, F.col("__i").alias(i), j).agg(F.sum("v").alias("v"))
    frame = Window.partitionBy(*by, i).orderBy(j).rangeBetween(-radius, radius)
    wanted = along.select(*by, i, j).withColumn("__own", F.lit(True))
    both = spread.join(wanted, [*by, i, j], "full")
    return both.withColumn("box", F.sum("v").over(frame)).where("__own").select(*by, i, j, "box")


def islands(df: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Runs of overlapping or touching intervals: by, lo, hi, n."""
    own = Window.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col(lo) > reach)).cast("int")
    marked = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*by, "__run").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("n")).drop("__run")


def gaps(df: DataFrame, by: list[str], lo: str, hi: str, least: float) -> DataFrame:
    """What lies between runs, of length ``least`` or more: by, lo, hi."""
    own = Window.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return df.select(*by, reach.alias("__a"), F.col(lo).alias("__b")).where(F.col("__b") - F.col("__a") >= least).select(*by, F.col("__a").alias("lo"), F.col("__b").alias("hi"))


def three_ranks(df: DataFrame, by: list[str], orders: dict[str, list[Column]], key: str, passing: Column) -> DataFrame:
    """A rank for each order among passing rows; others have null ranks; ``key`` ends every order."""
    ranks = {name: F.when(passing, F.row_number().over(Window.partitionBy(*by, passing).orderBy(*order, key))) for name, order in orders.items()}
    return df.withColumns(ranks)


def tie_multiplicity(df: DataFrame, by: list[str], x: str) -> DataFrame:
    best = F.max(x).over(Window.partitionBy(*by))
    return df.withColumn("__best", best).groupBy(*by).agg(F.max("__best").alias("best"), F.count_if(F.col(x) == F.col("__best")).alias("ties"))


def kernel_count(hits: DataFrame, by: list[str], site: str, pos: str, tau: float) -> DataFrame:
    """S(p): sites with a hit at p (tau 0), or the sum over sites of the largest Gaussian weight of a hit within 3 tau."""
    if tau <= 0:
        return hits.groupBy(*by, pos).agg(F.countDistinct(site).cast("double").alias("s"))
    r = int(-(-3 * tau // 1))
    near = hits.select(*by, site, pos).distinct().withColumn("__o", F.explode(F.sequence(F.lit(-r), F.lit(r))))
    weight = F.exp(-F.pow(F.col("__o"), F.lit(2)) / F.lit(2 * tau * tau))
    per_site = near.withColumn("__p", F.col(pos) + F.col("__o")).groupBy(*by, site, "__p").agg(F.max(weight).alias("w"))
    return per_site.groupBy(*by, F.col("__p").alias(pos)).agg(F.sum("w").alias("s"))


def coherent_count(hits: DataFrame, by: list[str], at: str, jitter: float) -> DataFrame:
    """Rows of a group whose ``at`` lies within ``jitter`` of the group's median."""
    mid = F.percentile(at, F.lit(0.5)).over(Window.partitionBy(*by))
    return hits.withColumn("__m", mid).groupBy(*by).agg(F.max("__m").alias("median"), F.count_if(F.abs(F.col(at) - F.col("__m")) <= jitter).alias("coherent"), F.count(F.lit(1)).alias("n"))
