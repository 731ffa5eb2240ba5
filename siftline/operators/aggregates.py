"""Grouped aggregates with the exact rules of the analyses: named percentiles, spread, modes, strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.operators.windows import running


def median(x: Column | str) -> Column:
    return F.percentile(x, F.lit(0.5))


def quantiles(x: Column | str, ps: list[float]) -> Column:
    """Linear interpolation, exact."""
    return F.percentile(x, F.lit(ps))


def floor_index(df: DataFrame, by: list[str], x: str, ps: dict[str, float]) -> DataFrame:
    """by, n, and for each name the value at min(int(n p / 100), n - 1) of the group's sorted values, by
    running counts of distinct values."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("c"))
    n = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    rows = running(counts, by, [x], F.col("c")).drop("__n").join(n, by) if by else running(counts, by, [x], F.col("c")).drop("__n").join(F.broadcast(n))
    at = {name: F.least(F.floor(F.col("n") * F.lit(p) / 100), F.col("n") - 1) for name, p in ps.items()}
    held = {name: F.max(F.when((F.col("__sum") - F.col("c") <= k) & (k < F.col("__sum")), F.col(x))) for name, k in at.items()}
    return rows.groupBy(*by, "n").agg(*[v.alias(name) for name, v in held.items()])


def with_spread(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, n, median, mad, least, most, mean, std: MAD from a second pass over the group's median."""
    mid = median(x).over(Window.partitionBy(*by))
    return df.withColumn("__m", mid).groupBy(*by).agg(
        F.count(x).alias("n"), F.min("__m").alias("median"), median(F.abs(F.col(x) - F.col("__m"))).alias("mad"),
        F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
    )


def modal(df: DataFrame, by: list[str], x: str, order: str) -> DataFrame:
    """The most frequent value; of equally frequent ones the one first seen in ``order``."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(x, F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("n"))


def entropy(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Bits of the categories of x."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.count(F.lit(1)).alias("n_values"))
    return total.select(*by, "n_values", (F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def at_least(df: DataFrame, n: str) -> DataFrame:
    """For each value t of ``n``, how many rows have n >= t."""
    counts = df.groupBy(n).agg(F.count(F.lit(1)).alias("c"))
    down = Window.orderBy(F.desc(n))
    return counts.select(F.col(n).alias("t"), F.sum("c").over(down).alias("n_at_least"))


def majority(df: DataFrame, by: str, label: str, purity: float = 0.9) -> DataFrame:
    """The label of at least ``purity`` of a group's rows, else mixed."""
    counts = df.where(F.col(label).isNotNull()).groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(by).agg(F.max(F.struct(F.col("n"), F.col(label))).alias("top"), F.sum("n").alias("total"))
    share = F.col("top.n") / F.col("total")
    return top.select(by, F.when(share >= purity, F.col(f"top.{label}")).otherwise("mixed").alias("verdict"), share.alias("share"))


def contingency(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def log_enrichment(counts: DataFrame, row: str, column: str, label: str, a, b, eps: float = 0.5) -> DataFrame:
    """ln of the ratio of row-normalised counts (each with ``eps`` added) of label a to those of b."""
    wide = counts.groupBy(row, column).agg(*[F.sum(F.when(F.col(label) == v, F.col("n")).otherwise(0)).alias(n) for v, n in ((a, "a"), (b, "b"))])
    own = Window.partitionBy(row)
    share = lambda c: (F.col(c) + eps) / F.sum(F.col(c) + eps).over(own)
    return wide.select(row, column, F.log(share("a") / share("b")).alias("enrichment"))


def strata(df: DataFrame, axes: list[str], aggregates: list[Column]) -> DataFrame:
    """One pass over all single axes and the whole: axis, stratum, aggregates (GROUPING SETS)."""
    sets = [[], *[[a] for a in axes]]
    grouped = df.groupingSets(sets, *axes).agg(F.grouping_id(*axes).alias("__g"), *aggregates)
    n = len(axes)
    axis = F.lit("all")
    value = F.lit("all")
    for i, a in enumerate(axes):
        bit = F.col("__g") == F.lit((1 << n) - 1 - (1 << n - 1 - i))
        axis, value = F.when(bit, F.lit(a)).otherwise(axis), F.when(bit, F.col(a).cast("string")).otherwise(value)
    return grouped.withColumns({"axis": axis, "stratum": value}).drop("__g", *axes)


def consensus(df: DataFrame, by: list[str], s: str) -> DataFrame:
    """Per position the most frequent character (the lowest on ties) and its share."""
    at = df.select(*by, F.posexplode(F.split(F.col(s), "")).alias("pos", "c")).where("c <> ''")
    counts = at.groupBy(*by, "pos", "c").agg(F.count(F.lit(1)).alias("n"))
    most = Window.partitionBy(*by, "pos")
    ranked = counts.withColumn("r", F.row_number().over(most.orderBy(F.desc("n"), "c"))).withColumn("share", F.col("n") / F.sum("n").over(most))
    return ranked.where("r = 1").select(*by, "pos", "c", "share")


def information_content(counts: DataFrame, by: list[str], symbol: str, background: DataFrame) -> DataFrame:
    """KL divergence (nats) of a position's symbol shares from ``background`` (symbol, q)."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("p", share).join(background, symbol).groupBy(*by).agg(F.sum(F.col("p") * F.log(F.greatest(F.col("p") / F.col("q"), F.lit(1e-12)))).alias("nats"))


def unpivot_summary(df: DataFrame, by: list[str], columns: list[str], ps: list[float]) -> DataFrame:
    """by, channel, mean, and the quantiles ps of each column."""
    long = df.unpivot(by, columns, "channel", "x").where("x is not null")
    out = long.groupBy(*by, "channel").agg(F.avg("x").alias("mean"), quantiles("x", ps).alias("q"))
    return out.select(*by, "channel", "mean", *[F.col("q")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(ps)])
