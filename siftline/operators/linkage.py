"""Record linkage: connected components and what is read off them. Links are chosen so that groups of any
size need no pairs but one link a row or so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.session import cut, large, partitions

FEW = 1 << 13  # links whose least ones may be broadcast


def _star(links: DataFrame, wide: bool, many: bool) -> DataFrame:
    """One half round (a large star or, not ``wide``, a small one) over links (u, v) with u > v."""
    side = large if many else lambda df: df  # written names are a small part of their size in memory
    if wide:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, root (the least node reached) of every node of ``links``; null ends and loops are left out.
    Large and small stars by turns: a half round is a grouped minimum and a join back, so one row per
    link moves, and a node with very many neighbours is split by the skew handling of the join. Links
    are written and read again every round; a lost executor costs its own part of one. Raises if
    ``rounds`` don't suffice (the number needed grows with the logarithm of the longest chain)."""
    at = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    seen, many = None, True
    for _ in range(rounds):
        at = cut(_star(_star(at, True, many), False, many), "links")
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        many = now[0] > FEW
        if now == seen:
            roots = at.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        seen = now
    raise RuntimeError(f"components need more than {rounds} rounds")


def threshold_groups(nodes: DataFrame, linked: DataFrame, by: list[str], key: str, a: str, b: str) -> DataFrame:
    """by, node, root: the groups that the pairs ``linked`` (by, a, b) make of ``nodes`` (by, key) within
    each ``by``; unlinked nodes are roots. Groups may be of any size."""
    name = lambda c: F.struct(*by, F.col(c).alias("k"))
    roots = components(linked.select(name(a).alias("a"), name(b).alias("b")), "a", "b").select(*[F.col(f"node.{c}").alias(c) for c in by], F.col("node.k").alias("node"), F.col("root.k").alias("root"))
    return nodes.select(*by, F.col(key).alias("node")).distinct().join(roots, [*by, "node"], "left").select(*by, "node", F.coalesce("root", "node").alias("root"))


def group_gate(groups: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """by, n_groups, passes, reason."""
    return gated(groups.groupBy(*by).agg(F.countDistinct("root").alias("n_groups")), least)


def gated(counts: DataFrame, least: int) -> DataFrame:
    """Adds passes and reason to rows with n_groups."""
    return counts.withColumns({"passes": F.col("n_groups") >= least, "reason": F.when(F.col("n_groups") < least, "insufficient_bg_groups")})


def group_counts(sets: DataFrame, members: str, linked: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Adds n_groups to rows that hold their nodes (``members``, an array without repeats): how many groups the pairs
    ``linked`` (by, a, b) make of them, as of :func:`threshold_groups`, but nodes without a link are not moved."""
    name = lambda c: F.struct(*by, F.col(c).alias("k"))
    led = components(linked.select(name(a).alias("a"), name(b).alias("b"))).where("node != root")
    less = led.select(*[F.col(f"node.{c}").alias(c) for c in by]).groupBy(*by).agg(F.count(F.lit(1)).alias("__less"))
    return sets.join(large(less), by, "left").withColumn("n_groups", F.size(members).cast("long") - F.coalesce("__less", F.lit(0))).drop("__less")


def star_anchor(pairs: DataFrame, by: list[str], a: str, b: str, size: str) -> DataFrame:
    """The node with most partners (then smallest size, then least name): by, anchor, members. Not
    transitive: members are partners of the anchor itself."""
    both = pairs.select(*by, F.col(a).alias("anchor"), F.col(b).alias("other"), size).union(pairs.select(*by, F.col(b), F.col(a), size))
    star = both.groupBy(*by, "anchor").agg(F.countDistinct("other").alias("members"), F.min(size).alias("size"))
    return _greatest_star(star, by)


def _greatest_star(stars: DataFrame, by: list[str]) -> DataFrame:
    first = F.min_by(F.struct("anchor", "members"), F.struct((-F.col("members")).alias("m"), "size", "anchor")).alias("s")
    return stars.groupBy(*by).agg(first).select(*by, "s.anchor", "s.members")


def near_star_anchor(df: DataFrame, by: list[str], key: str, value: str, within: float, size: str | None = None) -> DataFrame:
    """:func:`star_anchor` where partners are the rows of a group whose values differ by ``within`` at most,
    without their pairs: a row is counted over a range of rows, group by group and cell by cell (a cell is as wide
    as the range, and holds copies of its neighbours' rows). Rows without a partner are no anchors."""
    cell = F.floor(F.col(value) / within)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(key).alias("anchor"), F.col(value).cast("double").alias("v"), (F.lit(0) if size is None else F.col(size)).alias("size"), cell.alias("own"))
    around = F.expr(f"count(1) over (partition by {', '.join(f'`{c}`' for c in [*by, 'cell'])} order by v range between {float(within)!r}D preceding and {float(within)!r}D following) - 1")
    stars = rows.withColumn("cell", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).withColumn("members", around)
    return _greatest_star(stars.where("own = cell and members > 0"), by)


def chain_links(df: DataFrame, by: list[str], key: str, value: str, within: float) -> DataFrame:
    """Links (by, a, b) that connect whatever the pairs of rows of a group whose values differ by ``within`` at most
    would: cells of that width hold rows that are all near each other, which are linked to the cell's least one;
    and a cell's greatest is linked to the next cell's least if they are near."""
    rows = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(*by, F.col(key).alias("k"), F.col(value).alias("v"), F.floor(F.col(value) / within).alias("cell"))
    cells = rows.groupBy(*by, "cell").agg(F.min(F.struct("v", "k")).alias("low"), F.max(F.struct("v", "k")).alias("high"))
    within_cell = rows.join(cells, [*by, "cell"]).select(*by, F.col("low.k").alias("a"), F.col("k").alias("b"))
    after = cells.select(*by, (F.col("cell") - 1).alias("cell"), F.col("low").alias("next"))
    between = cells.join(after, [*by, "cell"]).where(F.col("next.v") - F.col("high.v") <= within).select(*by, F.col("high.k").alias("a"), F.col("next.k").alias("b"))
    return within_cell.where("a != b").unionByName(between)


def interval_groups(df: DataFrame, by: list[str], key: str, lo: str, hi: str, least: float) -> DataFrame:
    """by, key, root: groups of intervals [lo, hi) of one ``by`` (never null or blank) that overlap by ``least``
    (above 0) or more, directly or through others; root is the least key of a group. Intervals that are empty,
    shorter than that or of an unknown ``by`` stay alone.

    A sweep over the starts: an interval joins the group before it if the one that reaches furthest so far
    overlaps it enough, so no pairs are made. Intervals are dealt by range, and what the ranges before
    reach, and how many groups they begin, is added from a row for each range and ``by``."""
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    fits = known & F.coalesce(F.col(hi) - F.col(lo) >= least, F.lit(False))
    rows = df.where(fits).select(*by, key, lo, hi).repartitionByRange(max(partitions(df.sparkSession), 2), *by, lo, hi, key).withColumn("__part", F.spark_partition_id())
    rows = cut(rows, "ranges")
    part, earlier = Window.partitionBy(*by, "__part").orderBy(lo, hi, key), Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*by, "__part").agg(F.max(hi).alias("__m")).withColumn("__before", F.max("__m").over(earlier)).drop("__m")
    reach = F.greatest(F.max(hi).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.col("__before"))
    begun = cut(rows.join(before, [*by, "__part"]).withColumn("__new", F.coalesce((reach - F.col(lo) < least).cast("long"), F.lit(1))), "begun")
    offset = begun.groupBy(*by, "__part").agg(F.sum("__new").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    number = F.sum("__new").over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("__first")
    grouped = begun.join(offset, [*by, "__part"]).withColumn("__group", number).select(*by, key, "__group")
    roots = grouped.groupBy(*by, "__group").agg(F.min(key).alias("root"))
    return grouped.join(roots, [*by, "__group"]).select(*by, key, "root").unionByName(df.where(~F.coalesce(fits, F.lit(False))).select(*by, key, F.col(key).alias("root")))


def cell_links(df: DataFrame, by: list[str], key: str, cell: Column) -> DataFrame:
    """Links (by, a, b) that connect what the pairs of rows of a group and an equal ``cell`` would: each row with the least key of its cell."""
    rows = df.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("b"), cell.alias("cell")).where("cell is not null")
    least = rows.groupBy(*by, "cell").agg(F.min("b").alias("a"))
    return rows.join(large(least), [*by, "cell"]).where("a != b").select(*by, "a", "b")


def sum_links(df: DataFrame, by: list[str], key: str, divisor: int) -> DataFrame:
    """Links (by, a, b) that connect what the pairs of rows of a group whose keys (whole numbers) add up to a multiple of
    ``divisor`` would: each row with the least key of the remainder that its own lacks."""
    rows = df.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("b"), F.pmod(-F.col(key), F.lit(divisor)).alias("rest"))
    least = rows.groupBy(*by, F.pmod(-F.col("rest"), F.lit(divisor)).alias("rest")).agg(F.min("b").alias("a"))
    return rows.join(large(least), [*by, "rest"]).where("a != b").select(*by, "a", "b")
