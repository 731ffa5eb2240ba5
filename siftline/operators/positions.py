"""Position clusters, interval dedup and greedy merging: rules that are told as loops over one sorted list,
done as joins of near rows, so that a group may be of any size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from siftline.operators.windows import running
from siftline.session import cut, large, partitions, ship


FEW = 1_000_000  # conflicts that one task walks through


def outranked(conflicts: DataFrame, few: int = FEW) -> DataFrame:
    """The nodes (node) that go when a list is walked through best first and a row goes if it conflicts with
    one that stays. ``conflicts``: better, worse, names that compare (better is the lesser).

    This is the independent set that the order names first. Nodes are numbered in their order, unless their names are
    whole numbers; by rounds, who has no better undecided neighbour stays and its neighbours go, a join of the
    conflicts that are left. Once these are counted and no more than ``few``, one task walks through them."""
    ship(conflicts.sparkSession)
    edges, ids = conflicts.select("better", "worse"), None
    kind = edges.schema["better"].dataType
    if isinstance(kind, IntegralType) and kind == edges.schema["worse"].dataType:
        left = edges.select(F.col("better").cast("long").alias("b"), F.col("worse").cast("long").alias("w")).dropna()
    else:
        edges = cut(edges.distinct(), "conflicts")
        nodes = edges.select(F.col("better").alias("node")).union(edges.select("worse")).distinct()
        ids = large(cut(running(nodes, [], ["node"]).select("node", F.col("__place").alias("id")), "nodes"))
        left = edges.join(ids.toDF("better", "b"), "better").join(ids.toDF("worse", "w"), "worse").select("b", "w")
    gone = []
    while True:
        left = large(cut(left.select("b", "w"), "conflicts"))
        if left.count() <= few:
            break
        stay = large(cut(left.select("b").distinct().join(left.select(F.col("w").alias("b")).distinct(), "b", "left_anti"), "staying"))
        now = large(cut(left.join(stay, "b", "left_semi").select(F.col("w").alias("id")).distinct(), "outranked"))  # a join's result has no hint of its own
        gone.append(now)
        left = left.join(stay, "b", "left_anti").join(now.toDF("b"), "b", "left_anti").join(now.toDF("w"), "w", "left_anti")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[int] = set()
        for batch in batches:  # ends of conflicts in order: whether the better one stays is known before
            for b, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b not in out:
                    out.add(w)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.int64())], ["id"])

    rest = left.repartition(1).sortWithinPartitions("b", "w").mapInArrow(walk, "id bigint")
    found = reduce(lambda x, y: x.unionByName(y), gone, rest)
    if ids is None:
        return found.select(F.col("id").cast(kind).alias("node"))
    return ids.join(found, "id", "left_semi").select("node")


def _ordered(order: list[tuple[str, bool]]) -> list[Column]:
    """Columns whose ascending order is ``order`` (numeric columns, ascending or not), nulls last."""
    return [x for c, up in order for x in (F.col(c).isNull(), F.col(c) if up else -F.col(c))]


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def dedup_intervals(df: DataFrame, by: list[str], key: str, score: str, spans: list[tuple[str, str]], least: float = 0.5) -> DataFrame:
    """Best first (score, then key), a row goes if every one of its spans overlaps those of a row that
    stays with IoU >= least. Columns: by, key, score and the spans; ``key`` is unique within ``by``.

    Spans of IoU >= t have lengths within a factor 1 / t and centres at most 1 - t of the longer apart, so rows
    meet in grid cells of (length class, place), one for each span; only those that overlap are compared further.
    The row whose first span is of the lower class, or of the same, seeks the other one."""
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    base = 1.0001 / least
    columns = [*by, key, score, *[c for s in spans for c in s]]
    node = F.struct(*[F.col(c) for c in by], *[c.alias(f"o{k}") for k, c in enumerate(_ordered([(score, False), (key, True)]))])
    rows = cut(df.select(columns).withColumn("__node", node), "intervals")
    wide = rows.where(_all([F.col(hi) > F.col(lo) for lo, hi in spans]))
    left, right, cells = wide, wide, []
    for k, (lo, hi) in enumerate(spans):
        level = F.floor(F.log(F.col(hi) - F.col(lo)) / F.log(F.lit(base)))
        middle = (F.col(lo) + F.col(hi)) / 2
        reach = lambda g: 1.001 * (1 - least) * F.pow(F.lit(base), g + 2)
        cell = lambda g, at: F.struct(g.alias("g"), F.floor(at / (2 * reach(g))).alias("c"))
        left = left.withColumn(f"__c{k}", cell(level, middle))
        right = right.withColumn(f"__c{k}", F.explode(F.array_distinct(F.array(*[cell(g, middle + side * reach(g)) for g in ((level, level - 1, level + 1) if k else (level, level - 1)) for side in (-1, 1)]))))
        cells.append(f"__c{k}")
    take = [c for s in spans for c in s]
    a = left.select(*by, *cells, F.col("__node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in take])
    b = right.select(*by, *cells, F.col("__node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in take])

    def alike(lo: str, hi: str) -> Column:
        both = F.least(f"a_{hi}", f"b_{hi}") - F.greatest(f"a_{lo}", f"b_{lo}")
        union = F.col(f"a_{hi}") - F.col(f"a_{lo}") + F.col(f"b_{hi}") - F.col(f"b_{lo}") - both
        return (both > 0) & (both >= least * union)

    met = a.join(large(b), [*by, *cells]).where((F.col("a") != F.col("b")) & _all([alike(*s) for s in spans]))
    gone = outranked(met.select(F.least("a", "b").alias("better"), F.greatest("a", "b").alias("worse")))
    return rows.join(large(gone), F.col("__node") == F.col("node"), "left_anti").select(columns)


def _near(rows: DataFrame, by: list[str], near: dict[str, float], take: list[str]) -> DataFrame:
    """Pairs of rows (columns a_ and b_ of ``take`` and of the coordinates) of a group whose coordinates all differ by
    ``near`` at most: a row meets those of its own and the neighbouring cells of a grid of that width."""
    a, b, cells = rows, rows, []
    for k, (c, d) in enumerate(near.items()):
        cell = F.floor(F.col(c) / (d or 1))
        a, b = a.withColumn(f"__c{k}", F.explode(F.array(cell - 1, cell, cell + 1))), b.withColumn(f"__c{k}", cell)
        cells.append(f"__c{k}")
    side = lambda df, s: df.select(*by, *cells, *[F.col(c).alias(f"{s}_{c}") for c in dict.fromkeys([*take, *near])])
    return side(a, "a").join(large(side(b, "b")), [*by, *cells]).where(_all([F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= d for c, d in near.items()]))


def _alike(jaccard: float, members: str) -> Column:
    both = F.size(F.array_intersect(f"a_{members}", f"b_{members}"))
    return both >= jaccard * (F.size(f"a_{members}") + F.size(f"b_{members}") - both)


def greedy_merge(df: DataFrame, by: list[str], key: str, order: list[tuple[str, bool]], near: dict[str, float], members: str, jaccard: float = 0.8) -> DataFrame:
    """by, key, anchor (the key of the row it is merged into, its own if it stays). Best first (``order``: column,
    ascending; then key), a row is absorbed by the first one that stays of those whose coordinates are all within
    ``near`` and whose members (an array without repeats) overlap by ``jaccard``; else it stays, as an anchor. ``key`` is
    unique within ``by``. Rows are numbered in that order once, so that conflicts are pairs of numbers in every join."""
    columns, rank = [*dict.fromkeys([*by, key, *near, members])], [*_ordered(order), F.col(key)]
    names = [f"__o{k}" for k in range(len(rank))]
    ranked = df.select(*columns, *[c.alias(n) for c, n in zip(rank, names, strict=True)]).repartitionByRange(max(partitions(df.sparkSession), 2), *by, *names).sortWithinPartitions(*by, *names)
    rows = cut(ranked.select(*columns, F.monotonically_increasing_id().alias("__node")), "rows")
    met = _near(rows, by, near, ["__node", key, members]).where((F.col("a___node") < F.col("b___node")) & _alike(jaccard, members))
    conflicts = large(cut(met.select(F.col("a___node").alias("better"), F.col("b___node").alias("worse"), F.col(f"a_{key}").alias("__anchor")), "near"))
    gone = large(cut(outranked(conflicts), "gone"))
    stays = conflicts.join(gone.withColumnRenamed("node", "better"), "better", "left_anti")
    anchors = stays.join(gone.withColumnRenamed("node", "worse"), "worse", "left_semi").groupBy(F.col("worse").alias("__node")).agg(F.min_by("__anchor", "better").alias("__anchor"))
    return rows.join(large(anchors), "__node", "left").select(*by, key, F.coalesce("__anchor", key).alias("anchor"))


def merged(rows: DataFrame, anchors: DataFrame, by: list[str], key: str, spread: list[str], members: str) -> DataFrame:
    """by, anchor, n_merged, {c}_min and {c}_max of the columns ``spread``, and the union of members."""
    bounds = [f(c).alias(f"{c}_{name}") for c in spread for f, name in ((F.min, "min"), (F.max, "max"))]
    union = F.sort_array(F.array_distinct(F.flatten(F.collect_list(members)))).alias(members)
    return rows.join(anchors, [*by, key]).groupBy(*by, "anchor").agg(F.count(F.lit(1)).alias("n_merged"), *bounds, union)


def _ranges(hits: DataFrame, by: list[str], offset: float) -> DataFrame:
    """Adds lo and hi: the centres for which a hit is its site's nearest within ``offset`` (best m, then place, on
    ties), and cell, one row for each cell of the width of twice the offset that holds any. Places are whole
    numbers, centres halves of such, so a bound that does not belong is a quarter away."""
    site = Window.partitionBy(*by, "site").orderBy("pos")
    beside = lambda f, c: f(c).over(site)
    half = lambda other: (F.col("pos") + other) / 2
    low, high = half(beside(F.lag, "pos")), half(beside(F.lead, "pos"))
    lo = F.greatest(F.col("pos") - offset, F.when(F.col("m") > beside(F.lag, "m"), low).otherwise(low + 0.25))
    hi = F.least(F.col("pos") + offset, F.when(F.col("m") >= beside(F.lead, "m"), high).otherwise(high - 0.25))
    found = hits.withColumns({"lo": lo.cast("double"), "hi": hi.cast("double")}).where("lo <= hi")
    return found.withColumn("cell", F.explode(F.sequence(_cell("lo", offset), _cell("hi", offset))))


def _cell(c: str, offset: float) -> Column:
    return F.floor(F.col(c) / (2 * offset + 1))


def _supporters(ranges: DataFrame, centres: DataFrame, by: list[str], offset: float) -> DataFrame:
    """Rows of the supporters of each centre (by, at)."""
    return centres.withColumn("cell", _cell("at", offset)).join(ranges, [*by, "cell"]).where("lo <= at and at <= hi")


def position_clusters(hits: DataFrame, by: list[str], site: str, pos: str, m: str, valid: str, offset: float = 5, min_frac: float = 0.5, jaccard: float = 0.8, rounds: int = 20, orient: str | None = None) -> DataFrame:
    """Clusters of hits (site, whole position, m) that recur across the sites of a group: by, cluster_id, median, mad,
    n_support, support_frac, pos_min, pos_max, mean_m, min_m, n_best (supporters that are their site's best hit),
    mean_ties (hits as good as a site's best), sites, and with ``orient`` n_rc.

    From every whole centre between the first and last hit, the supporters are each site's nearest hit within
    ``offset`` (best m, then position, on ties); the centre moves to their median until it stays (``rounds`` moves at
    most), with at least ``min_frac`` of the ``valid`` sites (those of the group before any filtering) at every move.
    Of such clusters, best first (support, mean m, mad), one goes if it has nearly the sites (``jaccard``) of one
    that stays within ``offset``.

    Supporters change only at the ends of the ranges in which hits are their sites' nearest: one centre for each
    such range's begin and end stands for all, and centres of one place are followed once. Every move is a join
    of centres with the ranges around them, so a group may be of any size. A group of a null name has no clusters."""
    best = Window.partitionBy(*by, site)
    rank = Window.partitionBy(*by, site).orderBy(F.desc(m), pos)
    top = F.max(m).over(best)
    own = hits.select(*by, F.col(site).alias("site"), F.col(pos).cast("long").alias("pos"), F.col(m).alias("m"), F.col(valid).alias("valid"), (F.lit(None) if orient is None else F.col(orient)).cast("string").alias("orient"), F.sum((F.col(m) == top).cast("long")).over(best).alias("ties"), F.row_number().over(rank).alias("rank"))
    own = own.groupBy(*by, "site", "pos").agg(F.max("valid").alias("valid"), F.max("ties").alias("ties"), F.min_by(F.struct("m", "rank", "orient"), "rank").alias("h"))
    own = own.select(*by, "site", "pos", "valid", "ties", "h.*")
    need = F.greatest(F.lit(1), F.ceil(F.round(F.col("valid") * F.lit(min_frac), 9)))
    ranges = large(cut(_ranges(own.withColumn("need", need), by, offset), "ranges"))

    ends = ranges.select(*by, F.explode(F.array(F.ceil("lo"), F.floor("hi") + 1)).alias("at")).distinct()
    bounds = ranges.groupBy(*by).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    centres = ends.join(bounds, by).where("at <= last").select(*by, F.greatest("at", "first").cast("double").alias("at")).distinct()
    moves, seen = [], None
    for _ in range(rounds + 1):
        moved = _supporters(ranges, centres, by, offset).groupBy(*by, "at").agg(F.count(F.lit(1)).alias("n"), F.median("pos").alias("to"), F.max("need").alias("need"))
        moved = cut(moved.where("n >= need").select(*by, "at", "to"), "moves")
        if seen is not None:  # the first move leads from centres that are none of a cluster as yet
            moves.append(moved.where("at = to").select(*by, "at"))
        seen = centres.limit(0) if seen is None else seen.unionByName(centres)
        centres = cut(moved.select(*by, F.col("to").alias("at")).distinct().join(large(seen), [*by, "at"], "left_anti"), "centres")
        if centres.isEmpty():
            break
    stay = reduce(lambda a, b: a.unionByName(b), moves) if moves else centres
    held = _supporters(ranges, stay.distinct(), by, offset)
    away = F.abs(F.col("pos") - F.col("at"))
    found = held.groupBy(*by, F.col("at").alias("median")).agg(
        F.median(away).alias("mad"), F.count(F.lit(1)).alias("n_support"), (F.count(F.lit(1)) / F.max("valid")).alias("support_frac"), F.min("pos").alias("pos_min"), F.max("pos").alias("pos_max"),
        F.avg("m").alias("mean_m"), F.min("m").alias("min_m"), F.count_if(F.col("rank") == 1).alias("n_best"), F.avg("ties").alias("mean_ties"), F.sort_array(F.collect_list("site")).alias("sites"), F.count_if(F.col("orient") == "rc").alias("n_rc"),
    )
    found = cut(found, "found")
    order = [("n_support", False), ("mean_m", False), ("mad", True), ("median", True)]
    node = F.struct(*by, *[c.alias(f"o{k}") for k, c in enumerate(_ordered(order))])
    rows = found.withColumn("__node", node)
    met = _near(rows, by, {"median": offset}, ["__node", "sites"]).where((F.col("a___node") < F.col("b___node")) & _alike(jaccard, "sites"))
    gone = outranked(met.select(F.col("a___node").alias("better"), F.col("b___node").alias("worse")))
    kept = rows.join(large(gone), F.col("__node") == F.col("node"), "left_anti").drop("__node")
    number = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n_support"), "mad", "median")).cast("long") - 1
    columns = [*by, "cluster_id", "median", "mad", "n_support", "support_frac", "pos_min", "pos_max", "mean_m", "min_m", "n_best", "mean_ties", "sites"]
    return kept.withColumn("cluster_id", number).select(*columns, *(["n_rc"] if orient else []))
