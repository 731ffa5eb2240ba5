"""Queries of clustering and record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import linkage, positions
from siftline.registry import query, table


@query("""
    WITH RECURSIVE p AS (SELECT DISTINCT s_nationkey AS g, s_suppkey AS k, s_acctbal AS v FROM supplier),
    e AS (SELECT a.g, a.k AS x, b.k AS y FROM p a JOIN p b ON a.g = b.g AND a.k <> b.k AND abs(a.v - b.v) <= 500),
    r AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def link_balances(spark, sf_dir):
    """Suppliers of a nation chained by like balances, and the least supplier that each reaches."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return linkage.components(linkage.chain_links(s, ["s_nationkey"], "s_suppkey", "s_acctbal", 500))


@query()
def link_components(spark, sf_dir):
    """Parts that share an order, over all lines: each order's parts are linked to its least part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    least = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("least"))
    return linkage.components(lines.join(least, "l_orderkey").where("l_partkey > least").select("l_partkey", "least").distinct(), "l_partkey", "least")


_EVENT_SPANS = "SELECT user_id, event_id, value AS score, CAST(floor(epoch(ts)) AS BIGINT) AS lo, CAST(floor(epoch(ts)) AS BIGINT) + 864000 AS hi, value AS lo2, value + 50 AS hi2 FROM events"


@query(f"""
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS r FROM ({_EVENT_SPANS})),
    c AS (SELECT b.user_id, a.r AS a, b.r AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.r < b.r AND a.lo < b.hi AND b.lo < a.hi AND a.lo2 < b.hi2 AND b.lo2 < a.hi2
          WHERE (least(a.hi, b.hi) - greatest(a.lo, b.lo)) >= 0.5 * (a.hi - a.lo + b.hi - b.lo - least(a.hi, b.hi) + greatest(a.lo, b.lo)) AND (least(a.hi2, b.hi2) - greatest(a.lo2, b.lo2)) >= 0.5 * (a.hi2 - a.lo2 + b.hi2 - b.lo2 - least(a.hi2, b.hi2) + greatest(a.lo2, b.lo2))),
    n AS (SELECT e.user_id, e.r, list(c.a) FILTER (c.a IS NOT NULL) AS better FROM e LEFT JOIN c ON c.user_id = e.user_id AND c.b = e.r GROUP BY 1, 2),
    w AS (SELECT user_id, 0::BIGINT AS r, []::BIGINT[] AS kept FROM e GROUP BY 1
          UNION ALL SELECT n.user_id, n.r, CASE WHEN list_has_any(w.kept, coalesce(n.better, [])) THEN w.kept ELSE list_append(w.kept, n.r) END FROM w JOIN n ON n.user_id = w.user_id AND n.r = w.r + 1),
    k AS (SELECT user_id, unnest(kept) AS r FROM (SELECT user_id, arg_max(kept, r) AS kept FROM w GROUP BY 1))
    SELECT e.user_id, e.event_id, e.score, e.lo, e.hi, e.lo2, e.hi2 FROM e JOIN k ON k.user_id = e.user_id AND k.r = e.r""")
def link_interval_dedup(spark, sf_dir):
    """Events of a user as intervals of time and value, best first."""
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("score"), s.alias("lo"), (s + 864000).alias("hi"), F.col("value").alias("lo2"), (F.col("value") + 50).alias("hi2"))
    return positions.dedup_intervals(e, ["user_id"], "event_id", "score", [("lo", "hi"), ("lo2", "hi2")])


def user_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.dayofweek("ts").cast("long").alias("site"), F.floor("value").cast("long").alias("pos"), (F.col("event_id") % 7).alias("m"))
    valid = e.groupBy("user_id").agg(F.countDistinct("site").alias("k_valid"))
    return e.join(valid, "user_id")


#: x: the centres that stay; n: clusters in best-first order; c: conflicts; k: what a walk through each user's list keeps
_CLUSTERS = """
    h0 AS (SELECT user_id AS u, CAST(dayofweek(ts) + 1 AS BIGINT) AS site, CAST(floor(value) AS BIGINT) AS pos, event_id % 7 AS m FROM events),
    h1 AS (SELECT *, max(m) OVER (PARTITION BY u, site) AS top FROM h0),
    h AS (SELECT u, site, pos, max(m) AS m, max(top) AS top FROM h1 GROUP BY 1, 2, 3),
    t AS (SELECT u, site, count(*) FILTER (m = top) AS ties, min(pos) FILTER (m = top) AS best FROM h1 GROUP BY 1, 2),
    b AS (SELECT u, min(pos) AS lo, max(pos) AS hi, count(DISTINCT site) AS valid, greatest(1, CAST(ceil(round(0.5 * count(DISTINCT site), 9)) AS BIGINT)) AS need FROM h GROUP BY 1),
    g AS (SELECT u, need, valid, x / 2.0 AS x FROM b, unnest(range(2 * lo, 2 * hi + 1)) AS r(x)),
    s AS (SELECT g.u, g.need, g.valid, g.x, h.site, h.pos, h.m, row_number() OVER (PARTITION BY g.u, g.x, h.site ORDER BY abs(h.pos - g.x), h.m DESC, h.pos) AS n FROM g JOIN h ON h.u = g.u AND abs(h.pos - g.x) <= 5),
    f AS (SELECT u, x, median(pos) AS y FROM s WHERE n = 1 GROUP BY u, x, need HAVING count(*) >= need),
    w AS (SELECT u, y AS x, 0 AS step FROM f WHERE x = floor(x) UNION SELECT f.u, f.y, step + 1 FROM w JOIN f ON f.u = w.u AND f.x = w.x WHERE step < 20),
    x AS (SELECT DISTINCT f.u, f.x FROM w JOIN f ON f.u = w.u AND f.x = w.x WHERE f.y = f.x AND step < 20),
    q AS (SELECT s.u, s.x, median(abs(s.pos - s.x)) AS mad, count(*) AS n_support, count(*) / max(s.valid) AS support_frac, min(s.pos) AS pos_min, max(s.pos) AS pos_max, avg(s.m) AS mean_m, min(s.m) AS min_m,
                 count(*) FILTER (s.pos = t.best) AS n_best, avg(t.ties) AS mean_ties, list(s.site ORDER BY s.site) AS sites FROM s JOIN x ON x.u = s.u AND x.x = s.x JOIN t ON t.u = s.u AND t.site = s.site WHERE s.n = 1 GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n_support DESC, mean_m DESC, mad, x) AS r FROM q),
    c AS (SELECT b.u, b.r, list(a.r) AS better FROM n a JOIN n b ON a.u = b.u AND a.r < b.r AND abs(a.x - b.x) <= 5 WHERE len(list_intersect(a.sites, b.sites)) >= 0.8 * len(list_distinct(a.sites || b.sites)) GROUP BY 1, 2),
    o AS (SELECT n.u, n.r, coalesce(c.better, []) AS better FROM n LEFT JOIN c ON c.u = n.u AND c.r = n.r),
    v AS (SELECT u, 0::BIGINT AS r, []::BIGINT[] AS kept FROM n GROUP BY 1 UNION ALL SELECT o.u, o.r, CASE WHEN list_has_any(v.kept, o.better) THEN v.kept ELSE list_append(v.kept, o.r) END FROM v JOIN o ON o.u = v.u AND o.r = v.r + 1),
    k AS (SELECT u, unnest(kept) AS r FROM (SELECT u, arg_max(kept, r) AS kept FROM v GROUP BY 1)),
    clusters AS (SELECT n.u AS user_id, row_number() OVER (PARTITION BY n.u ORDER BY n.n_support DESC, n.mad, n.x) - 1 AS cluster_id, CAST(n.x AS DOUBLE) AS median, n.mad, n.n_support, n.support_frac, n.pos_min, n.pos_max, n.mean_m, n.min_m, n.n_best, n.mean_ties, n.sites
                 FROM n JOIN k ON k.u = n.u AND k.r = n.r)"""
_ROUNDED = ["support_frac", "mean_m", "mean_ties"]


@query(f"""WITH RECURSIVE {_CLUSTERS} SELECT user_id, cluster_id, median, mad, n_support, round(support_frac, 9) AS support_frac, pos_min, pos_max, round(mean_m, 9) AS mean_m, min_m, n_best, round(mean_ties, 9) AS mean_ties, array_to_string(sites, ',') AS sites FROM clusters""")
def cluster_positions(spark, sf_dir):
    """Values that recur across the weekdays of a user, as position clusters."""
    found = positions.position_clusters(user_hits(spark, sf_dir), ["user_id"], "site", "pos", "m", "k_valid")
    return found.withColumns({c: F.round(c, 9) for c in _ROUNDED} | {"sites": F.array_join(F.transform("sites", lambda s: s.cast("string")), ",")})


_MERGED = f"""{_CLUSTERS},
    z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean_m DESC, mad, cluster_id) AS r FROM clusters),
    zc AS (SELECT b.user_id, b.r, list(a.r) AS better FROM z a JOIN z b ON a.user_id = b.user_id AND a.r < b.r AND abs(a.median - b.median) <= 8 WHERE len(list_intersect(a.sites, b.sites)) >= 0.6 * len(list_distinct(a.sites || b.sites)) GROUP BY 1, 2),
    zo AS (SELECT z.user_id, z.r, coalesce(zc.better, []) AS better FROM z LEFT JOIN zc ON zc.user_id = z.user_id AND zc.r = z.r),
    zv AS (SELECT user_id, 0::BIGINT AS r, []::BIGINT[] AS kept FROM z GROUP BY 1 UNION ALL SELECT zo.user_id, zo.r, CASE WHEN list_has_any(zv.kept, zo.better) THEN zv.kept ELSE list_append(zv.kept, zo.r) END FROM zv JOIN zo ON zo.user_id = zv.user_id AND zo.r = zv.r + 1),
    zk AS (SELECT user_id, arg_max(kept, r) AS kept FROM zv GROUP BY 1),
    za AS (SELECT zo.user_id, zo.r, coalesce(list_min(list_intersect(zk.kept, zo.better)), zo.r) AS a FROM zo JOIN zk ON zk.user_id = zo.user_id),
    pairs AS (SELECT za.user_id, y.cluster_id, z.cluster_id AS anchor FROM za JOIN z y ON y.user_id = za.user_id AND y.r = za.r JOIN z ON z.user_id = za.user_id AND z.r = za.a)"""


def merged_clusters(spark, sf_dir):
    c = positions.position_clusters(user_hits(spark, sf_dir), ["user_id"], "site", "pos", "m", "k_valid")
    return c, positions.greedy_merge(c, ["user_id"], "cluster_id", [("mean_m", False), ("mad", True)], {"median": 8.0}, "sites", 0.6)


@query(f"WITH RECURSIVE {_MERGED} SELECT user_id, cluster_id, anchor FROM pairs")
def cluster_merge(spark, sf_dir):
    """The clusters of cluster_positions, neighbours with much the same support merged into the best."""
    return merged_clusters(spark, sf_dir)[1]


@query(f"""WITH RECURSIVE {_MERGED} SELECT p.user_id, p.anchor, count(*) AS n_merged, min(c.median) AS median_min, max(c.median) AS median_max, array_to_string(list_sort(list_distinct(flatten(list(c.sites)))), ',') AS sites
    FROM pairs p JOIN clusters c ON c.user_id = p.user_id AND c.cluster_id = p.cluster_id GROUP BY 1, 2""")
def cluster_merged(spark, sf_dir):
    """What each anchor of cluster_merge stands for."""
    c, anchors = merged_clusters(spark, sf_dir)
    found = positions.merged(c, anchors, ["user_id"], "cluster_id", ["median"], "sites")
    return found.withColumn("sites", F.array_join(F.transform("sites", lambda s: s.cast("string")), ","))


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT user_id AS c, event_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS lo, CAST(floor(epoch(ts)) AS BIGINT) + 3600 * CAST(floor(value) AS BIGINT) AS hi FROM events),
    p AS (SELECT a.c, a.k AS x, b.k AS y FROM e a JOIN e b ON a.c = b.c AND a.k <> b.k AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 7200),
    r AS (SELECT c, k AS node, k AS root FROM e UNION SELECT p.c, p.y, r.root FROM r JOIN p ON p.x = r.node AND p.c = r.c)
    SELECT c AS contig, node AS event_id, min(root) AS root FROM r GROUP BY 1, 2""")
def link_overlap_groups(spark, sf_dir):
    """Events of a user as intervals of time: groups that overlap by two hours or more."""
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("contig"), "event_id", s.alias("lo"), (s + 3600 * F.floor("value")).alias("hi"))
    return linkage.interval_groups(e, ["contig"], "event_id", "lo", "hi", 7200)


@query("""
    WITH RECURSIVE p AS (SELECT s_nationkey AS g, s_suppkey AS k, s_acctbal AS v FROM supplier),
    e AS (SELECT a.g, a.k AS x, b.k AS y FROM p a JOIN p b ON a.g = b.g AND a.k <> b.k AND abs(a.v - b.v) <= 500),
    r AS (SELECT g, k AS node, k AS root FROM p UNION SELECT e.g, e.y, r.root FROM r JOIN e ON e.x = r.node AND e.g = r.g),
    m AS (SELECT g, node, min(root) AS root FROM r GROUP BY 1, 2), n AS (SELECT g AS s_nationkey, count(DISTINCT root) AS n_groups FROM m GROUP BY 1)
    SELECT s_nationkey, n_groups, n_groups >= 3 AS passes, CASE WHEN n_groups < 3 THEN 'insufficient_bg_groups' END AS reason FROM n""")
def group_similar(spark, sf_dir):
    """Suppliers of a nation linked by like balances: groups, and whether a nation has three or more."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    named = s.withColumn("key", F.struct("s_nationkey", "s_suppkey"))
    linked = linkage.chain_links(named, ["s_nationkey"], "key", "s_acctbal", 500).select(F.col("a.s_nationkey").alias("s_nationkey"), F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))
    return linkage.group_gate(linkage.threshold_groups(s, linked, ["s_nationkey"], "s_suppkey", "a", "b"), ["s_nationkey"])


@query("""
    WITH p AS (SELECT a.s_nationkey, a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE abs(a.s_acctbal - b.s_acctbal) <= 2000),
    e AS (SELECT s_nationkey, x AS anchor, y AS o FROM p UNION ALL SELECT s_nationkey, y, x FROM p), c AS (SELECT s_nationkey, anchor, count(DISTINCT o) AS members FROM e GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY members DESC, anchor) AS k FROM c) SELECT s_nationkey, anchor, members FROM r WHERE k = 1""")
def link_star_anchor(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return linkage.near_star_anchor(s, ["s_nationkey"], "s_suppkey", "s_acctbal", 2000)
