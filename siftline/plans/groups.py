"""Queries of grouped aggregates and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import aggregates as a, match, validate
from siftline.registry import query, table


@query("""
    WITH m AS (SELECT l_partkey, l_extendedprice AS x, quantile_cont(l_extendedprice, 0.5) OVER (PARTITION BY l_partkey) AS m FROM lineitem)
    SELECT l_partkey, count(x) AS n, round(min(m), 6) AS median, round(quantile_cont(abs(x - m), 0.5), 6) AS mad, min(x) AS least, max(x) AS most, round(avg(x), 6) AS mean, round(stddev_pop(x), 4) AS std FROM m GROUP BY 1""")
def agg_spread(spark, sf_dir):
    s = a.with_spread(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice")
    return s.select("l_partkey", "n", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "least", "most", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"))


@query("""
    WITH s AS (SELECT l_returnflag, list(l_extendedprice ORDER BY l_extendedprice) AS x FROM lineitem GROUP BY 1)
    SELECT l_returnflag, x[CAST(least(floor(len(x) * 50 / 100.0), len(x) - 1) AS BIGINT) + 1] AS p50, x[CAST(least(floor(len(x) * 90 / 100.0), len(x) - 1) AS BIGINT) + 1] AS p90, x[CAST(least(floor(len(x) * 99 / 100.0), len(x) - 1) AS BIGINT) + 1] AS p99 FROM s""")
def agg_floor_percentiles(spark, sf_dir):
    return a.floor_index(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 50, "p90": 90, "p99": 99}).drop("n")


@query("SELECT l_shipmonth, round(q[1], 6) AS q1, round(q[2], 6) AS q2, round(q[3], 6) AS q3, round(big, 6) AS big FROM (SELECT month(l_shipdate) AS l_shipmonth, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q, avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END) AS big FROM lineitem GROUP BY 1)")
def agg_linear_quantiles(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.month("l_shipdate").cast("long").alias("l_shipmonth")).agg(a.quantiles("l_extendedprice", [0.25, 0.5, 0.75]).alias("q"), F.avg((F.col("l_quantity") > 25).cast("double")).alias("big"))
    return g.select("l_shipmonth", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)], F.round("big", 6).alias("big"))


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) SELECT user_id, event_type AS mode, n FROM r WHERE k = 1""")
def agg_modal(spark, sf_dir):
    return a.modal(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS t FROM c GROUP BY 1)
    SELECT user_id, count(*) AS n_values, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM c JOIN t USING (user_id) GROUP BY 1""")
def agg_entropy(spark, sf_dir):
    return a.entropy(table(spark, sf_dir, "events"), ["user_id"], "event_type").withColumn("entropy", F.round("entropy", 6) + 0.0)


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT t, (SELECT count(*) FROM c WHERE n >= t) AS n_at_least FROM (SELECT DISTINCT n AS t FROM c)")
def agg_at_least(spark, sf_dir):
    return a.at_least(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "n")


@query("""
    WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus DESC) AS k, sum(n) OVER (PARTITION BY o_custkey) AS t FROM c)
    SELECT o_custkey, CASE WHEN n / t >= 0.6 THEN o_orderstatus ELSE 'mixed' END AS verdict, round(n / t, 6) AS share FROM r WHERE k = 1""")
def agg_majority(spark, sf_dir):
    return a.majority(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", 0.6).withColumn("share", F.round("share", 6))


@query("""
    WITH c AS (SELECT l_returnflag AS r, p_size AS c, l_linestatus AS l, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
    w AS (SELECT r, c, coalesce(sum(n) FILTER (l = 'O'), 0) + 0.5 AS a, coalesce(sum(n) FILTER (l = 'F'), 0) + 0.5 AS b FROM c GROUP BY 1, 2)
    SELECT r AS l_returnflag, c AS p_size, round(ln((a / sum(a) OVER (PARTITION BY r)) / (b / sum(b) OVER (PARTITION BY r))), 6) AS enrichment FROM w""")
def agg_log_enrichment(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return a.log_enrichment(a.contingency(j, ["l_returnflag", "p_size"], "l_linestatus"), "l_returnflag", "p_size", "l_linestatus", "O", "F").withColumn("enrichment", F.round("enrichment", 6))


@query("""
    SELECT 'all' AS axis, 'all' AS stratum, count(*) AS n, round(avg(l_quantity), 6) AS mean, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS discounted FROM lineitem
    UNION ALL SELECT 'l_returnflag', l_returnflag, count(*), round(avg(l_quantity), 6), sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), round(avg(l_quantity), 6), sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*), round(avg(l_quantity), 6), sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT FROM lineitem GROUP BY 2""")
def agg_strata(spark, sf_dir):
    return a.strata(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], [F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.count_if(F.col("l_discount") > 0.05).alias("discounted")])


@query("""
    WITH x AS (SELECT unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM benchmark WHERE text <> ''), n AS (SELECT pos, c, count(*) AS n FROM x GROUP BY 1, 2),
    r AS (SELECT pos, c, n, sum(n) OVER (PARTITION BY pos) AS t, row_number() OVER (PARTITION BY pos ORDER BY n DESC, encode(c)) AS k FROM n) SELECT CAST(pos AS INTEGER) AS pos, c, round(n / t, 6) AS share FROM r WHERE k = 1""")
def agg_consensus(spark, sf_dir):
    return a.consensus(table(spark, sf_dir, "benchmark"), [], "text").withColumn("share", F.round("share", 6))


@query("""
    WITH n AS (SELECT l_shipmonth, l_linenumber, count(*) AS n FROM (SELECT month(l_shipdate) AS l_shipmonth, l_linenumber FROM lineitem) GROUP BY 1, 2), q AS (SELECT l_linenumber, count(*) / (SELECT count(*) FROM lineitem) AS q FROM lineitem GROUP BY 1),
    p AS (SELECT l_shipmonth, l_linenumber, n / sum(n) OVER (PARTITION BY l_shipmonth) AS p FROM n) SELECT l_shipmonth, round(sum(p * ln(greatest(p / q, 1e-12))), 6) AS nats FROM p JOIN q USING (l_linenumber) GROUP BY 1""")
def agg_information_content(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.month("l_shipdate").cast("long").alias("l_shipmonth"), "l_linenumber")
    total = rows.agg(F.count(F.lit(1)).alias("t"))
    q = rows.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("l_linenumber", (F.col("n") / F.col("t")).alias("q"))
    n = rows.groupBy("l_shipmonth", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return a.information_content(n, ["l_shipmonth"], "l_linenumber", q).withColumn("nats", F.round("nats", 6))


@query("""
    WITH u AS (SELECT l_returnflag, 'l_quantity' AS channel, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem)
    SELECT l_returnflag, channel, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95 FROM u GROUP BY 1, 2""")
def agg_channel_summary(spark, sf_dir):
    s = a.unpivot_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], [0.25, 0.5, 0.95])
    return s.select("l_returnflag", "channel", *[F.round(c, 6).alias(c) for c in ("mean", "p25", "p50", "p95")])


@query("""
    WITH o AS (SELECT l_orderkey, count(*) AS n_sites, count(DISTINCT l_suppkey) = count(*) AS all_distinct, stddev_pop(l_quantity) AS sd, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
    SELECT n_sites, count(*) AS n, round(avg(CASE WHEN all_distinct THEN 1.0 ELSE 0.0 END), 6) AS distinct_share, round(quantile_cont(sd, 0.5), 6) AS median_sd, CAST(sum(returned) AS BIGINT) AS returned FROM o GROUP BY 1""")
def agg_two_levels(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_sites"), (F.countDistinct("l_suppkey") == F.count(F.lit(1))).alias("all_distinct"), F.stddev_pop("l_quantity").alias("sd"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return o.groupBy("n_sites").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("all_distinct").cast("double")), 6).alias("distinct_share"), F.round(a.median("sd"), 6).alias("median_sd"), F.sum("returned").alias("returned"))


@query("""
    WITH d AS (SELECT l_returnflag, unnest(range(1, 51)) AS q FROM (SELECT DISTINCT l_returnflag FROM lineitem)), c AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT d.l_returnflag, d.q, coalesce(c.n, 0) AS n FROM d LEFT JOIN c USING (l_returnflag, q)""")
def agg_dense_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    grid = rows.select("l_returnflag").distinct().withColumn("q", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(50).cast("long"))))
    counts = rows.groupBy("l_returnflag", "q").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["l_returnflag", "q"], "left").select("l_returnflag", "q", F.coalesce("n", F.lit(0)).alias("n"))


CHECKS = {"price": "l_extendedprice > 0", "discount": "l_discount <= 0.09", "quantity": "l_quantity BETWEEN 2 AND 50", "flag": "l_returnflag IN ('A', 'N', 'R')"}


@query("WITH c AS (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (NOT ({t})) AS {k}" for k, t in CHECKS.items()) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", {k} AS n_failed, n FROM c" for k in CHECKS))
def validate_summary(spark, sf_dir):
    return validate.summary(table(spark, sf_dir, "lineitem"), {k: F.expr(t) for k, t in CHECKS.items()})


@query(" UNION ALL ".join(f"SELECT l_orderkey, '{k}' AS \"check\" FROM lineitem WHERE NOT ({t})" for k, t in CHECKS.items()))
def validate_violations(spark, sf_dir):
    return validate.violations(table(spark, sf_dir, "lineitem"), "l_orderkey", {k: F.expr(t) for k, t in CHECKS.items()})


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def validate_duplicates(spark, sf_dir):
    return validate.no_duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("""
    WITH g AS (SELECT o_custkey, count(*) AS n, list(DISTINCT o_orderstatus) AS c, count(DISTINCT o_orderpriority) AS f FROM orders GROUP BY 1)
    SELECT o_custkey, 'duplicate' AS problem FROM g WHERE n > len(c) UNION ALL SELECT o_custkey, 'unknown' FROM g WHERE list_contains(c, 'P') UNION ALL
    SELECT o_custkey, 'missing' FROM g WHERE NOT (list_contains(c, 'F') AND list_contains(c, 'O')) UNION ALL SELECT o_custkey, 'fingerprints' FROM g WHERE f > 1""")
def validate_conditions(spark, sf_dir):
    return validate.conditions_complete(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O"], "o_orderpriority")


@query("""
    WITH s AS (SELECT o_custkey, count(*) AS n, avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END) AS p FROM orders GROUP BY 1) SELECT o_custkey, n, p FROM s WHERE n >= 5 AND p IN (0.0, 1.0)""")
def validate_degenerate(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "P").cast("double")).alias("p"))
    return validate.degenerate(s, ["p"], "n", 5)


@query("""
    SELECT event_id, CASE lower(event_type) WHEN 'forward' THEN 'fwd' ELSE lower(event_type) END AS orient, CASE WHEN value < 1 OR value IS NULL THEN 'not_in_pool' WHEN value <= 4 THEN '1-4' WHEN value <= 20 THEN '5-20' WHEN value <= 50 THEN '21-50' ELSE '51+' END AS regime,
        CASE WHEN value >= 100 THEN 'INSIDE' WHEN value + 10 <= 100 THEN 'OUTSIDE' ELSE 'CROSSES' END AS side, CASE WHEN value <= 5 THEN '5p_edge' WHEN value + 10 >= 195 THEN '3p_edge' ELSE 'middle' END AS edge FROM events""")
def classify_positions(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", match.orientation("event_type").alias("orient"), match.rank_regime(v).alias("regime"), match.side_of_boundary(v, F.lit(10), F.lit(100)).alias("side"), match.edge_class(v, v + 10, F.lit(200), 5).alias("edge"))


@query("""
    WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_totalprice < 5000 THEN 'cheap' WHEN o_orderstatus = 'P' THEN 'pending' END AS drop_reason FROM orders)
    SELECT o_orderkey, drop_reason, count(*) FILTER (drop_reason IS NULL) OVER (PARTITION BY o_custkey) AS k_valid FROM b""")
def filter_frozen_denominator(spark, sf_dir):
    from pyspark.sql import Window

    reason = F.when(F.col("o_totalprice") < 5000, "cheap").when(F.col("o_orderstatus") == "P", "pending")
    return table(spark, sf_dir, "orders").withColumn("drop_reason", reason).select("o_orderkey", "drop_reason", F.count_if(F.col("drop_reason").isNull()).over(Window.partitionBy("o_custkey")).alias("k_valid"))
