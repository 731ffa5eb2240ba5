"""Queries of positional window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import windows as w
from siftline.registry import query, table


def daily(spark, sf_dir):
    d = F.datediff("l_shipdate", F.lit("1970-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", d.alias("day")).agg(F.sum(F.round("l_extendedprice").cast("long")).alias("total"), F.count(F.lit(1)).alias("n"))


DAILY = "WITH d AS (SELECT l_returnflag, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@query(f"""{DAILY}, t AS (SELECT *, max(total) OVER (PARTITION BY l_returnflag ORDER BY day RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS top FROM d)
    SELECT l_returnflag, CAST(day AS INTEGER) AS day, total FROM t WHERE total = top AND total >= 1000""")
def window_peaks(spark, sf_dir):
    return w.peaks(daily(spark, sf_dir), ["l_returnflag"], "day", "total", 5, 1000).select("l_returnflag", "day", "total")


@query(f"""{DAILY} SELECT l_returnflag, CAST(day AS INTEGER) AS day, round(avg(total) OVER p, 4) AS mean, CASE WHEN count(*) OVER f = 5 THEN round(avg(total) OVER f, 4) END AS forward FROM d
    WINDOW p AS (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), f AS (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""")
def window_sliding_means(spark, sf_dir):
    a = w.sliding_mean(daily(spark, sf_dir), ["l_returnflag"], "day", "total", 4, 4).withColumnRenamed("window_mean", "mean")
    b = w.sliding_mean(a, ["l_returnflag"], "day", "total", 0, 4, full=True)
    return b.select("l_returnflag", "day", F.round("mean", 4).alias("mean"), F.round("window_mean", 4).alias("forward"))


@query(f"""{DAILY} SELECT l_returnflag, CAST(day AS INTEGER) AS day, CASE WHEN count(*) OVER f = 6 THEN round(CAST(sum(total * n) OVER f AS DOUBLE) / sum(n) OVER f, 4) END AS weighted_mean FROM d
    WINDOW f AS (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)""")
def window_weighted_mean(spark, sf_dir):
    return w.weighted_mean(daily(spark, sf_dir), ["l_returnflag"], "day", "total", "n", 6).select("l_returnflag", "day", F.round("weighted_mean", 4).alias("weighted_mean"))


@query("""
    WITH g AS (SELECT p_size AS i, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS j, count(*) AS v FROM part GROUP BY 1, 2)
    SELECT a.i, a.j, CAST(sum(b.v) AS BIGINT) AS box FROM g a JOIN g b ON abs(a.i - b.i) <= 2 AND abs(a.j - b.j) <= 2 GROUP BY 1, 2""")
def window_box_sum(spark, sf_dir):
    g = table(spark, sf_dir, "part").select(F.col("p_size").alias("i"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("j"), F.lit(1).alias("one"))
    return w.box_sum(g, [], "i", "j", "one", 2)


SPANS = "WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS lo, epoch_us(ts) // 1000000 + 86400 AS hi FROM events), m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)"


def spans(spark, sf_dir):
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("user_id", s.alias("lo"), (s + 86400).alias("hi"))


@query(f"""{SPANS}, r AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM r GROUP BY user_id, run""")
def window_islands(spark, sf_dir):
    return w.islands(spans(spark, sf_dir), ["user_id"], "lo", "hi")


@query(f"{SPANS} SELECT user_id, reach AS lo, lo AS hi FROM m WHERE lo - reach >= 43200")
def window_gaps(spark, sf_dir):
    return w.gaps(spans(spark, sf_dir), ["user_id"], "lo", "hi", 43200)


@query("""
    SELECT o_orderkey, CAST(CASE WHEN o_orderstatus <> 'P' THEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey) END AS INTEGER) AS by_price,
        CAST(CASE WHEN o_orderstatus <> 'P' THEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus <> 'P' ORDER BY o_orderdate, o_orderkey) END AS INTEGER) AS by_date,
        CAST(CASE WHEN o_orderstatus <> 'P' THEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus <> 'P' ORDER BY o_orderpriority, o_totalprice, o_orderkey) END AS INTEGER) AS by_priority FROM orders""")
def window_three_ranks(spark, sf_dir):
    orders = {"by_price": [F.desc("o_totalprice")], "by_date": [F.asc("o_orderdate")], "by_priority": [F.asc("o_orderpriority"), F.asc("o_totalprice")]}
    return w.three_ranks(table(spark, sf_dir, "orders"), ["o_custkey"], orders, "o_orderkey", F.col("o_orderstatus") != "P").select("o_orderkey", *orders)


@query("WITH m AS (SELECT l_orderkey, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best FROM lineitem) SELECT l_orderkey, max(best) AS best, count(*) FILTER (l_quantity = best) AS ties FROM m GROUP BY 1")
def window_tie_multiplicity(spark, sf_dir):
    return w.tie_multiplicity(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey"], "l_quantity")


@query("""
    WITH m AS (SELECT l_partkey, l_quantity, quantile_cont(l_quantity, 0.5) OVER (PARTITION BY l_partkey) AS med FROM lineitem)
    SELECT l_partkey, max(med) AS median, count(*) FILTER (abs(l_quantity - med) <= 5) AS coherent, count(*) AS n FROM m GROUP BY 1""")
def window_coherent_count(spark, sf_dir):
    return w.coherent_count(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), ["l_partkey"], "l_quantity", 5)


@query(f"""{DAILY}, m AS (SELECT *, avg(total) OVER (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS mean FROM d),
    b AS (SELECT l_returnflag, day, mean, row_number() OVER (PARTITION BY l_returnflag ORDER BY mean DESC, day) AS r FROM m), p AS (SELECT l_returnflag, day AS peak FROM b WHERE r = 1)
    SELECT l_returnflag, CAST(any_value(peak) AS INTEGER) AS peak, round(avg(total) FILTER (abs(day - peak) > 4), 4) AS off_peak FROM m JOIN p USING (l_returnflag) GROUP BY 1""")
def window_off_peak_mean(spark, sf_dir):
    m = w.sliding_mean(daily(spark, sf_dir), ["l_returnflag"], "day", "total", 4, 4)
    p = m.groupBy("l_returnflag").agg(F.max_by("day", F.struct("window_mean", -F.col("day"))).alias("peak"))
    return m.join(p, "l_returnflag").groupBy("l_returnflag").agg(F.first("peak").alias("peak"), F.round(F.avg(F.when(F.abs(F.col("day") - F.col("peak")) > 4, F.col("total"))), 4).alias("off_peak"))
