"""Queries of rank metrics, resampling and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import metrics as m
from siftline.registry import query, table
from siftline.session import cut


def judged(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("score")).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("pos", F.col("quality") == 1)


JUDGED = "WITH j AS (SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS score, quality = 1 AS pos, toxic FROM documents JOIN labels USING (doc_id))"


@query(f"""{JUDGED} SELECT lang, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg,
    round((SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) FROM j a, j b WHERE a.pos AND NOT b.pos AND a.lang = j.lang AND b.lang = j.lang), 6) AS auroc FROM j GROUP BY lang""")
def metric_auroc(spark, sf_dir):
    return m.auroc(judged(spark, sf_dir), ["lang"], "score", F.col("pos")).withColumn("auroc", F.round("auroc", 6))


@query(f"""{JUDGED} SELECT lang, (SELECT count(*) FROM j WHERE pos) AS n_pos, count(*) AS n_neg,
    round((SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) FROM j a, j b WHERE a.pos AND NOT b.pos AND b.lang = j.lang), 6) AS auroc FROM j WHERE NOT pos GROUP BY lang""")
def metric_stratified_auroc(spark, sf_dir):
    return m.stratified_auroc(judged(spark, sf_dir).select("lang", "score", "pos"), "score", F.col("pos"), "lang").withColumn("auroc", F.round("auroc", 6))


@query(f"""{JUDGED}, r AS (SELECT lang, pos, row_number() OVER w AS k, sum(CASE WHEN pos THEN 1 ELSE 0 END) OVER w AS tp FROM j WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))
    SELECT lang, round(avg(tp / k), 6) AS ap, count(*) AS n_pos FROM r WHERE pos GROUP BY lang""")
def metric_average_precision(spark, sf_dir):
    return m.average_precision(judged(spark, sf_dir), ["lang"], "score", F.col("pos"), "doc_id").withColumn("ap", F.round("ap", 6))


@query("""
    WITH g AS (SELECT l_orderkey, l_quantity, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) OVER (PARTITION BY l_orderkey) AS g FROM lineitem),
    n AS (SELECT l_orderkey, count(*) FILTER (l_quantity > g) AS above, count(*) FILTER (l_quantity = g) - 1 AS tied FROM g WHERE g IS NOT NULL GROUP BY 1)
    SELECT l_orderkey, above + 1 + tied / 2 AS rank, round(list_sum(list_transform(range(1, CAST(tied + 2 AS BIGINT)), lambda i: 1.0 / (above + i))) / (tied + 1), 6) AS mrr,
        round(greatest(least(1 - above, tied + 1), 0) / (tied + 1), 6) AS recall_1, round(greatest(least(3 - above, tied + 1), 0) / (tied + 1), 6) AS recall_3 FROM n""")
def metric_expected_ranks(spark, sf_dir):
    r = m.expected_ranks(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", F.col("l_linenumber") == 1, [1, 3])
    return r.select("l_orderkey", "rank", *[F.round(c, 6).alias(c) for c in ("mrr", "recall_1", "recall_3")])


BOOT = """
    u AS (SELECT unit, num, den, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS n FROM s),
    d AS (SELECT b, CAST(floor(CAST(('0x' || substr(md5('0::' || b || '::' || i), 1, 8)) AS BIGINT) / 4294967296.0 * n) AS BIGINT) AS i FROM u, unnest(range(1, 201)) AS t(b)),
    r AS (SELECT b, sum(num) / sum(den) AS r FROM d JOIN u USING (i) GROUP BY b)"""


@query(f"""
    WITH s AS (SELECT l_suppkey AS unit, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS num, CAST(count(*) AS DOUBLE) AS den FROM lineitem GROUP BY 1), {BOOT}
    SELECT (SELECT count(*) FROM s) AS n_units, (SELECT round(sum(num) / sum(den), 6) FROM s) AS ratio, round(quantile_cont(r, 0.025), 6) AS lo, round(quantile_cont(r, 0.975), 6) AS hi FROM r""")
def metric_bootstrap_ratio(spark, sf_dir):
    r = m.bootstrap_ratio(table(spark, sf_dir, "lineitem"), "l_suppkey", (F.col("l_returnflag") == "R").cast("int"), F.lit(1))
    return r.select("n_units", *[F.round(c, 6).alias(c) for c in ("ratio", "lo", "hi")])


@query(f"""
    WITH s AS (SELECT s_suppkey AS unit, sum(l_extendedprice * l_discount - l_extendedprice * l_tax) AS num, CAST(count(*) AS DOUBLE) AS den FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1), {BOOT}
    SELECT (SELECT count(*) FROM s) AS n_units, (SELECT round(sum(num) / sum(den), 4) FROM s) AS delta, round(quantile_cont(r, 0.025), 4) AS lo, round(quantile_cont(r, 0.975), 4) AS hi FROM r""")
def metric_mean_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") * F.col("l_discount")).alias("a"), (F.col("l_extendedprice") * F.col("l_tax")).alias("b"))
    return m.mean_difference(rows, "l_suppkey", "a", "b").select("n_units", *[F.round(c, 4).alias(c) for c in ("delta", "lo", "hi")])


@query("""
    WITH x AS (SELECT event_type AS c, round(value) AS s FROM events), n AS (SELECT c, count(*) AS n FROM x GROUP BY 1), t AS (SELECT DISTINCT s FROM x),
    r AS (SELECT t.s, n.c, (SELECT count(*) FROM x WHERE x.c = n.c AND x.s > t.s) / n.n AS rate FROM t, n), w AS (SELECT s, max(rate) AS worst FROM r GROUP BY s)
    SELECT min(s) AS threshold, round(arg_min(worst, s), 6) AS worst_rate FROM w WHERE worst <= 0.05""")
def metric_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.round("value").alias("s"))
    return m.threshold_for(rows, "event_type", "event_id", "s", 0.05).withColumn("worst_rate", F.round("worst_rate", 6))


@query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN value >= 60 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM events GROUP BY 1")
def metric_pass_rates(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") >= 60).cast("double")), 6).alias("pass_rate"))


@query("""
    WITH x AS (SELECT s_acctbal AS x FROM supplier), t AS (SELECT sum(x) AS s, count(x) AS n, avg(x) AS m FROM x), l AS (SELECT m, (s - x) / (n - 1) AS loo FROM x, t)
    SELECT round(any_value(m), 4) AS mean, round(stddev_samp(loo), 4) AS loo_std, round(max(m - loo), 4) AS max_drop FROM l""")
def metric_leave_one_out(spark, sf_dir):
    return m.leave_one_out(table(spark, sf_dir, "supplier"), "s_acctbal").select(*[F.round(c, 4).alias(c) for c in ("mean", "loo_std", "max_drop")])


WEIGHTS = """WITH a AS (SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2), b AS (SELECT l_linenumber, l_returnflag, count(*) AS m FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
    c AS (SELECT l_linenumber, l_returnflag, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM a FULL JOIN b USING (l_linenumber, l_returnflag)), t AS (SELECT sum(n) AS tn, sum(m) AS tm, count(*) AS k FROM c),
    w AS (SELECT l_linenumber, l_returnflag, n, ((m + 1) / (tm + k)) / ((n + 1) / (tn + k)) AS weight FROM c, t)"""


def weights(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return m.importance_weights(rows.where("l_linestatus = 'O'"), rows.where("l_linestatus = 'F'"), ["l_linenumber", "l_returnflag"])


@query(f"{WEIGHTS} SELECT l_linenumber, l_returnflag, n, round(weight, 6) AS weight FROM w")
def metric_importance_weights(spark, sf_dir):
    return weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query(f"{WEIGHTS} SELECT round(pow(sum(n * weight), 2) / sum(n * weight * weight), 4) AS ess, CAST(sum(n) AS BIGINT) AS n FROM w")
def metric_effective_size(spark, sf_dir):
    return m.effective_size(weights(spark, sf_dir)).withColumn("ess", F.round("ess", 4))


@query("""
    WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS c FROM lineitem GROUP BY 1, 2), p AS (SELECT l_returnflag, l_quantity, (1 + sum(c) OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC)) / (1 + sum(c) OVER (PARTITION BY l_returnflag)) AS p FROM c)
    SELECT l_returnflag, l_quantity, round(p, 6) AS p, round(-ln(p), 6) AS log_inverse FROM p""")
def metric_empirical_tail(spark, sf_dir):
    t = m.empirical_tail(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return t.select("l_returnflag", "l_quantity", F.round("p", 6).alias("p"), F.round("log_inverse", 6).alias("log_inverse"))


@query("""SELECT round((avg(l_extendedprice) FILTER (l_returnflag = 'R') - avg(l_extendedprice) FILTER (l_returnflag <> 'R')) / sqrt((var_pop(l_extendedprice) FILTER (l_returnflag = 'R') + var_pop(l_extendedprice) FILTER (l_returnflag <> 'R')) / 2), 6) AS d,
    count(*) FILTER (l_returnflag = 'R') AS n_a, count(*) FILTER (l_returnflag <> 'R') AS n_b FROM lineitem""")
def metric_cohens_d(spark, sf_dir):
    return m.cohens_d(table(spark, sf_dir, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R").withColumn("d", F.round("d", 6))


@query("""
    WITH p AS (SELECT event_id, (value % 97 + 1) / 99 AS a, (value % 89 + 1) / 91 AS b FROM events)
    SELECT event_id, round(-ln(1 + (1 - a) / a) - ln(1 + (1 - b) / b), 6) AS raw_and, round(least(a, b), 6) AS hard_min, round(-ln((1 - a) / a + (1 - b) / b), 6) AS soft_min FROM p""")
def metric_fusion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("value") % 97 + 1) / 99).alias("a"), ((F.col("value") % 89 + 1) / 91).alias("b"))
    return e.select("event_id", *[F.round(c, 6).alias(n) for n, c in m.fused([F.col("a"), F.col("b")]).items()])


@query("""
    WITH r AS (SELECT o_custkey, max(o_totalprice) AS x FROM orders GROUP BY 1), b AS (SELECT r.o_custkey, x, o_totalprice AS r FROM r JOIN orders o ON o.o_custkey = r.o_custkey WHERE o_totalprice < x)
    SELECT o_custkey, round(avg(CASE WHEN r < x THEN 1.0 WHEN r = x THEN 0.5 ELSE 0.0 END), 6) AS rank, round(x - avg(r), 4) AS delta, CASE WHEN stddev_samp(r) > 0 THEN round((x - avg(r)) / stddev_samp(r), 4) END AS z FROM b GROUP BY o_custkey, x""")
def metric_rank_vs_replicates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    real = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    others = o.join(real.withColumnRenamed("o_totalprice", "most"), "o_custkey").where("o_totalprice < most").select("o_custkey", "o_totalprice")
    r = m.rank_vs_replicates(real, others, ["o_custkey"], "o_totalprice")
    return r.select("o_custkey", F.round("rank", 6).alias("rank"), F.round("delta", 4).alias("delta"), F.round("z", 4).alias("z"))


@query(f"""{JUDGED}, a AS (SELECT lang, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, (SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) FROM j a, j b WHERE a.pos AND NOT b.pos AND a.lang = j.lang AND b.lang = j.lang) AS a FROM j GROUP BY lang),
    s AS (SELECT *, sqrt(greatest((a * (1 - a) + (n_pos - 1) * (a / (2 - a) - a * a) + (n_neg - 1) * (2 * a * a / (1 + a) - a * a)) / (n_pos * CAST(n_neg AS DOUBLE)), 0)) AS se FROM a)
    SELECT lang, round(a, 6) AS auroc, round(greatest(a - 1.959963984540054 * se, 0), 6) AS lo, round(least(a + 1.959963984540054 * se, 1), 6) AS hi FROM s""")
def metric_normal_intervals(spark, sf_dir):
    a = m.hanley_mcneil(m.auroc(judged(spark, sf_dir), ["lang"], "score", F.col("pos")))
    return a.select("lang", *[F.round(c, 6).alias(c) for c in ("auroc", "lo", "hi")])


def intervals_sql(name: str, k: str, n: str, source: str) -> str:
    """Tables for a query WITH RECURSIVE: {name} (k, n, lo, hi), the exact intervals of the distinct k of n of a table,
    by halving."""
    tail = lambda k, p: f"coalesce(list_sum(list_transform(range(CAST({k} AS BIGINT), CAST(n + 1 AS BIGINT)), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))), 0)"
    return f"""{name}_b AS (SELECT DISTINCT {k} AS k, {n} AS n, 0::DOUBLE AS a, 1::DOUBLE AS b, 0::DOUBLE AS c, 1::DOUBLE AS d, 0 AS step FROM {source}
          UNION ALL SELECT k, n, CASE WHEN low THEN (a + b) / 2 ELSE a END, CASE WHEN low THEN b ELSE (a + b) / 2 END, CASE WHEN high THEN (c + d) / 2 ELSE c END, CASE WHEN high THEN d ELSE (c + d) / 2 END, step + 1
          FROM (SELECT *, {tail("k", "((a + b) / 2)")} < 0.025 AS low, {tail("k + 1", "((c + d) / 2)")} < 0.975 AS high FROM {name}_b WHERE step < 45)),
    {name} AS (SELECT k, n, CASE WHEN k = 0 OR n = 0 THEN 0 ELSE a END AS lo, CASE WHEN k = n OR n = 0 THEN 1 ELSE d END AS hi FROM {name}_b WHERE step = 45)"""


@query(f"""WITH RECURSIVE {JUDGED.removeprefix("WITH ")}, a AS (SELECT lang, count(*) FILTER (pos) AS n_pos, count(*) AS n FROM j GROUP BY lang), {intervals_sql("ci", "n_pos", "n", "a")}
    SELECT lang, n_pos, a.n, round(lo, 9) AS lo, round(hi, 9) AS hi FROM a JOIN ci ON ci.k = a.n_pos AND ci.n = a.n""")
def metric_intervals(spark, sf_dir):
    """Exact binomial intervals of the share of good documents by language."""
    a = judged(spark, sf_dir).groupBy("lang").agg(F.count_if("pos").alias("n_pos"), F.count(F.lit(1)).alias("n"))
    return m.with_interval(a, "n_pos", "n").select("lang", "n_pos", "n", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query("""
    WITH g AS (SELECT DISTINCT CAST(p_size % 12 + 5 AS BIGINT) AS L, least(CAST(l_quantity AS BIGINT) % 17, CAST(p_size % 12 + 5 AS BIGINT)) AS m FROM lineitem JOIN part ON p_partkey = l_partkey),
    b AS (SELECT L, m, least(1.0, list_sum(list_transform(range(m, L + 1), lambda k: exp(lgamma(L + 1) - lgamma(k + 1) - lgamma(L - k + 1) + k * ln(0.25) + (L - k) * ln(0.75))))) AS tail FROM g)
    SELECT L, m, round(tail + 1e-10, 7) AS tail, round(tail * (121 - L) * 2 + 1e-7, 3) AS e_position, round(tail * (121 - L) * 2 * (201 - L) + 1e-7, 3) AS e_global, round(tail * (121 - L) * (201 - L) + 1e-7, 3) AS e_record FROM b""")
def metric_e_values(spark, sf_dir):
    """Three expectations of binomial tails for lengths and matches that parts and lines give."""
    length = (F.col("p_size") % 12 + 5).cast("long")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(length.alias("L"), F.least(F.col("l_quantity").cast("long") % 17, length).alias("m"))
    tails = m.tail_table(lines, "L", "m")
    e = m.e_values(F.col("tail"), F.lit(120) - F.col("L") + 1, F.lit(200) - F.col("L") + 1, F.lit(2))
    return tails.select("L", "m", F.round(F.col("tail") + 1e-10, 7).alias("tail"), *[F.round(c + 1e-7, 3).alias(n) for n, c in e.items()])  # the small term settles ties of rounding


@query("""
    WITH RECURSIVE e AS (SELECT user_id, (value % 100) / 400 AS p, row_number() OVER (PARTITION BY user_id ORDER BY (value % 100) / 400, event_id) AS i FROM events),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 0.0::DOUBLE AS d FROM events
          UNION ALL SELECT r.user_id, e.i, a * (1 - p), b * (1 - p) + a * p, c * (1 - p) + b * p, d + c * p FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, round(arg_max(d, i), 9) AS p FROM r GROUP BY 1""")
def metric_poisson_binomial(spark, sf_dir):
    """P(at least 3 of a user's events), each with a probability from its value."""
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list((F.col("value") % 100) / 400)).alias("ps"))
    return p.select("user_id", F.round(m.poisson_binomial_tail("ps", 3), 9).alias("p"))


@query()
def metric_platt(spark, sf_dir):
    slope, intercept = m.platt(judged(spark, sf_dir).withColumn("x", F.log1p("score")), "x", F.col("pos"))
    return spark.createDataFrame([(slope, intercept)], "slope double, intercept double")


_DRAW = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) / 4294967296.0"


@query("""
    WITH r AS (SELECT (rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) AS x, (rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0) AS y FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL)
    SELECT round(corr(x, y), 9) AS rho, count(*) AS n FROM r""")
def metric_rank_correlation(spark, sf_dir):
    return m.rank_correlation(table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey").withColumn("rho", F.round("rho", 9))


@query("""
    WITH c AS (SELECT o_totalprice AS x, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY 1),
    s AS (SELECT a, b, sum(a) OVER w AS ua, sum(b) OVER w AS ub, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM c WINDOW w AS (ORDER BY x))
    SELECT round(max(abs(ua / ta - ub / tb)), 9) AS ks, sum(a * (ub - b + b / 2.0)) AS u FROM s""")
def metric_two_samples(spark, sf_dir):
    out = m.two_samples(table(spark, sf_dir, "orders"), "o_totalprice", F.col("o_orderstatus") == "F")
    return out.select(F.round("ks", 9).alias("ks"), F.col("u").cast("double").alias("u"))


@query(f"""
    WITH h AS (SELECT DISTINCT s_nationkey AS bag, s_suppkey AS site, CAST(floor(s_acctbal / 2000) AS BIGINT) AS key FROM supplier), t AS (SELECT DISTINCT bag, site FROM h),
    k AS (SELECT *, row_number() OVER (ORDER BY bag, site) AS k FROM t), p AS (SELECT bag, site, perm, row_number() OVER (PARTITION BY perm ORDER BY {_DRAW.format("'0::' || perm || '::' || bag || '::' || site")}, bag, site) AS k FROM t, unnest(range(1, 6)) AS u(perm)),
    v AS (SELECT p.perm, p.bag, p.site, k.bag AS g FROM p JOIN k USING (k)), e AS (SELECT perm, g, bag || '|' || site AS s, key FROM h JOIN v USING (bag, site) UNION ALL SELECT 0, bag, bag || '|' || site, key FROM h),
    s AS (SELECT perm, g, key, count(DISTINCT s) AS n FROM e GROUP BY 1, 2, 3) SELECT CAST(perm AS INTEGER) AS perm, s, count(*) AS n FROM s, unnest(range(1, 6)) AS u(s) WHERE s <= n GROUP BY 1, 2""")
def metric_coherence_permutation(spark, sf_dir):
    """Suppliers as sites of nations: how many share a balance class, and when dealt anew."""
    h = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("bag"), F.col("s_suppkey").alias("site"), F.floor(F.col("s_acctbal") / 2000).alias("key")).distinct()
    return m.coherence_permutation(h, "bag", "site", "key", 5)


@query(f"""
    WITH a AS (SELECT o_custkey AS u, max(CASE WHEN o_orderpriority LIKE '1%' THEN 1.0 ELSE 0.0 END) AS x FROM orders GROUP BY 1), b AS (SELECT o_custkey AS u, max(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END) AS y FROM orders GROUP BY 1),
    j AS (SELECT u, x, y, row_number() OVER (ORDER BY u) - 1 AS i, count(*) OVER () AS n FROM a JOIN b USING (u)),
    d AS (SELECT bb, CAST(floor({_DRAW.format("'0::' || bb || '::' || i")} * n) AS BIGINT) AS i FROM j, unnest(range(1, 201)) AS t(bb)), r AS (SELECT bb, avg(j.x - j.y) AS r FROM d JOIN j USING (i) GROUP BY 1),
    f AS (SELECT count(*) AS n, avg(x) AS ra, avg(y) AS rb, count(*) FILTER (x > y) AS oa, count(*) FILTER (y > x) AS ob, avg(x - y) AS delta FROM j), c AS (SELECT quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM r),
    v AS (SELECT *, CASE WHEN n < 20 THEN 'too_few_shared' WHEN ra > 0.5 AND rb > 0.5 THEN 'both_high' WHEN lo <= 0 AND hi >= 0 THEN 'undecided' WHEN delta > 0 THEN 'b_lower' ELSE 'a_lower' END AS verdict FROM f, c)
    SELECT n, round(ra, 9) AS rate_a, round(rb, 9) AS rate_b, oa AS only_a, ob AS only_b, round(delta, 9) AS delta, round(lo, 9) AS lo, round(hi, 9) AS hi, verdict, verdict IN ('a_lower', 'b_lower') AS locked FROM v""")
def metric_decision_gate(spark, sf_dir):
    """Two detectors over the same customers."""
    o = table(spark, sf_dir, "orders")
    a = o.groupBy("o_custkey").agg(F.max(F.col("o_orderpriority").startswith("1").cast("double")).alias("hit"))
    b = o.groupBy("o_custkey").agg(F.max((F.col("o_orderstatus") == "P").cast("double")).alias("hit"))
    out = m.decision_gate(a, b, "o_custkey", "hit")
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("rate_a", "rate_b")], "only_a", "only_b", *[F.round(c, 9).alias(c) for c in ("delta", "lo", "hi")], "verdict", "locked")


@query()
def metric_cross_validated(spark, sf_dir):
    """Held-out AUROC by fold of quality labels, from the size of a text: logistic and boosted trees."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("good")), "doc_id").select("doc_id", "good", F.log1p("n_chars").alias("size"), (F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("upper"))
    d = cut(d.select("doc_id", "good", "size", "upper"), "sizes")  # texts are read once for both models
    return m.cross_validated_auroc(d, "doc_id", ["size", "upper"], "good", 3).withColumn("model", F.lit("logistic")).unionByName(m.cross_validated_auroc(d, "doc_id", ["size", "upper"], "good", 3, model="trees").withColumn("model", F.lit("trees")))


_PROBED = f"""
    d AS (SELECT doc_id AS k, min(quality) AS y, any_value(ln(1 + n_chars)) AS size, any_value(length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1)) AS upper,
                 any_value(length(regexp_replace(text, '[^ ]', '', 'g')) / greatest(length(text), 1)) AS blank FROM documents JOIN labels USING (doc_id) GROUP BY doc_id),
    w AS (UNPIVOT d ON size, upper, blank INTO NAME feature VALUE v),
    z AS (SELECT feature, CAST(floor({_DRAW.format("'0::' || k")} * 3) AS INTEGER) AS own, y, (v - avg(v) OVER (PARTITION BY feature)) / stddev_pop(v) OVER (PARTITION BY feature) AS x FROM w),
    f AS (SELECT DISTINCT feature, own AS fold FROM z),
    r AS (SELECT feature, fold, 0 AS step, 0::DOUBLE AS b0, 0::DOUBLE AS b1 FROM f
          UNION ALL SELECT feature, fold, step + 1, b0 + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b1 + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1)
          FROM (SELECT feature, fold, step, b0, b1, avg(y - q) AS g0, avg((y - q) * x) AS g1, avg(q * (1 - q)) AS h0, avg(q * (1 - q) * x) AS h1, avg(q * (1 - q) * x * x) AS h2
                FROM (SELECT r.*, z.y, z.x, 1 / (1 + exp(-(b0 + b1 * z.x))) AS q FROM r JOIN z ON z.feature = r.feature AND z.own <> r.fold WHERE step < 12) GROUP BY feature, fold, step, b0, b1)),
    c AS (SELECT * FROM r WHERE step = 12)"""


@query(f"""WITH RECURSIVE {_PROBED}, s AS (SELECT z.feature, z.own AS fold, z.y, b0 + b1 * z.x AS score FROM z JOIN c ON c.feature = z.feature AND c.fold = z.own)
    SELECT c.feature, c.fold, round(b0, 6) AS intercept, round(b1, 6) AS slope, (SELECT count(*) FROM s WHERE s.feature = c.feature AND s.fold = c.fold AND y = 1) AS n_pos, (SELECT count(*) FROM s WHERE s.feature = c.feature AND s.fold = c.fold AND y = 0) AS n_neg,
           round((SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) FROM s a, s b WHERE a.feature = c.feature AND b.feature = c.feature AND a.fold = c.fold AND b.fold = c.fold AND a.y = 1 AND b.y = 0), 6) AS auroc FROM c""")
def metric_probes(spark, sf_dir):
    """How well each of three measures of a text tells good documents, alone."""
    share = lambda letters: F.length(F.regexp_replace("text", letters, "")) / F.greatest(F.length("text"), F.lit(1))
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("y")), "doc_id").select("doc_id", "y", F.log1p("n_chars").alias("size"), share("[^A-Z]").alias("upper"), share("[^ ]").alias("blank"))
    found = m.probes(d, "doc_id", ["size", "upper", "blank"], "y", 3)
    return found.select("feature", "fold", *[F.round(c, 6).alias(c) for c in ("intercept", "slope")], "n_pos", "n_neg", F.round("auroc", 6).alias("auroc"))


@query(f"""{JUDGED}, t AS (SELECT lang, pos, doc_id, score, length(source) * 100 + doc_id % 37 AS other FROM j),
    u AS (SELECT *, row_number() OVER (PARTITION BY lang, pos ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang, pos) AS n FROM t),
    d AS (SELECT lang, pos, b, CAST(floor({_DRAW.format("'0::' || b || '::' || i || '::' || lang || '::' || pos")} * n) AS BIGINT) AS i FROM u, unnest(range(1, 21)) AS x(b)),
    r AS (SELECT d.lang, d.b, u.pos, u.score, u.other FROM d JOIN u ON u.lang = d.lang AND u.pos = d.pos AND u.i = d.i),
    a AS (SELECT p.lang, p.b, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) - avg(CASE WHEN p.other > n.other THEN 1.0 WHEN p.other = n.other THEN 0.5 ELSE 0.0 END) AS delta FROM r p JOIN r n ON n.lang = p.lang AND n.b = p.b WHERE p.pos AND NOT n.pos GROUP BY 1, 2),
    o AS (SELECT p.lang, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) - avg(CASE WHEN p.other > n.other THEN 1.0 WHEN p.other = n.other THEN 0.5 ELSE 0.0 END) AS delta FROM t p JOIN t n ON n.lang = p.lang WHERE p.pos AND NOT n.pos GROUP BY 1)
    SELECT l.lang, round(any_value(o.delta), 6) AS delta, round(quantile_cont(a.delta, 0.025), 6) AS lo, round(quantile_cont(a.delta, 0.975), 6) AS hi FROM (SELECT DISTINCT lang FROM t) l LEFT JOIN o ON o.lang = l.lang LEFT JOIN a ON a.lang = l.lang GROUP BY l.lang""")
def metric_auroc_delta(spark, sf_dir):
    """Size of a text against another score of it, on the same resamples of good and other documents; null for one class."""
    t = judged(spark, sf_dir).select("lang", "pos", "doc_id", "score", (F.length("source") * 100 + F.col("doc_id") % 37).alias("other"))
    return m.auroc_delta(t, ["lang"], "doc_id", "score", "other", "pos", 20).select("lang", *[F.round(c, 6).alias(c) for c in ("delta", "lo", "hi")])


@query(f"""
    WITH t AS (SELECT l_suppkey AS unit, CAST(l_orderkey % 4 AS INTEGER) AS draw, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS num, CAST(count(*) AS DOUBLE) AS den FROM lineitem GROUP BY 1, 2),
    f AS (SELECT unit FROM t GROUP BY 1 HAVING count(*) = 4), s AS (SELECT unit FROM f), u AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS n FROM s),
    d AS (SELECT b, CAST(floor({_DRAW.format("'0::' || b || '::' || i")} * n) AS BIGINT) AS i FROM u, unnest(range(1, 51)) AS x(b)), c AS (SELECT b, unit, row_number() OVER (PARTITION BY b, unit) AS copy FROM d JOIN u USING (i)),
    p AS (SELECT b, unit, CAST(floor({_DRAW.format("'inner0::' || b || '::' || unit || '::' || copy")} * 4) AS INTEGER) AS draw FROM c), r AS (SELECT b, sum(num) / sum(den) AS r FROM p JOIN t ON t.unit = p.unit AND t.draw = p.draw GROUP BY b)
    SELECT (SELECT round(sum(num) / sum(den), 9) FROM t JOIN f USING (unit)) AS ratio, round(quantile_cont(r, 0.025), 9) AS lo, round(quantile_cont(r, 0.975), 9) AS hi FROM r""")
def metric_nested_bootstrap(spark, sf_dir):
    """Suppliers are resampled, and each takes one of its four scored draws."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), (F.col("l_orderkey") % 4).cast("int").alias("draw")).agg(F.count_if(F.col("l_returnflag") == "R").cast("double").alias("num"), F.count(F.lit(1)).cast("double").alias("den"))
    full = lines.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n = 4").select("unit")
    return m.nested_bootstrap(lines.join(full, "unit"), "unit", "draw", "num", "den", 4, 50).select(*[F.round(c, 9).alias(c) for c in ("ratio", "lo", "hi")])


@query("""
    WITH s AS (SELECT l_suppkey AS unit, CAST(l_linenumber % 3 AS INTEGER) AS draw, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS num, CAST(count(*) AS DOUBLE) AS den FROM lineitem GROUP BY 1, 2),
    u AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT unit FROM s)),
    d AS (SELECT b, CAST(floor(CAST(('0x' || substr(md5('0::' || b || '::' || i), 1, 8)) AS BIGINT) / 4294967296.0 * n) AS BIGINT) AS i FROM u, unnest(range(1, 201)) AS t(b)),
    t AS (SELECT b, unit, unnest(range(1, count(*) + 1)) AS copy FROM d JOIN u USING (i) GROUP BY 1, 2),
    e AS (SELECT b, unit, CAST(floor(CAST(('0x' || substr(md5('inner0::' || b || '::' || unit || '::' || copy), 1, 8)) AS BIGINT) / 4294967296.0 * 3) AS INTEGER) AS draw FROM t),
    r AS (SELECT b, sum(num) / sum(den) AS r FROM e JOIN s USING (unit, draw) GROUP BY b)
    SELECT (SELECT round(sum(num) / sum(den), 6) FROM s) AS ratio, round(quantile_cont(r, 0.025), 6) AS lo, round(quantile_cont(r, 0.975), 6) AS hi FROM r""")
def metric_nested_bootstrap(spark, sf_dir):
    """Share of returned lines, suppliers resampled and each one's lines taken from one of three parts."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), (F.col("l_linenumber") % 3).alias("draw")).agg(F.count_if(F.col("l_returnflag") == "R").cast("double").alias("num"), F.count(F.lit(1)).cast("double").alias("den"))
    return m.nested_bootstrap(rows, "unit", "draw", "num", "den", 3).select(*[F.round(c, 6).alias(c) for c in ("ratio", "lo", "hi")])


@query("""
    WITH s AS (SELECT o_orderpriority AS g, o_orderstatus = 'F' AS pos, o_orderkey AS unit, floor(o_totalprice / 1000) AS x, CAST(o_custkey % 100 AS DOUBLE) AS y FROM orders),
    u AS (SELECT *, row_number() OVER (PARTITION BY g, pos ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY g, pos) AS n FROM s),
    d AS (SELECT b, g, pos, CAST(floor(CAST(('0x' || substr(md5('0::' || b || '::' || i || '::' || g || '::' || CAST(pos AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 * n) AS BIGINT) AS i FROM u, unnest(range(1, 41)) AS t(b)),
    w AS (SELECT 0 AS b, g, pos, x, y FROM s UNION ALL SELECT b, g, pos, x, y FROM d JOIN u USING (g, pos, i)),
    c AS (SELECT b, g, 'x' AS c, x AS v, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM w GROUP BY ALL UNION ALL SELECT b, g, 'y', y, count(*) FILTER (pos), count(*) FILTER (NOT pos) FROM w GROUP BY ALL),
    l AS (SELECT *, sum(n) OVER (PARTITION BY b, g, c ORDER BY v) - n AS below FROM c),
    a AS (SELECT b, g, c, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS a FROM l GROUP BY 1, 2, 3),
    f AS (SELECT b, g, max(a) FILTER (c = 'x') - max(a) FILTER (c = 'y') AS delta FROM a GROUP BY 1, 2)
    SELECT g AS o_orderpriority, round(max(delta) FILTER (b = 0), 6) AS delta, round(quantile_cont(delta, 0.025) FILTER (b > 0), 6) AS lo, round(quantile_cont(delta, 0.975) FILTER (b > 0), 6) AS hi FROM f GROUP BY g""")
def metric_auroc_delta(spark, sf_dir):
    """How much better an order's price tells its status than its customer's number, by priority, both on the same draws."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("x"), (F.col("o_custkey") % 100).cast("double").alias("y"), (F.col("o_orderstatus") == "F").alias("pos"))
    return m.auroc_delta(rows, ["o_orderpriority"], "o_orderkey", "x", "y", "pos", 40).select("o_orderpriority", *[F.round(c, 6).alias(c) for c in ("delta", "lo", "hi")])
