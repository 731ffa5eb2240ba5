"""Queries of joins, set operations and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions.seq import hash_uniform
from siftline.operators import joins, topk
from siftline.registry import query, table

U = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) / 4294967296.0"


@query("""
    WITH f AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, coalesce(n, 0) AS n_matches, CASE WHEN n = 1 THEN s END AS l_suppkey
    FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def join_resolve_unique(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return joins.resolve_unique(table(spark, sf_dir, "orders").select("o_orderkey"), lines, ["o_orderkey"], ["l_suppkey"])


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'fail:order' WHEN c_custkey IS NULL THEN 'fail:customer' WHEN n_nationkey IS NULL THEN 'fail:nation' WHEN r_regionkey IS NULL THEN 'fail:region' ELSE 'ok' END AS failure
    FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey
    LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) n ON n_nationkey = c_nationkey LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') r ON r_regionkey = n_regionkey""")
def join_audit_chain(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    hops = [
        ("order", t("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust")), ["l_orderkey"]),
        ("customer", t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation")), ["cust"]),
        ("nation", t("nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")), ["nation"]),
        ("region", t("region").where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("region")), ["region"]),
    ]
    return joins.audit_chain(t("lineitem").select("l_orderkey", "l_linenumber"), hops).select("l_orderkey", "l_linenumber", "failure")


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_held FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def join_division(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    return joins.having_all(lines, "l_orderkey", "l_returnflag", lines)


@query("""
    WITH i AS (SELECT event_id, user_id, value AS lo, value + 4 AS hi FROM events)
    SELECT a.event_id AS l_event_id, b.event_id AS r_event_id, round(least(a.hi, b.hi) - greatest(a.lo, b.lo), 6) AS overlap
    FROM i a JOIN i b ON a.user_id = b.user_id AND a.event_id < b.event_id WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 1""")
def join_overlap(spark, sf_dir):
    i = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("lo"), (F.col("value") + 4).alias("hi"))
    return joins.overlap_join(i, i, ["user_id"], 1.0, 8.0).where("l_event_id < r_event_id").select("l_event_id", "r_event_id", F.round("overlap", 6).alias("overlap"))


@query("""
    WITH q AS (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT o_orderpriority, o_totalprice, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
    SELECT q.o_orderkey, coalesce((SELECT min_by(k, r.o_totalprice) FROM r WHERE r.o_orderpriority = q.o_orderpriority AND r.o_totalprice >= q.o_totalprice), (SELECT max_by(k, r.o_totalprice) FROM r WHERE r.o_orderpriority = q.o_orderpriority)) AS k
    FROM q""")
def join_next_above(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    left = o.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority", "o_totalprice")
    right = o.where("o_orderstatus = 'F'").select("o_orderpriority", "o_totalprice", F.col("o_orderkey").alias("k"))
    return joins.next_above(left, right, ["o_orderpriority"], "o_totalprice", ["k"]).select("o_orderkey", "k")


@query("""
    SELECT user_id, arg_max(event_id, event_id) FILTER (event_type = 'signup') AS signup, arg_max(event_id, event_id) FILTER (event_type = 'purchase') AS purchase
    FROM events GROUP BY user_id HAVING signup IS NOT NULL AND purchase IS NOT NULL""")
def join_pivot_pair(spark, sf_dir):
    return joins.pivot_pair(table(spark, sf_dir, "events"), ["user_id"], "event_type", ("signup", "purchase"), "event_id", F.col("event_id"))


@query("""SELECT a.n_regionkey, a.n_nationkey AS n_nationkey_a, b.n_nationkey AS n_nationkey_b, length(a.n_name) = length(b.n_name) AS same_length
    FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def join_pairs_within(spark, sf_dir):
    pairs = joins.pairs_within(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", ["n_name"], 1000)
    return pairs.select("n_regionkey", "n_nationkey_a", "n_nationkey_b", (F.length("n_name_a") == F.length("n_name_b")).alias("same_length"))


@query("""
    WITH s AS (SELECT 'c' || c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT 'c' || c_custkey || '_neg', -c_acctbal / 2 FROM customer WHERE c_custkey > 10)
    SELECT a.k, round(a.v, 6) AS positive, round(b.v, 6) AS negative, round(a.v - b.v, 6) AS delta FROM s a JOIN s b ON b.k = a.k || '_neg'""")
def join_suffix_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = c.select(F.concat(F.lit("c"), "c_custkey").alias("k"), F.col("c_acctbal").alias("v")).union(c.where("c_custkey > 10").select(F.concat(F.lit("c"), "c_custkey", F.lit("_neg")), -F.col("c_acctbal") / 2))
    return joins.suffix_pairs(s, "k", "v", "_neg").select("k", *[F.round(x, 6).alias(x) for x in ("positive", "negative", "delta")])


@query("""
    SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'SCORED_PASS' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'SCORED_FAIL' ELSE 'UNSCORED' END AS status FROM customer""")
def join_outer_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.outer_status(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"))


@query("""
    WITH a AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id AS hit, user_id, value AS v FROM events WHERE event_type = 'signup'),
    m AS (SELECT a.event_id, b.hit, row_number() OVER (PARTITION BY a.event_id ORDER BY round(abs(a.value - b.v), 6), b.hit) AS n FROM a JOIN b ON a.user_id = b.user_id AND abs(a.value - b.v) <= 10)
    SELECT event_id, hit FROM m WHERE n = 1""")
def join_nearest_in_range(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = e.where("event_type = 'purchase'").select("event_id", "user_id", "value"), e.where("event_type = 'signup'").select(F.col("event_id").alias("hit"), "user_id", "value")
    order = [F.round(F.abs(F.col("value") - F.col("match_value")), 6), F.col("hit")]
    return joins.nearest_in_range(a, b, ["user_id"], "value", 10.0, order, ["hit"]).select("event_id", "hit")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 150000)")
def join_anti(spark, sf_dir):
    """Customers without a large finished order."""
    large = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 150000")
    return table(spark, sf_dir, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount >= 0.05)")
def join_semi(spark, sf_dir):
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "lineitem").where("l_discount >= 0.05"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey", "s_name")


@query("""
    SELECT 'both' AS part, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
    SELECT 'customers', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, name: df.select(F.lit(name).alias("part"), "k")
    return tag(c.intersect(s), "both").unionByName(tag(c.subtract(s), "customers")).unionByName(tag(c.union(s).distinct(), "any"))


@query("""
    SELECT o_orderkey, coalesce(r_name, '') AS region, coalesce(n_name, '') AS nation, coalesce(c_mktsegment, '') AS segment
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 1000) ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def join_enrichment(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    j = t("orders").join(t("customer").where("c_acctbal > 1000"), F.col("c_custkey") == F.col("o_custkey"), "left").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return j.select("o_orderkey", F.coalesce("r_name", F.lit("")).alias("region"), F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce("c_mktsegment", F.lit("")).alias("segment"))


@query("""
    SELECT p_brand, round(quantile_cont(l_extendedprice, 0.5) FILTER (l_returnflag = 'A'), 6) AS a, round(quantile_cont(l_extendedprice, 0.5) FILTER (l_returnflag = 'N'), 6) AS n, round(quantile_cont(l_extendedprice, 0.5) FILTER (l_returnflag = 'R'), 6) AS r
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand""")
def join_swap_matrix(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy("p_brand").pivot("l_returnflag", ["A", "N", "R"]).agg(F.percentile("l_extendedprice", F.lit(0.5))).select("p_brand", *[F.round(c, 6).alias(c.lower()) for c in "ANR"])


@query("""
    WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS rank FROM lineitem)
    SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_extendedprice, rank FROM r WHERE rank <= 4""")
def topk_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice")
    return topk.top_k(rows, ["l_returnflag", "l_linestatus"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 4)


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def topk_first_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return rows.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.*")


@query("""
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM b WHERE n = 1""")
def topk_best_row(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return topk.best_row(rows, ["o_custkey"], F.struct("o_totalprice", -F.col("o_orderkey")))


@query(f"""
    WITH s AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {U.format("'7::' || c_custkey")}, c_custkey) AS n FROM customer) SELECT c_mktsegment, c_custkey FROM s WHERE n <= 8""")
def sample_per_group(spark, sf_dir):
    return topk.sample_rows(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], "c_custkey", 8, 7)


@query(f"""
    WITH g AS (SELECT DISTINCT l_suppkey FROM lineitem), k AS (SELECT l_suppkey FROM g ORDER BY {U.format("'3::' || l_suppkey")}, l_suppkey LIMIT 5)
    SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM k) GROUP BY 1""")
def sample_whole_groups(spark, sf_dir):
    return topk.sample_groups(table(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey", 5, 3).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH f AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1 ORDER BY 2, 1 LIMIT 40) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM f)""")
def topk_first_groups(spark, sf_dir):
    return topk.first_groups(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 40)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) = 5")
def topk_exactly(spark, sf_dir):
    return topk.exactly(table(spark, sf_dir, "lineitem").select("l_orderkey"), ["l_orderkey"], 5).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH t AS (SELECT l_partkey, list(l_extendedprice ORDER BY l_extendedprice DESC) AS x FROM lineitem GROUP BY 1)
    SELECT l_partkey, x[1] AS best, coalesce(x[2], 0.0) AS second, coalesce(x[5], 0.0) AS fifth FROM t""")
def topk_flat(spark, sf_dir):
    t = topk.flat_top(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", 5)
    return t.select("l_partkey", "best", F.get("top", F.lit(1)).alias("second"), F.get("top", F.lit(4)).alias("fifth"))


@query(f"""
    WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {U.format("'0::' || c_custkey")}, c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
    s AS (SELECT *, round_even(n * 0.7, 0) AS a, round_even(n * 0.15, 0) AS b FROM r) SELECT c_custkey, CASE WHEN i <= a THEN 'train' WHEN i <= a + b THEN 'val' ELSE 'test' END AS split FROM s""")
def split_stratified(spark, sf_dir):
    return topk.stratified_split(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment").select("c_custkey", "split")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS content, count(*) AS n FROM documents GROUP BY md5(text)")
def dedup_by_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("content")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH o AS (SELECT event_id, event_type, {U.format("'5::' || event_id")} AS u FROM events)
    SELECT event_id, coalesce(lead(event_id) OVER w, first_value(event_id) OVER w) AS shuffled_event_id FROM o WINDOW w AS (PARTITION BY event_type ORDER BY u, event_id)""")
def null_derangement(spark, sf_dir):
    from siftline.operators.nulls import rotated

    return rotated(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], "event_id", "event_id", 5).select("event_id", "shuffled_event_id")


@query(f"""
    WITH u AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS m, {U.format("'0::' || l_orderkey || '-' || l_linenumber")} AS u FROM lineitem)
    SELECT m - CASE WHEN u < 0.86 THEN 0 WHEN u < 0.96 THEN 1 ELSE 2 END AS drawn, count(*) AS n FROM u GROUP BY 1""")
def null_mixture(spark, sf_dir):
    from siftline.operators.nulls import mixture

    m = mixture(F.concat_ws("-", "l_orderkey", "l_linenumber"), F.col("l_quantity").cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy(m.alias("drawn")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH w AS (SELECT n_regionkey AS g, n_nationkey AS k, s FROM nation, unnest(range(1, 4)) AS t(s)),
    r AS (SELECT *, row_number() OVER (PARTITION BY g, s ORDER BY {U.format("'row0::' || g || '::' || s || '::' || k")}, k) AS i, 2 + floor({U.format("'size0::' || g || '::' || s")} * 3) AS size FROM w)
    SELECT g, CAST(s AS INTEGER) AS "set", k FROM r WHERE i <= size""")
def null_subsets(spark, sf_dir):
    from siftline.operators.nulls import subsets

    return subsets(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("k")), "g", "k", 3, 2, 4)


@query(f"""
    WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {U.format("'1::' || c_custkey")}, c_custkey) - 1 AS i FROM customer) SELECT c_custkey, CAST(floor(i / 4.0) AS BIGINT) AS batch FROM r""")
def null_batches(spark, sf_dir):
    from siftline.operators.nulls import batches

    return batches(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 4, 1).select("c_custkey", "batch")


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders), n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
    d AS (SELECT o_custkey, coalesce(lead(o_custkey) OVER (ORDER BY o_custkey), min(o_custkey) OVER ()) AS donor FROM n)
    SELECT r.o_orderkey, x.o_orderkey AS donor_o_orderkey FROM r JOIN d ON d.o_custkey = r.o_custkey JOIN n ON n.o_custkey = d.donor JOIN r x ON x.o_custkey = d.donor AND x.i = r.i % n.n""")
def null_donors(spark, sf_dir):
    from siftline.operators.nulls import donor_join, next_bags

    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return donor_join(o, "o_custkey", "o_orderkey", "o_orderkey", next_bags(o, "o_custkey")).select("o_orderkey", "donor_o_orderkey")


@query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS condition FROM customer WHERE 1 = 0 UNION ALL SELECT c_custkey, condition FROM customer, unnest(['real', 'pairs', 'words', 'donor', 'reverse']) AS t(condition)")
def null_conditions(spark, sf_dir):
    from siftline.operators.nulls import conditions

    return conditions(table(spark, sf_dir, "customer").select("c_custkey"), ["real", "pairs", "words", "donor", "reverse"])


@query("SELECT item_id, true AS same_pairs, true AS same_ends FROM benchmark")
def null_exact_shuffle(spark, sf_dir):
    """Shuffles keep ends and the counts of adjacent pairs."""
    from siftline.functions.seq import kmers
    from siftline.operators.nulls import shuffled

    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    s = shuffled(b, ["item_id"], "text", 11).withColumnRenamed("text", "made").join(b, "item_id")
    ends = (F.substring("made", 1, 1) == F.substring("text", 1, 1)) & (F.substring("made", -1, 1) == F.substring("text", -1, 1))
    return s.select("item_id", (F.array_sort(kmers("made", 2)) == F.array_sort(kmers("text", 2))).alias("same_pairs"), ends.alias("same_ends"))


@query(f"SELECT event_id, {U.format("'0::' || event_id")} < 0.1 OR value >= 100 AS kept FROM events")
def filter_stochastic_tail(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ((hash_uniform("event_id", salt="0") < 0.1) | (F.col("value") >= 100)).alias("kept"))
