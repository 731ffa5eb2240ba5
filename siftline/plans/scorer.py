"""Whole analyses: sites to ranked clusters (scorer), sites to peaks and detection metrics (detector),
and the calibration of a score against null conditions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from siftline.functions import seq
from siftline.operators import bagwise, joins, linkage, match, metrics, nulls, positions, windows
from siftline.plans.metrics import intervals_sql
from siftline.registry import query, table
from siftline.session import cut, dealt, large, ship


@dataclass(frozen=True)
class Spec:
    """What a run fixes: data, not code, so that it can be a row of a parameter table."""

    name: str = "default"
    lengths: tuple[int, ...] = (11,)
    least: int = 8
    s_threshold: int = 3
    tau: float = 0.0
    pool_orients: bool = False
    distance: int = 5
    offset: float = 5.0
    min_frac: float = 0.5
    least_nc: int = 20
    least_flank: int = 20
    margin: int = 5
    identity: float = 0.85
    least_groups: int = 3
    jaccard: float = 0.8
    nc_offset: int = 5


def hits_of(sites: DataFrame, spec: Spec) -> DataFrame:
    """bag_id, site_ord, k_valid, orient, L, i, f, m and both windows, of adequate sites (bag_id,
    site_ord, nc, flank), after the motif gate."""
    ok = match.adequacy(sites, "bag_id", "nc", "flank", spec.least_nc, spec.least_flank).where("drop_reason is null")
    hits = match.window_matches(ok, ["bag_id", "site_ord", "k_valid", "nc", "flank"], "nc", "flank", list(spec.lengths), lambda n: max(match.retention_floor(n), spec.least))
    target = seq.slice_at("flank", F.col("f"), F.col("L"))
    hits = hits.withColumns({"guide": seq.slice_at("nc", F.col("i"), F.col("L")), "target": F.when(F.col("orient") == "rc", seq.revcomp(target)).otherwise(target)})
    return match.gate(hits, "guide", "target")[0].drop("nc")


def score_clusters(sites: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Clusters of flank positions that recur across the sites of a bag at one nc window, with the
    number of distinct backgrounds behind them, ranked three ways. Bags that fit a task are worked out
    there, many at once (``bagwise``); larger ones, and sites of other types, with joins."""
    kinds = dict(sites.dtypes)
    if (kinds["bag_id"], kinds["site_ord"]) != ("string", "int"):
        return joined_clusters(sites, spec)
    ship(sites.sparkSession)
    rules = bagwise.Rules(spec.offset, spec.min_frac, spec.margin, spec.identity, spec.least_groups, spec.jaccard, spec.nc_offset)
    hits = hits_of(sites, spec).select("bag_id", "site_ord", F.col("k_valid").alias("valid"), (F.col("orient") == "rc").cast("int").alias("orient"), "L", "i", "f", "m", F.lit(None).cast("string").alias("flank"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in hits.dtypes[2:-1]]
    rows = dealt(hits.unionByName(sites.select("bag_id", "site_ord", *none, "flank")).where("bag_id is not null"), "bag_id").sortWithinPartitions("bag_id")
    found = cut(rows.mapInArrow(lambda batches: bagwise.scored(batches, rules), bagwise.SCHEMA), "scored")
    beyond = found.where("id is null").select("bag_id")
    found = found.where("id is not null")
    return found if beyond.isEmpty() else found.unionByName(joined_clusters(sites.join(large(beyond), "bag_id", "left_semi"), spec))


def joined_clusters(sites: DataFrame, spec: Spec) -> DataFrame:
    """:func:`score_clusters` of bags of any size."""
    hits = hits_of(sites, spec)
    wide = hits.withColumn("key", F.concat_ws("|", "orient", "L", "i"))
    part = lambda k: F.element_at(F.split("key", r"\|"), k)
    clusters = positions.position_clusters(wide.select("bag_id", "key", "site_ord", "f", "m", "k_valid"), ["bag_id", "key"], "site_ord", "f", "m", "k_valid", spec.offset, spec.min_frac)
    clusters = cut(clusters.withColumns({"orient": part(1), "L": part(2).cast("int"), "i": part(3).cast("int")}).withColumn("mean_frac", F.col("mean_m") / F.col("L")), "clusters")
    members = clusters.select("bag_id", "key", "cluster_id", "median", F.explode("sites").alias("site_ord")).join(large(sites.select("bag_id", F.col("site_ord").cast("long").alias("site_ord"), "flank")), ["bag_id", "site_ord"])
    members = large(cut(members, "members"))
    pairs = joins.pairs_within(members, ["bag_id", "key", "cluster_id"], "site_ord", ["flank", "median"])
    length = part(2).cast("int")
    bounds = lambda side: seq.masked_bounds(F.length(f"flank_{side}"), F.floor("median_a").cast("int"), length, spec.margin)
    same = F.greatest(*[seq.trimmed_identity(c["a"], c["b"]) for c in (seq.side_chunks("flank_a", bounds("a"), "flank_b", bounds("b"), s) for s in ("left", "right"))]) > spec.identity
    cluster = ["bag_id", "key", "cluster_id"]
    linked = cut(pairs.where(same).select(*cluster, "site_ord_a", "site_ord_b"), "linked")  # compared once, not in every round
    counted = linkage.gated(linkage.group_counts(clusters, "sites", linked, cluster, "site_ord_a", "site_ord_b"), spec.least_groups)
    rows = cut(counted.withColumn("id", F.concat_ws("#", "key", "cluster_id")), "counted")
    # one motif seen at other lengths or a few letters on: the same strand, near places on both sides, nearly the same sites
    near = {"i": spec.nc_offset, "median": spec.offset}
    merged = positions.greedy_merge(rows, ["bag_id", "orient"], "id", [("mean_frac", False), ("L", False), ("mad", True)], near, "sites", spec.jaccard).drop("orient")
    orders = {"rank_support": [F.desc("n_support"), F.asc("mad")], "rank_groups": [F.desc("n_groups"), F.desc("n_support")], "rank_spread": [F.asc("mad"), F.desc("n_support")]}
    return windows.three_ranks(rows.join(large(merged), ["bag_id", "id"]), ["bag_id"], orders, "id", F.col("passes"))


def detect_peaks(sites: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """bag_id, orient, L, p, s: positions of the nc region at which windows match in at least
    s_threshold sites, local maxima only."""
    return peaks_of(hits_of(sites, spec), spec)


def peaks_of(hits: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """:func:`detect_peaks` of hits that are there already."""
    hits = hits.withColumnRenamed("i", "p")
    by = ["bag_id", "L", *([] if spec.pool_orients else ["orient"])]
    counts = windows.kernel_count(hits, by, "site_ord", "p", spec.tau)
    if spec.pool_orients:
        counts = counts.withColumn("orient", F.lit("both"))
    return windows.peaks(counts, ["bag_id", "L", "orient"], "p", "s", spec.distance, spec.s_threshold)


def detection_metrics(peaks: DataFrame, truth: DataFrame, within: int = 5) -> DataFrame:
    """Coverage (bags with a peak), share of correct peaks, of correct bags among those with peaks, and
    of bags whose primary peak (the mean place of the highest) is exact. truth: bag_id, planted, stratum."""
    top = F.max("s").over(Window.partitionBy("bag_id"))
    j = peaks.withColumn("top", F.col("s") == top).join(truth, "bag_id", "right")
    near = F.abs(F.col("p") - F.col("planted")) <= within
    bags = j.groupBy("bag_id", "stratum", "planted").agg(F.count("p").alias("n"), F.count_if(near).alias("right"), F.avg(F.when(F.col("top"), F.col("p"))).alias("primary"))
    rate = lambda test: F.avg(test.cast("double"))
    return bags.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_bags"), rate(F.col("n") > 0).alias("coverage"), F.try_divide(F.sum("right"), F.sum("n")).alias("ppv_peak"),
        F.avg(F.when(F.col("n") > 0, (F.col("right") > 0).cast("double"))).alias("ppv_bag"), rate(F.coalesce(F.col("primary") == F.col("planted"), F.lit(False))).alias("exact"),
    )


def survival(peaks: DataFrame, hits: DataFrame, bags: DataFrame) -> DataFrame:
    """layer, n_bags, rate: how many bags have a hit (L1), hits in two sites (L2), a position shared
    by two sites (L4), and a peak (L5)."""
    shared = hits.groupBy("bag_id", "orient", "L", "i").agg(F.countDistinct("site_ord").alias("n"))
    layers = {
        "L1": hits.select("bag_id"), "L2": hits.groupBy("bag_id").agg(F.countDistinct("site_ord").alias("n")).where("n >= 2"),
        "L4": shared.where("n >= 2"), "L5": peaks,
    }
    total = bags.select("bag_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    out = None
    for name, df in layers.items():
        n = df.select("bag_id").distinct().agg(F.count(F.lit(1)).alias("n_bags")).withColumn("layer", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out.crossJoin(F.broadcast(total)).select("layer", "n_bags", (F.col("n_bags") / F.col("total")).alias("rate"))


def null_calibration(sites: DataFrame, spec: Spec, target: float = 0.05, seed: int = 0) -> DataFrame:
    """The support threshold that at most ``target`` of each null condition's bags exceed: every
    condition goes through the same plan as one more part of the key."""
    flank = lambda df, name: df.withColumn("bag_id", F.concat("bag_id", F.lit(f"@{name}")))
    pairs = nulls.shuffled(sites, ["bag_id", "site_ord"], "flank", seed)
    walks = nulls.shuffled(sites, ["bag_id", "site_ord"], "flank", seed + 1, 4)
    turned = nulls.shuffled(sites.withColumn("flank", seq.revcomp("flank")), ["bag_id", "site_ord"], "flank", seed + 2)
    every = flank(pairs, "pairs").unionByName(flank(walks, "words")).unionByName(flank(turned, "reverse"))
    best = score_peaks(every, spec)
    return metrics.threshold_for(best.withColumn("condition", F.element_at(F.split("bag_id", "@"), 2)), "condition", "bag_id", "s", target)


def score_peaks(sites: DataFrame, spec: Spec) -> DataFrame:
    """bag_id, s: the highest count of each bag, 0 without any."""
    counts = windows.kernel_count(hits_of(sites, spec).withColumnRenamed("i", "p"), ["bag_id", "L", "orient"], "site_ord", "p", spec.tau)
    return sites.select("bag_id").distinct().join(counts.groupBy("bag_id").agg(F.max("s").alias("s")), "bag_id", "left").select("bag_id", F.coalesce("s", F.lit(0.0)).alias("s"))


def item_sites(spark, sf_dir) -> DataFrame:
    """Reference items as bags: an item's letters ACGT are the nc region, those of the items around it
    (by number) the flanks of its sites."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s"))
    near = b.select(F.explode(F.sequence(F.col("item_id") + 1, F.col("item_id") + 4)).alias("item_id"), F.col("item_id").alias("other"), F.col("s").alias("flank"))
    return b.join(near, "item_id").select(F.col("item_id").cast("string").alias("bag_id"), (F.col("item_id") - F.col("other")).cast("int").alias("site_ord"), F.col("s").alias("nc"), "flank")


ITEM_SPEC = Spec(lengths=(9,), least=7, s_threshold=2)
PLACES = ["bag_id", "site_ord", "orient", "L", "i"]  # what counts of hits need of them


@query()
def scorer_clusters(spark, sf_dir):
    out = score_clusters(item_sites(spark, sf_dir), ITEM_SPEC)
    return out.select("bag_id", "id", "median", "mad", "n_support", "n_groups", "passes", "anchor", "rank_support", "rank_groups", "rank_spread")


@query()
def detector_peaks(spark, sf_dir):
    return detect_peaks(item_sites(spark, sf_dir), ITEM_SPEC)


@query()
def detector_metrics(spark, sf_dir):
    sites = item_sites(spark, sf_dir)
    truth = sites.groupBy("bag_id").agg(F.min(F.floor(F.length("nc") / 2)).alias("planted"), F.min(F.when(F.length("nc") > 60, "long").otherwise("short")).alias("stratum"))
    return detection_metrics(detect_peaks(sites, ITEM_SPEC), truth)


@query()
def detector_survival(spark, sf_dir):
    sites = item_sites(spark, sf_dir)
    hits = cut(hits_of(sites, ITEM_SPEC).select(*PLACES), "hits")
    return survival(peaks_of(hits, ITEM_SPEC), hits, sites)


@query()
def calibration_threshold(spark, sf_dir):
    return null_calibration(item_sites(spark, sf_dir), ITEM_SPEC)


_HEX = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
#: Bags of four sites whose letters are md5 digests; each site holds nc[10, 24) at a place of its own.
BAGS = f"""
    b AS (SELECT p_partkey AS k, CAST(floor(p_partkey / 4) AS BIGINT) AS bag, CAST(p_partkey % 4 AS INTEGER) AS site, CAST(p_partkey * 7 % 30 AS BIGINT) AS off,
                 substr(translate(md5('n' || CAST(floor(p_partkey / 4) AS BIGINT)) || md5('m' || CAST(floor(p_partkey / 4) AS BIGINT)), {_HEX}), 1, 48) AS nc, translate(md5('f' || p_partkey) || md5('g' || p_partkey), {_HEX}) AS f0 FROM part),
    s AS (SELECT bag, site, nc, substr(f0, 1, off) || substr(nc, 11, 14) || substr(f0, off + 15) AS flank FROM b),
    o AS (SELECT bag, site, nc, 'fwd' AS orient, flank AS y FROM s UNION ALL SELECT bag, site, nc, 'rc', reverse(translate(flank, 'ACGT', 'TGCA')) FROM s),
    w AS (SELECT bag, site, orient, CAST(i AS INTEGER) AS i, substr(nc, i + 1, 11) AS guide, substr(y, j + 1, 11) AS target, list_sum(list_transform(range(1, 12), lambda n: CASE WHEN substr(nc, i + n, 1) = substr(y, j + n, 1) THEN 1 ELSE 0 END)) AS m FROM o, unnest(range(0, 38)) AS t(i), unnest(range(0, 54)) AS u(j)),
    h AS (SELECT * FROM w WHERE m >= 8),
    d AS (SELECT DISTINCT guide AS x FROM h UNION SELECT DISTINCT target FROM h),
    c AS (SELECT x, i, substr(x, CAST(i AS BIGINT), 1) AS ch, i - row_number() OVER (PARTITION BY x, substr(x, CAST(i AS BIGINT), 1) ORDER BY i) AS g FROM d, unnest(range(1, 12)) AS t(i)),
    r AS (SELECT x, max(n) AS run FROM (SELECT x, ch, g, count(*) AS n FROM c GROUP BY 1, 2, 3) GROUP BY 1),
    e AS (SELECT x, sum(n) FILTER (ch IN ('A', 'T')) / 11.0 AS weak, -sum(n / 11.0 * log2(n / 11.0)) AS h FROM (SELECT x, ch, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
    q AS (SELECT x, list_max(list_transform([1, 2, 3, 4], lambda p: list_sum(list_transform(range(1, 12 - p), lambda i: CASE WHEN substr(x, i, 1) = substr(x, i + p, 1) THEN 1 ELSE 0 END)) / (11.0 - p))) AS p FROM d),
    good AS (SELECT x FROM r JOIN e USING (x) JOIN q USING (x) WHERE run < 6 AND p < 0.8 AND coalesce(weak, 0) < 0.85 AND h >= 1.2),
    hits AS (SELECT h.* FROM h JOIN good a ON a.x = h.guide JOIN good b ON b.x = h.target),
    k AS (SELECT bag, orient, i AS p, count(DISTINCT site) AS s FROM hits GROUP BY 1, 2, 3),
    peaks AS (SELECT * FROM (SELECT *, max(s) OVER (PARTITION BY bag, orient ORDER BY p RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS top FROM k) WHERE s = top AND s >= 3)"""
BAG_SPEC = Spec()


def digest_bags(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    bag, at = F.floor(k / 4), (k * 7 % 30).cast("int")
    letters = lambda a, b, c: F.translate(F.concat(F.md5(F.concat(F.lit(a), c.cast("string"))), F.md5(F.concat(F.lit(b), c.cast("string")))), "0123456789abcdef", "ACGTACGTACGTACGT")
    b = dealt(table(spark, sf_dir, "part").select(k, bag.cast("string").alias("bag_id")), "bag_id").select("bag_id", (k % 4).cast("int").alias("site_ord"), at.alias("at"), F.substring(letters("n", "m", bag), 1, 48).alias("nc"), letters("f", "g", k).alias("f0"))
    return b.select("bag_id", "site_ord", "nc", F.concat(F.substring(F.col("f0"), F.lit(1), F.col("at")), F.substring("nc", 11, 14), F.substring(F.col("f0"), F.col("at") + 15, F.lit(64))).alias("flank"))


@query(f"WITH {BAGS} SELECT CAST(bag AS VARCHAR) AS bag_id, orient, p, CAST(s AS DOUBLE) AS s FROM peaks")
def detector_bag_peaks(spark, sf_dir):
    """Peaks of bags that are known to hold a shared stretch."""
    return detect_peaks(digest_bags(spark, sf_dir), BAG_SPEC).select("bag_id", "orient", "p", F.col("s").cast("double").alias("s"))


@query(f"""WITH {BAGS}, t AS (SELECT DISTINCT bag, bag % 3 AS stratum FROM s),
    j AS (SELECT t.bag, t.stratum, p.p, p.s, p.s = max(p.s) OVER (PARTITION BY t.bag) AS best FROM t LEFT JOIN peaks p ON p.bag = t.bag),
    g AS (SELECT bag, stratum, count(p) AS n, count(*) FILTER (abs(p - 11) <= 5) AS right_, avg(p) FILTER (best) AS main FROM j GROUP BY 1, 2)
    SELECT stratum, count(*) AS n_bags, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 9) AS coverage, round(sum(right_) / sum(n), 9) AS ppv_peak, round(avg(CASE WHEN n > 0 THEN CASE WHEN right_ > 0 THEN 1.0 ELSE 0.0 END END), 9) AS ppv_bag,
           round(avg(CASE WHEN main = 11 THEN 1.0 ELSE 0.0 END), 9) AS exact FROM g GROUP BY 1""")
def detector_bag_metrics(spark, sf_dir):
    sites = digest_bags(spark, sf_dir)
    truth = sites.select("bag_id").distinct().select("bag_id", F.lit(11).alias("planted"), (F.col("bag_id").cast("long") % 3).alias("stratum"))
    out = detection_metrics(detect_peaks(sites, BAG_SPEC), truth)
    return out.select("stratum", "n_bags", *[F.round(c, 9).alias(c) for c in ("coverage", "ppv_peak", "ppv_bag", "exact")])


@query(f"""WITH {BAGS}, n AS (SELECT count(DISTINCT bag) AS n FROM s), l1 AS (SELECT count(DISTINCT bag) AS c FROM hits), l2 AS (SELECT count(*) AS c FROM (SELECT bag FROM hits GROUP BY 1 HAVING count(DISTINCT site) >= 2)),
    l4 AS (SELECT count(DISTINCT bag) AS c FROM k WHERE s >= 2), l5 AS (SELECT count(DISTINCT bag) AS c FROM peaks)
    SELECT layer, c AS n_bags, round(c / n, 9) AS rate FROM (SELECT 'L1' AS layer, c FROM l1 UNION ALL SELECT 'L2', c FROM l2 UNION ALL SELECT 'L4', c FROM l4 UNION ALL SELECT 'L5', c FROM l5), n""")
def detector_bag_survival(spark, sf_dir):
    sites = digest_bags(spark, sf_dir)
    hits = cut(hits_of(sites, BAG_SPEC).select(*PLACES), "hits")
    return survival(peaks_of(hits, BAG_SPEC), hits, sites).withColumn("rate", F.round("rate", 9))


_UNITS = """
    u AS (SELECT x.bag, x.bag % 3 AS family, max(y.s) IS NOT NULL AS admission, coalesce(max(y.s), 0) >= 3 AS aggregate, max(z.s) IS NOT NULL AS peaks FROM (SELECT DISTINCT bag FROM s) x LEFT JOIN k y ON y.bag = x.bag LEFT JOIN peaks z ON z.bag = x.bag GROUP BY 1)"""


@query(f"""WITH RECURSIVE {BAGS}, {_UNITS}, l AS (SELECT family, layer, count(*) AS n, count(*) FILTER (passed) AS passed FROM (UNPIVOT u ON admission, aggregate, peaks INTO NAME layer VALUE passed) GROUP BY 1, 2), {intervals_sql("ci", "passed", "n", "l")}
    SELECT family, layer, l.n, passed, round(passed / l.n, 9) AS rate, round(lo, 9) AS lo, round(hi, 9) AS hi FROM l JOIN ci ON ci.k = l.passed AND ci.n = l.n""")
def metric_fp_profile(spark, sf_dir):
    """How many bags of each of three families get through admission, aggregation and peak detection."""
    sites = digest_bags(spark, sf_dir)
    hits = cut(hits_of(sites, BAG_SPEC).select(*PLACES), "hits")
    counts = hits.groupBy("bag_id", "orient", "i").agg(F.countDistinct("site_ord").alias("s")).groupBy("bag_id").agg(F.max("s").alias("s"))
    peaks = peaks_of(hits, BAG_SPEC).select("bag_id").distinct().withColumn("peaks", F.lit(True))
    units = sites.select("bag_id").distinct().join(counts, "bag_id", "left").join(peaks, "bag_id", "left")
    units = units.select((F.col("bag_id").cast("long") % 3).alias("family"), F.col("s").isNotNull().alias("admission"), (F.col("s") >= 3).alias("aggregate"), "peaks")
    found = metrics.fp_profile(units, "family", ["admission", "aggregate", "peaks"])
    return found.select("family", "layer", "n", "passed", *[F.round(c, 9).alias(c) for c in ("rate", "lo", "hi")])


@query(f"""WITH RECURSIVE {BAGS}, found AS (SELECT 'least' || t AS variant, bag, p, s FROM peaks, unnest([3, 4]) AS x(t) WHERE s >= t),
    negative AS (SELECT 'least' || t AS variant, 'f' || (bag % 3) AS family, count(*) AS n, count(*) FILTER (top >= t) AS fired FROM (SELECT s.bag, max(peaks.s) AS top FROM s LEFT JOIN peaks ON peaks.bag = s.bag WHERE s.bag % 3 > 0 GROUP BY 1), unnest([3, 4]) AS x(t) GROUP BY 1, 2),
    bags AS (SELECT variant, bag, count(*) AS n, count(*) FILTER (2 * greatest(0, least(p + 11, 24) - greatest(p, 10)) >= 25 - greatest(0, least(p + 11, 24) - greatest(p, 10))) AS ok, count(*) FILTER (p = 10) AS exact, min(abs(p - 10)) AS away FROM found WHERE bag % 3 = 0 GROUP BY 1, 2),
    total AS (SELECT variant, count(*) AS detected, sum(n)::BIGINT AS n_peaks, sum(ok)::BIGINT AS right_peaks, count(*) FILTER (ok > 0) AS right_bags, sum(exact)::BIGINT AS exact_peaks, count(*) FILTER (away <= 1) AS near_bags FROM bags GROUP BY 1),
    shares AS (SELECT fired AS k, n FROM negative UNION SELECT right_peaks, n_peaks FROM total UNION SELECT right_bags, detected FROM total), {intervals_sql("ci", "k", "n", "shares")},
    worst AS (SELECT m.variant, m.family, ci.hi, row_number() OVER (PARTITION BY m.variant ORDER BY ci.hi DESC, m.family) AS r FROM negative m JOIN ci ON ci.k = m.fired AND ci.n = m.n), z AS (SELECT count(DISTINCT bag) AS n_bags FROM s WHERE bag % 3 = 0)
    SELECT t.variant, n_bags, detected, round(detected / n_bags, 9) AS coverage, n_peaks, round(right_peaks / n_peaks, 9) AS ppv_peak, round(a.lo, 9) AS ppv_peak_lo, round(a.hi, 9) AS ppv_peak_hi, round(right_bags / detected, 9) AS ppv_bag, round(y.lo, 9) AS ppv_bag_lo, round(y.hi, 9) AS ppv_bag_hi,
           exact_peaks, near_bags, x.family AS worst_family, round(x.hi, 9) AS worst_hi, round(-x.hi, 9) AS selection FROM total t JOIN worst x ON x.variant = t.variant AND x.r = 1 JOIN ci a ON a.k = right_peaks AND a.n = n_peaks JOIN ci y ON y.k = right_bags AND y.n = detected, z""")
def metric_variant_score(spark, sf_dir):
    """Two settings of the least support, scored on one family of bags as positives and on the others as negatives."""
    sites = digest_bags(spark, sf_dir)
    peaks = cut(detect_peaks(sites, BAG_SPEC), "peaks")
    variants = F.explode(F.array(*[F.struct(F.lit(f"least{t}").alias("variant"), F.lit(t).alias("t")) for t in (3, 4)])).alias("v")
    by = peaks.select("*", variants).where(F.col("s") >= F.col("v.t")).select("v.variant", "bag_id", "p", F.lit(11).alias("length"))
    fired = by.select("variant", "bag_id").distinct().withColumn("f", F.lit(1))
    family = F.col("bag_id").cast("long") % 3
    bags = sites.select("bag_id").distinct()
    swept = bags.where(family > 0).select("bag_id", F.concat(F.lit("f"), family.cast("string")).alias("family"), variants).select("bag_id", "family", "v.variant").join(fired, ["variant", "bag_id"], "left").groupBy("variant", "family").agg(F.count(F.lit(1)).alias("n"), F.count("f").alias("fired"))
    found = metrics.variant_score(by, bags.where(family == 0).select("bag_id", F.lit(10).alias("gold"), F.lit(14).alias("gold_length")), swept, "variant", "bag_id", "p", "length")
    exact = ["variant", "n_bags", "detected", "n_peaks", "exact_peaks", "near_bags", "worst_family"]
    return found.select(*[c if c in exact else F.round(c, 9).alias(c) for c in found.columns])


@query()
def scorer_bag_clusters(spark, sf_dir):
    """Ranked clusters of the same bags."""
    out = score_clusters(digest_bags(spark, sf_dir), BAG_SPEC)
    return out.select("bag_id", "id", "median", "mad", "n_support", "n_groups", "passes", "anchor", "rank_support", "rank_groups", "rank_spread")
