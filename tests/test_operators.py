import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftline.functions import seq
from siftline.operators import exact, joins, linkage, match, metrics, nulls, topk, validate, windows


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_components_of_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    assert rows(linkage.components(links, "a", "b")) == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]


def test_resolve(spark):
    ask = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    have = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "k string, v int")
    assert rows(joins.resolve_unique(ask, have, ["k"], ["v"])) == sorted([("a", "matched", 1, 1), ("b", "ambiguous", 2, None), ("c", "missing", 0, None)])


def test_overlap_join_equals_pairs(spark):
    draw = random.Random(3)
    a, b = ([(i, draw.randrange(3), float(lo := draw.randrange(100)), float(lo + draw.randrange(0, 30))) for i in range(60)] for _ in range(2))
    schema = "id int, k int, lo double, hi double"
    found = joins.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], 2, 7.0)
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and min(x[3], y[3]) - max(x[2], y[2]) >= 2)
    assert rows(found, "l_id", "r_id") == want


def test_order_does_not_matter(spark):
    draw = random.Random(1)
    data = [(i % 3, i, draw.randrange(20)) for i in range(60)]
    runs = []
    for _ in range(2):
        draw.shuffle(data)
        df = spark.createDataFrame(data, "g int, p int, s int").repartition(3)
        runs.append((rows(windows.peaks(df, ["g"], "p", "s", 5)), rows(topk.top_k(df, ["g"], [F.desc("s"), F.asc("p")], 4)), rows(metrics.average_precision(df, ["g"], "s", F.col("p") % 2 == 0, "p"))))
    assert runs[0] == runs[1]


def test_auroc(spark):
    for pos, neg, want in (([0.9, 0.8], [0.5, 0.6], 1.0), ([0.5, 0.6], [0.9, 0.8], 0.0), ([0.8], [0.8], 0.5), ([0.8], [], None)):
        df = spark.createDataFrame([(x, True) for x in pos] + [(x, False) for x in neg], "s double, y boolean")
        assert metrics.auroc(df, [], "s", F.col("y")).first()["auroc"] == want


def test_intervals():
    lo, hi = exact.clopper_pearson([5, 0, 0, 10], [10, 0, 10, 10])
    assert np.allclose(lo, [0.18708603, 0, 0, 0.69150289]) and np.allclose(hi, [0.81291397, 1, 0.30849711, 1])


def test_tails_equal_sums_of_terms():
    """Against sums of exact terms, on both sides of every switch of method, and far out."""
    from fractions import Fraction
    from math import comb

    for n, p in ((1, 0.5), (12, 0.25), (60, 0.9), (300, 0.01), (2500, 0.4)):
        q = Fraction(p)
        for k in sorted({0, 1, n // 4, n // 3, n // 2, int(n * p), min(n, int(n * p) + 3), n, n + 1}):
            terms = [comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k, n + 1)] if n < 1000 or p != 0.4 else None
            if terms is None:  # logs for the large one
                logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
                want = math.fsum(math.exp(x) for x in logs)
            else:
                want = float(sum(terms))
            got = float(exact.binomial_tail(k, n, p)[0])
            assert abs(got - want) <= 1e-9 * want + 1e-14, (n, p, k, got, want)


def test_intervals_of_very_many_trials():
    """The ends are where the tails are a fortieth, whatever the number of trials; the work does not grow with it."""
    k = np.array([0, 1, 7, 10**4, 3 * 10**8, 10**9 - 5])
    lo, hi = exact.clopper_pearson(k, 10**9)
    assert np.allclose(exact.binomial_tail(k, 10**9, lo)[1:], 0.025, rtol=1e-6)
    assert np.allclose(1 - exact.binomial_tail(k + 1, 10**9, hi), 0.025, rtol=1e-6)
    z = 1.959963984540054 * np.sqrt(0.3 * 0.7 / 10**9)
    assert abs(lo[4] - (0.3 - z)) < 1e-8 and abs(hi[4] - (0.3 + z)) < 1e-8


def test_profiles_and_variants(spark):
    units = spark.createDataFrame([("a", True, True), ("a", True, None), ("b", False, False)], "family string, l1 boolean, l2 boolean")
    got = {(r.family, r.layer): (r.n, r.passed, r.rate, round(r.lo, 4), round(r.hi, 4)) for r in metrics.fp_profile(units, "family", ["l1", "l2"]).collect()}
    assert got == {("a", "l1"): (2, 2, 1.0, 0.1581, 1.0), ("a", "l2"): (2, 1, 0.5, 0.0126, 0.9874), ("b", "l1"): (1, 0, 0.0, 0.0, 0.975), ("b", "l2"): (1, 0, 0.0, 0.0, 0.975)}
    peaks = spark.createDataFrame([("v", "x", 10, 11), ("v", "x", 40, 11), ("v", "y", 12, 11), ("v", "y", 90, 11)], "variant string, bag string, p int, n int")
    truth = spark.createDataFrame([(b, 10, 11) for b in "xyz"], "bag string, gold int, gold_length int")
    swept = spark.createDataFrame([("v", "f", 100, 3), ("v", "g", 10, 1), ("none", "f", 100, 0)], "variant string, family string, n long, fired long")
    rows = {r.variant: r for r in metrics.variant_score(peaks, truth, swept, "variant", "bag", "p", "n").collect()}
    v = rows["v"]
    assert (v.n_bags, v.detected, round(v.coverage, 4), v.ppv_peak, v.ppv_bag, v.exact_peaks, v.near_bags) == (3, 2, 0.6667, 0.5, 1.0, 1, 1)
    assert v.worst_family == "g" and abs(v.worst_hi - 0.4450161) < 1e-6 and v.selection == -v.worst_hi
    assert (rows["none"].detected, rows["none"].coverage, rows["none"].ppv_peak_lo, rows["none"].ppv_peak_hi) == (0, 0.0, 0.0, 1.0)


def test_probes_equal_single_fits(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    draw = np.random.default_rng(7)
    y = draw.integers(0, 2, 400)
    x = np.stack([draw.normal(size=400) + 1.5 * y, draw.normal(size=400) - 0.5 * y, draw.normal(size=400)], axis=1)
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(400)] + [(900, None, 1.0, 1.0, 1), (901, 1.0, 1.0, 1.0, None)], "k int, a double, b double, c double, y int")
    got = {(r.feature, r.fold): r for r in metrics.probes(df, "k", ["a", "b", "c"], "y", 3).collect()}
    assert len(got) == 9
    fold = df.select("k", F.floor(seq.hash_uniform("k", salt="0") * 3).cast("int").alias("fold"))
    rows = df.where("y is not null").join(fold, "k")
    for c in "abc":
        m = df.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).first()
        scaled = rows.where(F.col(c).isNotNull()).withColumn("x", (F.col(c) - m.m) / m.s).withColumn("label", F.col("y").cast("double"))
        model = LogisticRegression(maxIter=200, tol=1e-14, regParam=0.0, standardization=False).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(scaled.where("fold != 1")))
        assert abs(got[c, 1].slope - model.coefficients[0]) < 1e-6 and abs(got[c, 1].intercept - model.intercept) < 1e-6
    assert got["a", 0].auroc > 0.8 > 0.6 > got["c", 0].auroc
    assert metrics.probes(df.limit(0), "k", ["a"], "y", 3).count() == 0 and metrics.probes(df.where("y = 1"), "k", ["a"], "y", 3).count() == 0


def test_poisson_binomial(spark):
    ps = [0.1, 0.5, 0.9, 0.3]
    want = sum(p for bits in range(16) for p in [1.0] for p in [__import__("math").prod(x if bits >> i & 1 else 1 - x for i, x in enumerate(ps))] if bin(bits).count("1") >= 2)
    df = spark.createDataFrame([(ps,)], "ps array<double>")
    assert abs(df.select(metrics.poisson_binomial_tail("ps", 2).alias("p")).first()["p"] - want) < 1e-12


@pytest.mark.parametrize("s", ["", "A", "AAAAAA", "ATATATAT", "ACGGTCATTACGATCG" * 8])
def test_exact_shuffle(s):
    for seed in range(10):
        made = nulls.euler_shuffle(s, random.Random(seed))
        assert made == nulls.euler_shuffle(s, random.Random(seed))
        assert Counter(zip(made, made[1:])) == Counter(zip(s, s[1:])) and (made[:1], made[-1:]) == (s[:1], s[-1:])


def test_window_matches(spark):
    df = spark.createDataFrame([(1, "ACGTN", "TACGA"), (2, None, "ACG"), (3, "", "")], "k int, nc string, flank string")
    found = match.window_matches(df, ["k"], "nc", "flank", [3], lambda n: 2)
    got = {(r.orient, r.i, r.f): r.m for r in found.collect()}
    assert got["fwd", 0, 1] == 3 and got["fwd", 1, 2] == 2
    comp = str.maketrans("ACGT", "TGCA")
    for (orient, i, f), m in got.items():
        w = "TACGA"[f : f + 3]
        w = w if orient == "fwd" else w.translate(comp)[::-1]
        assert m == sum(a == b and a in "ACGT" for a, b in zip("ACGTN"[i : i + 3], w))


def test_window_counts_equal_naive_counts(spark):
    """All windows of random sites of many lengths, also over more than one 64-bit word."""
    draw = random.Random(6)
    text = lambda n: "".join(draw.choice("ACGTNacg") for _ in range(n))
    sites = [(k, text(draw.choice([0, 3, 9, 14, 30])), text(draw.choice([0, 5, 12, 63, 64, 65, 140]))) for k in range(60)] + [(60, None, "ACGT"), (61, "ACGTé", "ACéGT")]
    found = match.window_matches(spark.createDataFrame(sites, "k int, a string, b string"), ["k"], "a", "b", [1, 4, 9], lambda n: n // 2).collect()
    code = lambda s: ["ACGT".find(c.upper()) for c in s]
    want = Counter()
    for k, a, b in sites:
        if a is None:
            continue
        x, forward = code(a), code(b)
        for orient, y in (("fwd", forward), ("rc", [3 - c if c >= 0 else c for c in forward[::-1]])):
            for n in (1, 4, 9):
                for i in range(len(x) - n + 1):
                    for j in range(len(y) - n + 1):
                        m = sum(p == q >= 0 for p, q in zip(x[i : i + n], y[j : j + n]))
                        if m >= n // 2 and min(x[i : i + n]) >= 0:
                            want[k, orient, n, i, j if orient == "fwd" else len(b) - j - n, m] += 1
    assert Counter(map(tuple, found)) == want


def test_motif_reasons(spark):
    want = {"A" * 11: "homopolymer", "ATATATATATA": "period2", "AATTAACGTTAA": None}
    for s, reason in want.items():
        got = spark.range(1).select(F.lit(s).alias("s")).select(match.motif_reasons("s").alias("r")).first()["r"]
        assert (reason in got) if reason else got == []


def test_checks_raise(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(Exception, match="no way"):
        validate.refuse(df, F.col("x") == 1, "no way").collect()
    with pytest.raises(ValueError):
        validate.allow_columns(df, ["y"])
    side = spark.createDataFrame([(1, "bad")], "x int, digest string")
    with pytest.raises(Exception, match="digest"):
        validate.attach_verified(df, side, ["x"], F.col("x").cast("string"), "digest").collect()


def test_pairs_in_blocks_are_all_pairs(spark):
    df = spark.createDataFrame([(i % 2, i, float(i * 37 % 50)) for i in range(60)], "g int, k int, v double")
    rows = df.collect()
    want = {(a.k, b.k) for a in rows for b in rows if a.g == b.g and a.k < b.k}
    assert {(r.k_a, r.k_b) for r in joins.pairs_within(df, ["g"], "k", ["v"], 7).collect()} == want
    near = {(a.k, b.k) for a in rows for b in rows if a.g == b.g and a.k < b.k and abs(a.v - b.v) <= 6}
    got = [(r.k_a, r.k_b) for r in joins.near_pairs(df, ["g"], "k", "v", 6).collect()]
    assert len(got) == len(set(got)) and set(got) == near


def test_running_over_ranges(spark):
    from siftline.operators import windows

    df = spark.createDataFrame([("a" if i % 3 else "b", i, i * 7 % 11) for i in range(200)], "g string, k int, v int")
    for by in (["g"], []):
        got = windows.running(df, by, [F.desc("v"), "k"], F.col("v")).collect()
        groups = {}
        for r in sorted(got, key=lambda r: (-r.v, r.k)):
            own = groups.setdefault(r.g if by else 0, [])
            own.append(r)
        for own in groups.values():
            assert [r["__place"] for r in own] == list(range(1, len(own) + 1)) and [r["__sum"] for r in own] == list(np.cumsum([r.v for r in own])) and all(r["__n"] == len(own) for r in own)


def test_windows_are_drawn_by_weight(spark):
    """Of one light and one heavy window a group takes the heavy one as often as its share; longer sequences give more."""
    df = spark.createDataFrame([(g, k, s) for g in range(900) for k, s in ((0, "AAAA"), (1, "CCCC"), (2, "ANNA"))], "g int, k int, s string")
    weight = F.when(F.col("word") == "CCCC", 3.0).otherwise(1.0)
    got = topk.sample_windows(df, ["g"], ["g", "k"], "s", 4, 1, weight=weight).collect()
    assert len(got) == 900 and abs(sum(r.word == "CCCC" for r in got) / 900 - 0.75) < 0.05
    assert rows(topk.sample_windows(df.repartition(7), ["g"], ["g", "k"], "s", 4, 1, weight=weight)) == sorted(tuple(r) for r in got)
    both = spark.createDataFrame([(g, k, "ACGT" * n) for g in range(300) for k, n in ((0, 2), (1, 6))], "g int, k int, s string")
    got = topk.sample_windows(both, ["g"], ["g", "k"], "s", 4, 2).collect()
    assert len(got) == 600 and len({(r.g, r.k, r.start) for r in got}) == 600 and abs(sum(r.k for r in got) / 600 - 21 / 26) < 0.06
    assert topk.sample_windows(both, ["g"], ["g", "k"], "s", 99, 2).count() == 0


def test_mismatch_classes_are_all_placements(spark):
    from itertools import combinations

    df = spark.createDataFrame([(5, 2), (5, 2), (4, 0), (3, 3), (2, 5), (None, 1)], "n int, k int")
    got = {}
    for r in nulls.mismatch_classes(df, "n", "k").orderBy("n", "k", "class").collect():
        got.setdefault((r.n, r.k), []).append(tuple(r.positions))
    assert got == {(n, k): list(combinations(range(n), k)) for n, k in ((5, 2), (4, 0), (3, 3))}
