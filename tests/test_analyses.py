"""Planted truth through the whole plans, and the smaller programs against plain Python."""

import functools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import align, metrics, nulls
from siftline.plans import scorer


def test_detector_finds_planted_windows(spark):
    bags = nulls.synthetic_bags(spark, 12, 6, 80, 60, 13, 1, 4).cache()
    again = {tuple(r) for r in nulls.synthetic_bags(spark, 12, 6, 80, 60, 13, 1, 4).repartition(5).collect()}
    assert {tuple(r) for r in bags.collect()} == again
    spec = scorer.Spec(lengths=(13,), least=11, s_threshold=4)
    truth = bags.groupBy("bag_id").agg(F.min("planted").alias("planted"), F.lit("all").alias("stratum"))
    m = scorer.detection_metrics(scorer.detect_peaks(bags, spec), truth).first()
    assert m.n_bags == 12 and m.coverage >= 0.9 and m.ppv_peak >= 0.9 and m.exact >= 0.7
    layers = {r.layer: r.n_bags for r in scorer.survival(scorer.detect_peaks(bags, spec), scorer.hits_of(bags, spec), bags).collect()}
    assert layers["L1"] >= layers["L2"] >= layers["L4"] >= layers["L5"] >= 10
    assert scorer.null_calibration(bags, spec).first()["threshold"] < 4


def test_scorer_ranks_planted_cluster(spark):
    draw = random.Random(2)
    nc = "".join(draw.choices("ACGT", k=60))
    rows = []
    for i in range(6):
        flank = draw.choices("ACGT", k=60)
        flank[30 + i % 3 : 41 + i % 3] = nc[20:31]
        rows.append(("b", i, nc, "".join(flank)))
    df = spark.createDataFrame(rows, "bag_id string, site_ord int, nc string, flank string")
    out = scorer.score_clusters(df, scorer.Spec(lengths=(11,), least=9)).orderBy("rank_support").collect()
    planted = next(r for r in out if r.key == "fwd|11|20" and r.n_support == 6)
    assert planted.passes and planted.n_groups >= 3 and planted["median"] == 31.0
    # windows that slide along the planted one tie with it in support and spread: none may beat it
    better = [r for r in out if r.passes and r.rank_support < planted.rank_support]
    assert all((r.n_support, r.mad) == (planted.n_support, planted.mad) for r in better)
    assert [r.rank_support for r in out if r.passes] == list(range(1, 1 + sum(r.passes for r in out)))


def best_global(a, b, match, mismatch, opened, longer):
    """(score, pairs, identical bases) by recursion over (i, j, what the last column was)."""

    @functools.cache
    def upto(i, j, last):
        if i == j == 0:
            return (0, 0, 0) if last == "pair" else None
        out = []
        if last == "pair" and i and j:
            same = a[i - 1] == b[j - 1]
            out = [(s + (match if same else mismatch), p + 1, q + (same and a[i - 1] in "ACGT")) for s, p, q in filter(None, (upto(i - 1, j - 1, k) for k in ("pair", "b", "a")))]
        elif last in "ab" and (i if last == "b" else j):
            before = (i - 1, j) if last == "b" else (i, j - 1)
            out = [(x[0] + (longer if k == last else opened), *x[1:]) for k in ("pair", "b", "a") if (x := upto(*before, k))]
        return max(out, default=None)

    return max(filter(None, (upto(len(a), len(b), k) for k in ("pair", "b", "a"))))


def best_local(a, b, match, mismatch, gap):
    best = {(i, j): (0, 0, 0) for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            s, q, c = best[i - 1, j - 1]
            steps = [(s + (match if x == y else mismatch), q + (x == y), c - 1)] + [(s + gap, q, c - 1) for s, q, c in (best[i - 1, j], best[i, j - 1])]
            best[i, j] = max((0, 0, 0), *steps)
    s, q, c = max(best.values())
    return s, q, -c


def test_alignments_by_recursion():
    draw = random.Random(5)
    words = ["", "A", "N"] + ["".join(draw.choice("ACGTN") for _ in range(draw.randrange(1, 24))) for _ in range(60)]
    words += [w[: len(w) // 2] + w[len(w) // 2 + 2 :] for w in words[20:40]]
    a, b = [draw.choice(words) for _ in range(400)], [draw.choice(words) for _ in range(400)]
    for costs in ((1, -1, -2, -1), (2, -3, -5, -1), (1, 0, -1, -1)):
        found = align.global_alignments(a, b, *costs)
        assert [tuple(r) for r in found.tolist()] == [best_global(x, y, *costs) for x, y in zip(a, b)]
        turned = align.global_alignments(b, a, *costs)
        assert (found == turned).all()
    for costs in ((1, 0, -1), (2, -1, -2)):
        assert [tuple(r) for r in align.local_alignments(a, b, *costs).tolist()] == [best_local(x, y, *costs) for x, y in zip(a, b)]
    with pytest.raises(ValueError):
        align.local_alignments(["A"], ["A"], 1, 1, -1)


def test_alignments_of_many_pairs_take_seconds():
    draw = np.random.default_rng(1)
    text = lambda: "".join(draw.choice(list("ACGT"), 200))
    a, b = [text() for _ in range(2000)], [text() for _ in range(2000)]
    began = time.time()
    align.global_alignments(a, b)
    assert time.time() - began < 20


def test_alignments(spark):
    rows = [("ACGT", "ACGT"), ("ACGT", "ACGT"), (None, "A"), ("", "AC"), ("ACGGT", "ACGT"), ("ACNT", "ACNT")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = {(r.a, r.b): r for r in align.aligned_global(df, "a", "b").collect()}
    assert len(got) == 4 and tuple(got["ACGT", "ACGT"])[2:] == (4, 4, 4, 0, 0, 1.0, 1.0, 1.0)
    assert tuple(got["", "AC"])[3:] == (0, 0, 0, 0, 0.0, 0.0, 0.0)
    assert tuple(got["ACGGT", "ACGT"])[2:] == (2, 4, 4, 0, 1, 1.0, 1.0, 0.8)
    assert (got["ACNT", "ACNT"].matches, got["ACNT", "ACNT"].identity) == (3, 0.75)
    assert {tuple(r) for r in align.aligned_local(df, "a", "b").collect()} >= {("ACGT", "ACGT", 4, 4, 4), ("", "AC", 0, 0, 0)}
    four = spark.createDataFrame([(1, "ACGTACGT", "ACGTACGT", "AAAA", "TTTT"), (2, "ACNT", "ACNT", "AC", "AC"), (3, "ACGT", "ACGT", "ACGT", "ACGT"), (4, "", "A", "N", "N")], "k int, la string, lb string, ra string, rb string")
    sides = {r.k: (r.left.eligible, r.right.eligible, r.chosen.side) for r in align.sides(four, ("la", "lb"), ("ra", "rb"), 2, 0.5).collect()}
    assert sides == {1: (True, True, "left"), 2: (False, True, "right"), 3: (True, True, "left"), 4: (False, False, "none")}


def test_frames_and_repeats(spark):
    df = spark.createDataFrame([(1, "ATGGCCTAAATGTTT")], "k int, s string")
    got = {(r.strand, r.frame, r.start): r.protein for r in align.open_frames(df, ["k"], "s", 2).collect()}
    assert got["+", 0, 0] == "MA" and got["+", 0, 3] == "MF"
    word = "ACGTTGCAAC"
    r = align.end_repeat(spark.createDataFrame([(1, "GG" + word + "T" * 40 + word + "CC")], "k int, s string"), ["k"], "s", 14, 6, False).first()
    assert (r.length, r.left, r.right) == (10, 2, 2)
    p = spark.range(1).select(align.project_interval(F.lit(2), F.lit(5), F.lit(10), F.lit(20), F.lit("-"), F.lit("unique"), F.lit(100)).alias("p")).first()["p"]
    assert (p["status"], p["lo"], p["hi"]) == ("projected", 15, 18)


def test_resampling(spark):
    draw = random.Random(0)
    rows = [(f"u{i}", i % 3 == 0, draw.random() + (i % 3 == 0), draw.random()) for i in range(90)]
    df = spark.createDataFrame(rows, "u string, y boolean, a double, b double").withColumn("g", F.lit(1))
    r = metrics.auroc_delta(df, ["g"], "u", "a", "b", "y", 50).first()
    assert r.delta > 0.3 and r.lo < r.delta < r.hi
    inner = spark.createDataFrame([(f"u{i}", d, float(i % 2), 1.0) for i in range(30) for d in range(4)], "u string, draw int, num double, den double")
    n = metrics.nested_bootstrap(inner, "u", "draw", "num", "den", 4, 50).first()
    assert n.ratio == 0.5 and n.lo <= 0.5 <= n.hi
    a, b = (spark.createDataFrame([(i, i < k) for i in range(40)], "u int, hit boolean") for k in (2, 15))
    assert metrics.decision_gate(a, b, "u", "hit").first().verdict == "a_lower"


def test_statistics(spark):
    xs = [(1.0, 2.0, True), (2.0, 1.0, True), (3.0, 4.0, False), (4.0, 3.0, False), (5.0, 5.0, False)]
    df = spark.createDataFrame(xs, "x double, y double, f boolean")
    assert abs(metrics.rank_correlation(df, "x", "y").first()["rho"] - 0.8) < 1e-12
    r = metrics.two_samples(df, "x", F.col("f")).first()
    assert r.ks == 1.0 and r.u == 0.0
    rows = [(i, float(i % 2) + 0.1 * math.sin(i), float(i), i % 2 == 1) for i in range(100)]
    cv = metrics.cross_validated_auroc(spark.createDataFrame(rows, "k int, a double, b double, y boolean"), "k", ["a", "b"], "y", 3).collect()
    assert cv and all(r.auroc > 0.95 for r in cv)
    hits = spark.createDataFrame([(b, s, b) for b in range(6) for s in range(4)], "bag int, site int, key int")
    n = {(r.perm, r.s): r.n for r in metrics.coherence_permutation(hits, "bag", "site", "key", 3).collect()}
    assert n[0, 4] == 6 and all(n.get((p, 4), 0) < 6 for p in (1, 2, 3))


@pytest.mark.parametrize("kind", ["orientation", "position", "target"])
def test_counterfactuals_keep_lengths(spark, kind):
    df = spark.createDataFrame([(i, "ACGT" * 5, "ACGGTCATTACGATCGAAAC", 4, 6) for i in range(5)], "k int, nc string, flank string, lo int, n int")
    neg = nulls.counterfactual(df, "k", kind, "nc", "flank", "lo", "n")
    assert nulls.broken_invariants(df, neg, "k", ["nc"], ["flank"]).count() == 0
    assert all(r.flank != "ACGGTCATTACGATCGAAAC" for r in neg.collect())


def test_link_components_by_union_find(spark):
    """Parts of one order are one group: over all lines."""
    from siftline import catalog

    folder = "/root/testdata/sf0.001"
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    orders = {}
    for r in spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        first = orders.setdefault(r.l_orderkey, r.l_partkey)
        a, b = find(first), find(r.l_partkey)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in catalog.QUERIES["link_components"](spark, folder).collect()}
    assert got == {x: find(x) for x in got} and set(got) >= {x for x in root if find(x) != x}
