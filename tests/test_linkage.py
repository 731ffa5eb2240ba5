"""Clusters, merging, dedup and groups against the rules as loops over one list."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import joins, linkage, positions
from siftline.plans import scorer


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def merged_by_loop(listed, near):
    """The anchor of each of ``listed`` (coordinates, members), which are in best-first order."""
    anchors, out = [], []
    for i, (at, members) in enumerate(listed):
        found = [a for a in anchors if all(abs(x - y) <= d for x, y, d in zip(at, listed[a][0], near)) and len(members & listed[a][1]) >= 0.8 * len(members | listed[a][1])]
        out.append(found[0] if found else i)
        if not found:
            anchors.append(i)
    return out


def clusters_by_loop(hits, offset, min_frac, k_valid):
    """The clusters of hits (site, pos, m), a centre and a hit at a time."""
    need, found = max(1, int(np.ceil(round(min_frac * k_valid, 9)))), {}
    for centre in range(min(p for _, p, _ in hits), max(p for _, p, _ in hits) + 1):
        mid, last = float(centre), None
        for _ in range(20):
            best = {}
            for site, pos, m in hits:
                rank = (abs(pos - mid), -m, pos)
                if abs(pos - mid) <= offset and (site not in best or rank < best[site]):
                    best[site] = rank
            now = sorted((s, r[2], -r[1]) for s, r in best.items())
            if len(now) < need:
                break
            mid = float(np.median([p for _, p, _ in now]))
            if now == last:
                found[mid] = now
                break
            last = now
    listed = []
    for mid, now in found.items():
        ranks = {s: sorted((-m, p) for t, p, m in hits if t == s) for s, _, _ in now}
        listed.append((-len(now), -np.mean([m for *_, m in now]), float(np.median([abs(p - mid) for _, p, _ in now])), mid, tuple(s for s, *_ in now),
                       (len(now) / k_valid, min(p for _, p, _ in now), max(p for _, p, _ in now), min(m for *_, m in now), sum(ranks[s][0] == (-m, p) for s, p, m in now), np.mean([sum(r[0] == ranks[s][0][0] for r in ranks[s]) for s, *_ in now]))))
    kept = []
    for c in sorted(listed):
        if not any(abs(c[3] - o[3]) <= offset and len(set(c[4]) & set(o[4])) / len(set(c[4]) | set(o[4])) >= 0.8 for o in kept):
            kept.append(c)
    return sorted((c[0], c[2], c[3], c[1], c[4], c[5]) for c in kept)


def found_clusters(spark, hits, offset, frac, valid):
    df = spark.createDataFrame([(0, *h, valid) for h in hits], "g int, site int, pos int, m int, valid int")
    return positions.position_clusters(df, ["g"], "site", "pos", "m", "valid", offset, frac).orderBy("cluster_id").collect()


@pytest.mark.parametrize(("at", "offset", "frac", "support", "median"), [([0, 0, 10, 10], 5, 0.5, 4, 5.0), ([5, 5, 6, 6, 60, 60], 5, 0.3, 4, None), ([0, 5, 10, 50], 5, 0.5, 3, None), ([0, 1, 10, 10], 5, 0.5, 2, 10.0)])
def test_clusters(spark, at, offset, frac, support, median):
    found = found_clusters(spark, [(i, p, 11) for i, p in enumerate(at)], offset, frac, len(at))
    assert found[0].n_support == support and (median is None or found[0]["median"] == median)
    assert all(r["median"] - offset <= r.pos_min <= r.pos_max <= r["median"] + offset for r in found)


def test_better_matches_survive(spark):
    """Of two clusters of the same sites the one of more matches stays, though both are equally tight."""
    found = found_clusters(spark, [h for s in range(3) for h in ((s, 10, 8), (s, 14, 11))], 4, 0.5, 3)
    assert [(r["median"], r.mean_m, r.n_best, r.mean_ties) for r in found] == [(14.0, 11.0, 3, 1.0)]


def test_clusters_equal_loops(spark):
    draw = np.random.default_rng(1)
    hits = []
    for g in range(24):
        for _ in range(int(draw.integers(1, 60))):
            hits.append((g, int(draw.integers(0, 8)), int(draw.integers(0, 70 if g % 3 else 12)), int(draw.integers(0, 4))))
    hits = list({h[:3]: h for h in hits}.values())
    df = spark.createDataFrame([(*h, 8) for h in hits], "g int, site int, pos int, m int, valid int").repartition(3)
    got = {}
    for r in positions.position_clusters(df, ["g"], "site", "pos", "m", "valid", 5, 0.3).orderBy("g", "cluster_id").collect():
        got.setdefault(r.g, []).append((-r.n_support, r.mad, r["median"], -r.mean_m, tuple(r.sites), (r.support_frac, r.pos_min, r.pos_max, r.min_m, r.n_best, r.mean_ties)))
    for g in range(24):
        want = clusters_by_loop([h[1:] for h in hits if h[0] == g], 5, 0.3, 8)
        assert len(got.get(g, [])) == len(want)
        for x, y in zip(got.get(g, []), want):
            assert x[4] == y[4] and np.allclose([*x[:4], *x[5]], [*y[:4], *y[5]])
    assert positions.position_clusters(df.limit(0), ["g"], "site", "pos", "m", "valid").count() == 0


@pytest.mark.parametrize("few", [0, 20, 10**6])
def test_list_walked_by_rounds_and_in_one_task(spark, few):
    """A chain of conflicts leaves every second; each conflict in a clique but the best goes; and any graph like the walk."""
    draw = random.Random(few)
    pairs = [(i, i + 1) for i in range(9)] + [(100 + i, 100 + j) for i in range(5) for j in range(i + 1, 5)]
    assert rows(positions.outranked(spark.createDataFrame(pairs, "better int, worse int"), few)) == [(k,) for k in (1, 3, 5, 7, 9, 101, 102, 103, 104)]
    pairs = list({tuple(sorted(draw.sample(range(80), 2))) for _ in range(120)})
    gone = set()
    for b, w in sorted(pairs):
        if b not in gone:
            gone.add(w)
    assert rows(positions.outranked(spark.createDataFrame(pairs, "better int, worse int"), few)) == sorted((k,) for k in gone)
    assert positions.outranked(spark.createDataFrame([], "better int, worse int"), few).count() == 0


def test_merge_equals_loop(spark):
    draw = random.Random(3)
    data = [(g, k, draw.randrange(3), draw.randrange(40), draw.randrange(60) / 2, sorted(draw.sample(range(5), draw.choice([3, 4, 5])))) for g in range(6) for k in range(40)]
    data += [(9, k, 1, 0, 5.0 * k, [1, 2, 3]) for k in range(5)]
    df = spark.createDataFrame(data, "g int, k int, score int, i int, at double, sites array<int>").repartition(3)
    got = dict(((r.g, r.k), r.anchor) for r in positions.greedy_merge(df, ["g"], "k", [("score", False)], {"i": 5, "at": 5}, "sites").collect())
    for g in {d[0] for d in data}:
        listed = sorted((d for d in data if d[0] == g), key=lambda d: (-d[2], d[1]))
        want = merged_by_loop([((d[3], d[4]), set(d[5])) for d in listed], [5, 5])
        assert [got[g, d[1]] for d in listed] == [listed[a][1] for a in want]
    found = {(r.g, r.anchor): r for r in positions.merged(df, positions.greedy_merge(df, ["g"], "k", [("score", False)], {"i": 5, "at": 5}, "sites"), ["g"], "k", ["at"], "sites").collect()}
    assert (found[9, 0].n_merged, found[9, 0].at_max, found[9, 0].sites) == (2, 5.0, [1, 2, 3]) and sum(r.n_merged for r in found.values()) == len(data)


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_interval_dedup_equals_loop(spark, least):
    draw = random.Random(int(10 * least))
    data = []
    for g in range(4):
        for k in range(120):
            lo, lo2 = draw.randrange(60), draw.randrange(20)
            data.append((g, k, draw.randrange(5), lo, lo + draw.choice([0, 1, 2, 4, 8, 16, 30]), lo2, lo2 + draw.choice([4, 5, 8])))
    df = spark.createDataFrame(data, "g int, k int, s int, lo int, hi int, lo2 int, hi2 int")
    iou = lambda a, b, c, d: max(0, min(b, d) - max(a, c)) / u if (u := b - a + d - c - max(0, min(b, d) - max(a, c))) else 0
    for spans in ([("lo", "hi")], [("lo", "hi"), ("lo2", "hi2")]):
        want = []
        for g in range(4):
            kept = []
            for x in sorted((d for d in data if d[0] == g), key=lambda d: (-d[2], d[1])):
                if not any(all(iou(*x[3 + 2 * n : 5 + 2 * n], *y[3 + 2 * n : 5 + 2 * n]) >= least for n in range(len(spans))) for y in kept):
                    kept.append(x)
            want += kept
        assert rows(positions.dedup_intervals(df, ["g"], "k", "s", spans, least), "g", "k") == sorted(x[:2] for x in want)
    with pytest.raises(ValueError):
        positions.dedup_intervals(df, ["g"], "k", "s", [("lo", "hi")], 1)


def groups_of(links, nodes):
    root = {n: n for n in nodes}
    for a, b in links:
        x, y = root[a], root[b]
        root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
    return root


def test_chained_links_and_counts_equal_pairs(spark):
    draw = random.Random(4)
    data = [(k % 3, k, draw.choice([float(draw.randrange(300)), draw.random() * 300 - 100])) for k in range(200)] + [(0, 900, None), (1, 901, 7.0), (1, 902, 7.0)]
    df = spark.createDataFrame(data, "g int, k int, v double")
    for within in (1.0, 4.0, 30.0):
        pairs = [(x[1], y[1]) for x in data for y in data if x[0] == y[0] and x[1] < y[1] and None not in (x[2], y[2]) and abs(x[2] - y[2]) <= within]
        links = [(r.a, r.b) for r in linkage.chain_links(df, ["g"], "k", "v", within).collect()]
        assert len(links) < len(data) and groups_of(links, [d[1] for d in data]) == groups_of(pairs, [d[1] for d in data])
        stars = linkage.star_anchor(joins.near_pairs(df, ["g"], "k", "v", within).withColumn("size", F.lit(0)), ["g"], "k_a", "k_b", "size")
        assert rows(linkage.near_star_anchor(df, ["g"], "k", "v", within), "g", "anchor", "members") == rows(stars, "g", "anchor", "members")


def test_interval_groups_equal_pairs(spark):
    draw = random.Random(5)
    data = [(draw.choice(["a", "b", "hot", "hot", "hot", None, " "]), k, lo := draw.randrange(900), lo + draw.choice([0, 3, 20, 60, -4])) for k in range(300)] + [("a", 990, None, 4), ("a", 991, 3, None)]
    df = spark.createDataFrame(data, "c string, k int, lo int, hi int").repartition(5)
    ok = [d for d in data if d[0] and d[0].strip() and None not in d]
    pairs = [(x[1], y[1]) for x in ok for y in ok if x[0] == y[0] and x[1] < y[1] and min(x[3], y[3]) - max(x[2], y[2]) >= 5]
    got = {r.k: r.root for r in linkage.interval_groups(df, ["c"], "k", "lo", "hi", 5).collect()}
    assert got == groups_of(pairs, [d[1] for d in data]) and len(got) == len(data)


def test_two_motifs_at_one_place_of_the_flank_stay_two(spark):
    """The sites of a bag share two windows of nc, far apart there, at nearly the same place of the flank, one of them turned."""
    draw = random.Random(12)
    text = lambda n: "".join(draw.choices("ACGT", k=n))
    nc = text(80)
    turned = nc[60:72][::-1].translate(str.maketrans("ACGT", "TGCA"))
    sites = []
    for i in range(6):
        flank = list(text(90))
        flank[30:42], flank[44:56], flank[60:72] = nc[5:17], nc[40:52], turned
        sites.append(("b", i, nc, "".join(flank)))
    out = scorer.score_clusters(spark.createDataFrame(sites, "bag_id string, site_ord int, nc string, flank string"), scorer.Spec(lengths=(12,), least=11, offset=20.0)).collect()
    full = {r.id.split("#")[0]: r for r in out if r.n_support == 6 and r.mean_frac == 1.0}
    assert {"fwd|12|5", "fwd|12|40", "rc|12|60"} <= set(full)
    assert all(full[k].anchor == full[k].id for k in ("fwd|12|5", "fwd|12|40", "rc|12|60"))
