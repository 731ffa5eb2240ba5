"""That work is dealt to tasks and done once, on the plans themselves."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.functions import seq
from siftline.operators import bagwise, features, match
from siftline.plans import scorer, sequences

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rows_are_dealt_before_anything_is_made_of_them(spark):
    pairs = sequences.pairs(spark, DIR)
    assert pairs.rdd.getNumPartitions() > 1
    assert plan(pairs).count("md5") == 0
    bags = scorer.digest_bags(spark, DIR)
    assert bags.rdd.getNumPartitions() > 1
    parts = bags.select("bag_id", F.spark_partition_id().alias("p")).distinct()
    assert parts.count() == parts.select("bag_id").distinct().count()


def test_a_task_has_no_more_pairs_as_the_table_grows(spark, monkeypatch):
    from siftline import session

    n = spark.read.parquet(f"{DIR}/part.parquet").count()
    monkeypatch.setattr(session, "ROWS", 4, raising=False)
    assert sequences.pairs(spark, DIR).rdd.getNumPartitions() == n // 4


def test_best_matches_are_hashed_once_for_all_widths(spark):
    hits = spark.createDataFrame([(1, "fwd", 9, 0, 3, 7), (1, "fwd", 9, 0, 12, 8), (1, "fwd", 9, 0, 11, 8), (1, "rc", 9, 2, 0, 0)], "k int, orient string, L int, i int, f int, m int")
    best = match.match_table(hits, ["k"], [0, 10, 12, 20])
    assert "SortAggregate" not in plan(best)
    want = [(1, "fwd", 9, 0, 0, 8, 11), (1, "fwd", 9, 0, 10, 8, 11), (1, "fwd", 9, 0, 12, 8, 12), (1, "fwd", 9, 0, 20, 0, -1), (1, "rc", 9, 2, 0, 0, 0), *((1, "rc", 9, 2, e, 0, -1) for e in (10, 12, 20))]
    assert sorted(tuple(r) for r in best.collect()) == want


def test_best_matches_are_those_of_whole_texts(spark):
    """windows that begin behind the first 40 letters count too, in both texts."""
    rows = sequences.match_best(spark, DIR).where("k <= 9").collect()
    turn = str.maketrans("ACGT", "TGCA")
    want = {}
    for p in sequences.pairs(spark, DIR).where("k <= 9").collect():
        for orient, y in (("fwd", p.b), ("rc", p.b.translate(turn)[::-1])):
            for i in range(len(p.a) - 8):
                for j in range(len(y) - 8):
                    m = sum(s == t for s, t in zip(p.a[i : i + 9], y[j : j + 9]))
                    if m >= 7 and "N" not in p.a[i : i + 9]:
                        f = j if orient == "fwd" else len(y) - 9 - j
                        for e in (0, 10, 20):
                            best = want.setdefault((p.k, orient, i, e), (0, 1))
                            want[p.k, orient, i, e] = max(best, (m, -f)) if f >= e else best
    assert {(r.k, r.orient, r.i, r.excl): (r.m, -r.f) for r in rows} == want
    assert max(r.i for r in rows) > 31 and max(r.f for r in rows) > 31


def test_survival_counts_hits_once(spark):
    from siftline.catalog import QUERIES

    assert "MapInArrow" not in plan(QUERIES["detector_bag_survival"](spark, DIR))


def test_motif_flags_are_the_reasons(spark):
    rng = random.Random(5)
    words = [None, "", "A", "N" * 9, "acgtacgt", "AAAAAACGTCG", "ATATATATATA", "\U0001d11eAC\U0001d11eAC"] + ["".join(rng.choices("ACGTN", [5, 1, 1, 5, 1], k=rng.randint(0, 14))) for _ in range(300)]
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").select("k", match.motif_reasons("w", 4, 0.6, 0.8, 1.5).alias("r")).collect()
    want = {r.k: r.r for r in rows}
    for k, flags in enumerate(match.motif_flags(words, 4, 0.6, 0.8, 1.5)):
        assert [t for b, t in enumerate(match.TESTS) if flags >> b & 1] == want[k], words[k]


def test_entropy_works_counts_out_once(spark):
    df = spark.range(3).select(F.lit("ACGT").alias("s")).select(seq.dinucleotide_entropy("s").alias("e"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_count") == 16


def test_seed_repeats_look_for_places_without_patterns(spark):
    s = "ACGTTGCAAGGACCTTAGGACGTACGTTGACC"
    df = spark.createDataFrame([(s,), ("",), (None,)], "s string").select("s", seq.seed_repeat("s", 16, 3, 6).alias("r"))
    assert "regexp" not in df._jdf.queryExecution().analyzed().toString()
    left, right = s[:16], s[16:32]
    hits = [(k, i - right.find(left[i : i + k]), 16 - i - k + right.find(left[i : i + k]), left[i : i + k]) for k in range(3, 7) for i in range(17 - k) if left[i : i + k] in right]
    assert {r.s: r.r and tuple(r.r) for r in df.collect()} == {s: max(hits), "": None, None: None}


def test_windows_of_one_strand_with_spacers(spark):
    a, b = "ACGTNACGTA", "TTACGTNACG"
    got = match.window_matches(spark.createDataFrame([(1, a, b)], "k int, a string, b string"), ["k"], "a", "b", [5], lambda n: 4, ("fwd",), with_n=True)
    count = lambda i, j: sum(x == y != "N" for x, y in zip(a[i : i + 5], b[j : j + 5]))
    assert sorted((r.orient, r.i, r.f, r.m) for r in got.collect()) == [("fwd", i, j, count(i, j)) for i in range(6) for j in range(6) if count(i, j) >= 4]
    own = spark.createDataFrame([(a, b), (None, b), ("", b)], "a string, b string").select(seq.window_hits("a", "b", 5, 4).alias("h"))
    assert [[tuple(x) for x in r.h] for r in own.collect()] == [[(i, j, count(i, j)) for i in range(6) for j in range(6) if count(i, j) >= 4], [], []]


def test_sums_of_cells_without_their_rows(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("ACGTN", k=n))
    sites = spark.createDataFrame([(1, word(30), word(20)), (2, word(300), word(270)), (3, "", "ACGT"), (4, None, "A")], "k int, a string, b string")
    by = {"fwd_dot": 1, "rc_L5": 5, "dir_fusion_0": 1, "fwd_seed_dens_L3_r4": 81}
    kind = dict(groups="ABD", lengths=[5], seeds=[3], radius=4)
    got = features.cell_sums(sites, ["k"], "a", "b", by, lambda i, j: (i * 7 + j) % 5 + 1, **kind)
    assert "HashAggregate" not in plan(got)
    u = (F.col("i") * 7 + F.col("j")) % 5 + 1
    want = features.cells(sites, ["k"], "a", "b", **kind).groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.sum(u * F.round(F.col(c) * f).cast("long")).alias(c) for c, f in by.items()])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        features.cell_sums(sites, ["k"], "a", "b", {"nothing": 1}, lambda i, j: i * 0 + j * 0)


def test_growing_sides_are_not_broadcast(spark):
    from siftline.operators import align
    from siftline.plans import features as plans

    rows = spark.createDataFrame([(1, "ACGTACGTTT", "ACGTA")], "k int, s string, t string")
    assert "BroadcastHashJoin" not in plan(align.end_repeat(rows, ["k"], "s", 5, 3, True))
    assert "BroadcastHashJoin" not in plan(plans.features_candidates(spark, DIR))
    assert "BroadcastHashJoin" not in plan(plans.features_patches(spark, DIR))


def test_division_deals_parents_by_rows(spark, monkeypatch):
    from siftline import session
    from siftline.operators import joins

    monkeypatch.setattr(session, "ROWS", 1, raising=False)
    monkeypatch.setattr(session, "GROUPED", 1, raising=False)
    facts = spark.createDataFrame([(k % 50, c) for k in range(90) for c in "ab"[: 1 + k % 2]] + [(None, "a"), (None, "b"), (7, None)], "k int, c string")
    held = joins.having_all(facts, "k", "c", facts.where("c is not null"))
    assert "REPARTITION_BY_NUM" in plan(held)
    assert {(r.k, r.n_held) for r in held.collect()} == {(None, 2), *((k, 2) for k in range(50) if k % 2)}


def test_sweep_reads_a_row_once_for_all_settings(spark):
    from siftline.operators import reports

    grid = spark.createDataFrame([(t, s) for t in range(10) for s in range(9)] + [(3, 3)], "t int, s int")
    rng = random.Random(2)
    data = [(rng.choice(["x", "y", None]), rng.randrange(12), rng.randrange(10), rng.choice([*range(9), None])) for _ in range(200)]
    df = spark.createDataFrame(data, "family string, unit int, a int, b int")
    found = reports.sweep(df, grid, "family", "unit", (F.col("a") >= F.col("t")) & (F.col("b") >= F.col("s")))
    assert "NestedLoop" not in plan(found)
    units = {}
    for f, u, a, b in data:
        units.setdefault((f, u), []).append((a, b))
    want = set()
    for t in range(10):
        for s in range(9):
            for f in ("x", "y", None):
                own = [v for (g, _), v in units.items() if g == f]
                want.add((t, s, f, len(own), sum(any(b is not None and a >= t and b >= s for a, b in v) for v in own)))
    assert found.dtypes == [("t", "int"), ("s", "int"), ("family", "string"), ("n", "bigint"), ("fired", "bigint")]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert reports.sweep(df, grid.limit(0), "family", "unit", F.col("a") >= F.col("t")).count() == 0


def test_draws_move_once_and_are_not_sorted(spark):
    from siftline.operators import metrics

    facts = spark.createDataFrame([(k, float(k % 3), 1.0) for k in range(60)] + [(None, 5.0, 1.0)], "u int, x double, w double")
    out = metrics.bootstrap_ratio(facts, "u", F.col("x"), F.col("w"), 30)
    assert "ShuffledHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
    r = out.first()
    sums = {u: x for u, x, _ in facts.collect()}
    order = sorted(sums, key=lambda u: (u is not None, u or 0))
    per = metrics.draws(30, facts, "u", 0).where("u is not null").collect()
    ratios = {}
    for d in per:
        a, b = ratios.get(d["__b"], (0, 0))
        ratios[d["__b"]] = a + sums[d.u] * d.times, b + d.times
    lo, hi = np.quantile([a / b for a, b in ratios.values()], [0.025, 0.975])
    assert r.n_units == len(order) and abs(r.lo - lo) < 1e-12 and abs(r.hi - hi) < 1e-12


def test_auroc_differences_draw_once_for_both_scores(spark):
    from siftline.operators import metrics

    df = spark.createDataFrame([(g, k, float(k * 7 % 11), float(k * 5 % 13), k % 3 == 0) for g in "xy" for k in range(40)], "g string, u int, a double, b double, y boolean")
    out = metrics.auroc_delta(df, ["g"], "u", "a", "b", "y", 20)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("md5") == 1
    weights = metrics.draws(20, df.select("g", "y", "u"), "u", 0, ["g", "y"]).collect()
    at = {(r.g, r.u): (r.a, r.b, r.y) for r in df.collect()}
    for r in out.collect():
        deltas = []
        for b in range(1, 21):
            own = [(*at[r.g, w.u], w.times) for w in weights if w.g == r.g and w["__b"] == b]
            auc = [sum(p[3] * q[3] * ((p[c] > q[c]) + 0.5 * (p[c] == q[c])) for p in own if p[2] for q in own if not q[2]) for c in (0, 1)]
            pairs = sum(p[3] for p in own if p[2]) * sum(q[3] for q in own if not q[2])
            deltas.append((auc[0] - auc[1]) / pairs)
        assert np.allclose([r.lo, r.hi], np.quantile(deltas, [0.025, 0.975]))


def test_evidence_makes_few_pairs_with_the_groups_of_all(spark):
    from siftline.operators import linkage

    rng = random.Random(9)
    df = spark.createDataFrame([(g, k, rng.choice([None, rng.uniform(-3000, 9000)])) for g in range(4) for k in rng.sample(range(200), 30)], "g int, k int, v double")
    by_sum, by_cell = linkage.sum_links(df, ["g"], "k", 10), linkage.cell_links(df, ["g"], "k", F.floor(F.col("v") / 1000))
    rows = df.collect()
    for links, test in ((by_sum, lambda x, y: (x.k + y.k) % 10 == 0), (by_cell, lambda x, y: None not in (x.v, y.v) and x.v // 1000 == y.v // 1000)):
        found = [tuple(r) for r in links.collect()]
        assert len(found) <= len(rows)
        root = {(r.g, r.k): (r.g, r.k) for r in rows}

        def top(x):
            return x if root[x] == x else top(root[x])

        for g, a, b in found:
            assert test(*[next(r for r in rows if (r.g, r.k) == (g, k)) for k in (a, b)])
            root[top((g, a))] = top((g, b))
        assert all(top((x.g, x.k)) == top((y.g, y.k)) for x in rows for y in rows if x.g == y.g and x.k != y.k and test(x, y))


def test_folds_read_their_features_from_a_written_table(spark, monkeypatch):
    from siftline.operators import metrics

    written = []
    real = metrics.cut
    monkeypatch.setattr(metrics, "cut", lambda df, name="step": written.append((name, df.columns)) or real(df, name))
    df = spark.createDataFrame([(k, float(k % 7), "t" * k, k % 3 == 0) for k in range(30)], "k int, a double, text string, y boolean")
    assert len(metrics.cross_validated_auroc(df, "k", ["a"], "y", 2).collect()) == 2
    assert ("folds", ["fold", "label", "a"]) in written


def test_rounds_do_not_broadcast_what_grows(spark, monkeypatch):
    from siftline.operators import linkage, positions

    seen = []
    for module in (linkage, positions):
        monkeypatch.setattr(module, "cut", lambda df, name, write=module.cut: seen.append(plan(df)) or write(df, name))
    monkeypatch.setattr(linkage, "FEW", 0, raising=False)
    chain = spark.createDataFrame([(k, k + 1) for k in range(9)], "better int, worse int")
    gone = positions.outranked(chain, 0)
    assert sorted(r.node for r in gone.collect()) == list(range(1, 10, 2))
    roots = linkage.components(chain, "better", "worse")
    assert {r.root for r in roots.collect()} == {0} and roots.count() == 10
    joined = [p for p in seen if "Join" in p and "__c0" not in p]  # __c0: a row for each range
    assert joined and not [p for p in joined if "BroadcastHashJoin" in p]


def test_merge_moves_numbers_instead_of_names(spark, monkeypatch):
    from siftline.operators import positions

    written = []
    real = positions.cut
    monkeypatch.setattr(positions, "cut", lambda df, name="step": written.append((name, dict(df.dtypes))) or real(df, name))
    df = spark.createDataFrame([("g", f"k{k:02d}", k % 5, float(k // 2), [1, 2, 3]) for k in range(40)] + [("h", "k00", None, 0.0, [1, 2, 3])], "g string, k string, score int, at double, sites array<int>")
    got = {(r.g, r.k): r.anchor for r in positions.greedy_merge(df, ["g"], "k", [("score", False)], {"at": 3.0}, "sites").collect()}
    want, stay = {("h", "k00"): "k00"}, []
    for k in sorted(range(40), key=lambda k: (-(k % 5), k)):
        first = next((a for a in stay if abs(a // 2 - k // 2) <= 3), k)
        stay += [k] if first == k else []
        want["g", f"k{k:02d}"] = f"k{first:02d}"
    assert got == want
    near = [kinds for name, kinds in written if name == "near"]
    assert [(k["better"], k["worse"]) for k in near] == [("bigint", "bigint")]
    assert not [name for name, kinds in written if "struct" in "".join(kinds.values())] and "nodes" not in [name for name, _ in written]


def test_groups_are_counted_from_links(spark):
    from siftline.operators import linkage

    sets = spark.createDataFrame([("x", 0, [1, 2, 3, 4, 5]), ("x", 1, [1, 2]), ("y", 0, [7, 8, 9]), ("y", 1, [])], "g string, c int, sites array<long>")
    linked = spark.createDataFrame([("x", 0, 1, 2), ("x", 0, 2, 3), ("x", 0, 1, 3), ("x", 0, 4, 5), ("y", 0, 7, 9)], "g string, c int, a long, b long")
    nodes = sets.select("g", "c", F.explode("sites").alias("k"))
    want = linkage.group_gate(linkage.threshold_groups(nodes, linked, ["g", "c"], "k", "a", "b"), ["g", "c"], 2)
    got = linkage.gated(linkage.group_counts(sets, "sites", linked, ["g", "c"], "a", "b"), 2).drop("sites")
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.where("n_groups > 0").collect())) == sorted(map(tuple, want.collect())) == sorted([("x", 0, 2, True, None), ("x", 1, 2, True, None), ("y", 0, 2, True, None)])


def test_open_frames_are_found_in_batches(spark, monkeypatch):
    from siftline.operators import align

    monkeypatch.setattr(align, "LETTERS", 64, raising=False)
    rng = random.Random(4)
    words = [None, "", "AC", "TAA", "TTATTATTA", "nacgtaß"] + ["".join(rng.choices("ACGTNt", [5, 2, 3, 6, 1, 1], k=rng.randint(0, 90))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(words)), "k int, s string")
    codons = {x + y + z: align.AMINO[16 * i + 4 * j + m] for i, x in enumerate("TCAG") for j, y in enumerate("TCAG") for m, z in enumerate("TCAG")}
    for least in (0, 2):
        found = align.open_frames(rows, ["k"], "s", least)
        assert "MapInArrow" in plan(found)
        want = []
        for k, w in enumerate(words):
            s = (w or "").upper()
            for strand, x in (("+", s), ("-", s.translate(str.maketrans("ACGT", "TGCA"))[::-1])):
                for f in range(3):
                    at = 0
                    for protein in "".join(codons.get(x[i : i + 3], "X") for i in range(f, len(x) - 2, 3)).split("*"):
                        want += [(k, strand, f, at, protein)] * (len(protein) >= least)
                        at += len(protein) + 1
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_shifts_are_compared_in_batches(spark):
    rng = random.Random(6)
    word = lambda: rng.choice([None, "", "AAAAAA", "\U0001d11eACN"] + ["".join(rng.choices("ACN", [5, 2, 1], k=rng.randint(0, 20))) for _ in range(6)])
    data = [(k, word(), word()) for k in range(200)]
    found = spark.createDataFrame(data, "k int, a string, b string").select("k", seq.offset_identity("a", "b", 3, 4).alias("r"))
    assert "ArrowEvalPython" in plan(found) and "lambda" not in plan(found)
    for r, (_, a, b) in zip(sorted(found.collect()), data):
        tried = []
        for o in range(-3, 4) if a is not None and b is not None else ():
            x, y = a[max(o, 0) :], b[max(-o, 0) :]
            n = min(len(x), len(y))
            if n >= 4:
                tried.append((sum(p == q for p, q in zip(x, y)) / n, -abs(o), o, n))
        assert (r.r and tuple(r.r)) == max(tried, default=None)


def test_flanks_dealt_anew_are_those_of_the_hashes(spark):
    import hashlib

    from siftline.operators import reports
    from siftline.plans import reports as plans

    rows = [(1, "ACGTACGTTTGGCA"), (2, ""), (3, None), (None, "ACGGT")]
    df = spark.createDataFrame(rows, "k int, s string")
    made = reports.replicated(df, ["k"], 2, lambda x, key: reports.shuffled_around(x, key, "s", F.lit(3), F.lit(4), 7))
    assert "conv(" not in plan(made) and "array_sort" not in plan(made)

    def deal(part, side, k, rep):
        u = lambda i: int(hashlib.md5("::".join([f"{side}7", *[str(x) for x in (k, rep) if x is not None], str(i)]).encode()).hexdigest()[:8], 16)
        return "".join(part[i] for i in sorted(range(len(part)), key=lambda i: (u(i), i)))

    want = {(k, rep, s and deal(s[:3], "l", k, rep) + s[3:7] + deal(s[7:], "r", k, rep)) for k, s in rows for rep in (1, 2)}
    assert {(r.k, r.replicate, r.s) for r in made.collect()} == want
    assert "BroadcastHashJoin" not in plan(plans.null_replicates(spark, DIR))


def _sites(draw, bag, n, length=60):
    """Sites of a bag that share stretches of nc, at places near each other and with background in common."""
    word = lambda k: "".join(draw.choices("ACGT", k=k))
    nc, ground, out = word(40), word(length), []
    for site in range(n):
        flank = ground if draw.random() < 0.4 else word(length + draw.randrange(5))
        at = 15 + draw.randrange(8)
        out.append((bag, site, nc, flank[:at] + nc[10:26] + flank[at + 16 :]))
    return out


def test_bags_in_a_task_have_the_clusters_that_joins_make(spark):
    """bags of four sites went through a hundred joins. Large bags, and sites that are not told apart, still do."""
    draw = random.Random(4)
    rows = [r for k in range(12) for r in _sites(draw, f"b{k}", 2 + k % 5)] + _sites(draw, "wide", 64, 30) + _sites(draw, "twice", 3) + _sites(draw, "twice", 2)
    rows += [("b1", 77, "ACGT" * 9, None), ("b2", 78, None, "ACGT" * 9), (None, 1, *rows[0][2:]), ("empty", 0, "", ""), ("n", 0, rows[0][2][:30] + "NNN" + rows[0][2][:9], rows[0][3].lower())]
    sites = spark.createDataFrame(rows, "bag_id string, site_ord int, nc string, flank string")
    spec = scorer.Spec(lengths=(9, 11), least=8, margin=3, identity=0.6, least_groups=2)
    found, want = ({(r.bag_id, r.id): r.asDict() for r in f(sites, spec).collect()} for f in (scorer.score_clusters, scorer.joined_clusters))
    assert {b for b, _ in want} >= {"wide", "twice", "b4", "b5"}
    assert any(r["n_groups"] < r["n_support"] for r in want.values()) and any(r["anchor"] != r["id"] for r in want.values())
    assert found == want


def test_bags_fit_a_task_without_joins(spark, monkeypatch):
    monkeypatch.setattr(scorer, "joined_clusters", None)
    assert scorer.score_clusters(scorer.digest_bags(spark, DIR), scorer.BAG_SPEC).count() > 0


def test_bags_are_found_in_whatever_batches(monkeypatch):
    draw, rows = random.Random(9), []
    for k, n in enumerate([30, 3, 0, 400, 45, 20, 1]):
        rows += [(f"b{k}", s, None, None, None, None, None, None, "".join(draw.choices("ACGT", k=50))) for s in range(4)]
        places = draw.sample([(s, o, 11, i, f) for s in range(4) for o in range(2) for i in range(3) for f in range(0, 40, 2)], min(n, 400))
        rows += [(f"b{k}", s, 4, o, L, i, f, draw.randint(8, 11), None) for s, o, L, i, f in places]
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.int32()] * 5, pa.string()]
    table = pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], [c.split()[0] for c in bagwise.INPUT.split(", ")])
    rules = bagwise.Rules(5.0, 0.5, 5, 0.85, 2, 0.8, 5)
    monkeypatch.setattr(bagwise, "HITS", 100)
    run = lambda size: sorted((r for b in bagwise.scored(iter(table.to_batches(size)), rules) for r in b.to_pylist()), key=lambda r: (r["bag_id"], r["id"] or ""))
    whole = run(10_000)
    assert [r["bag_id"] for r in whole if r["id"] is None] == ["b3"] and len(whole) > 10
    monkeypatch.setattr(bagwise, "ROWS", 64)
    monkeypatch.setattr(bagwise, "BLOCK", 50)
    assert run(7) == whole
    assert run(1) == whole
