"""Summaries of runs: guarded choices, bag reports, sweeps, scores of bags, evidence groups, lookups.
Everything is grouped aggregation or an equi-join; nothing passes through one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.functions import seq
from siftline.operators import linkage
from siftline.operators.aggregates import median
from siftline.session import GROUPED, free_name, large, tasks_for


def guarded_best(df: DataFrame, by: list[str], step: str, score: str, guards: dict[str, float], tolerance: float) -> DataFrame:
    """by, step, score: the earliest step whose score is within ``tolerance`` of the best among rows
    that meet all guards (value >= bound; null and NaN pass)."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.isnan(c) | (F.col(c) >= t), F.lit(True)) for c, t in guards.items()], F.lit(True))
    rows = df.where(ok & F.col(score).isNotNull())
    best = rows.groupBy(*by).agg(F.max(score).alias("__best"))
    near = rows.join(best, by).where(F.col(score) >= F.col("__best") - tolerance)
    return near.groupBy(*by).agg(F.min(step).alias(step), F.min_by(score, step).alias(score))


def comparability(sites: DataFrame, bag: str, order: str, regions: str) -> DataFrame:
    """bag, verdict, n: empty (a site without regions), coord_comparable (all sites have the first one's
    region lengths), has_reorder (the same lengths in another order), has_indel."""
    lengths = F.transform(F.coalesce(F.col(regions), F.array()), F.length)
    rows = sites.select(bag, order, lengths.alias("__l"))
    first = rows.groupBy(bag).agg(F.min_by("__l", order).alias("__f"))
    j = rows.join(first, bag)
    none, same, sorted_ = F.size("__l") == 0, F.col("__l") == F.col("__f"), F.array_sort("__l") == F.array_sort("__f")
    return j.groupBy(bag).agg(F.when(F.max(none), "empty").when(F.min(same), "coord_comparable").when(F.min(sorted_), "has_reorder").otherwise("has_indel").alias("verdict"), F.count(F.lit(1)).alias("n"))


def bridge(reps: DataFrame, members: DataFrame, bags: DataFrame) -> DataFrame:
    """bag, rep: reps (rep) over the members of their clusters (rep, member; a rep without any stands for
    itself) to the bags that hold these (member, bag)."""
    found = reps.join(members, "rep", "left").select("rep", F.coalesce("member", "rep").alias("member"))
    return found.join(bags, "member").select("bag", "rep").distinct()


def known_family(s: Column | str, pattern: str, known: list[str]) -> Column:
    """Whether any token of a free text is of a known family."""
    return F.arrays_overlap(F.regexp_extract_all(seq.col(s), F.lit(pattern), F.lit(0)), F.lit(known))


def family_width(df: DataFrame, family: str, widths: dict[str, int]) -> DataFrame:
    """df with width; a family that has none raises."""
    width = F.try_element_at(F.create_map(*[F.lit(x) for kv in widths.items() for x in kv]), F.col(family))
    return df.withColumn("width", F.when(width.isNull(), F.raise_error(F.concat(F.lit("no width for "), F.coalesce(family, F.lit("null")))).cast("int")).otherwise(width))


def without_suffix(s: Column | str, suffixes: list[str]) -> Column:
    """s without the first of ``suffixes`` that it ends with."""
    c = seq.col(s)
    out = c
    for x in reversed(suffixes):
        out = F.when(c.endswith(x), F.substring(c, F.lit(1), F.length(c) - len(x))).otherwise(out)
    return out


def decoy_kind(same_orient: Column, nc_overlap: Column, same_length: Column, flank_overlap: Column) -> Column:
    """What kind of wrong candidate a candidate is, by the first test that holds."""
    return F.when(~same_orient, "wrong_orientation").when(nc_overlap <= 0, "other_window").when(~same_length, "other_length").when(flank_overlap <= 0, "other_target").otherwise("near_miss")


def heterogeneity(df: DataFrame, bag: str, mode: str, pos: str, within: float) -> DataFrame:
    """bag, mode (most frequent, least on ties), median (of pos in it), deviant (share of rows of another
    mode or further than ``within`` from the median), iqr and p10 of pos in the mode."""
    counts = df.groupBy(bag, mode).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.groupBy(bag).agg(F.max(F.struct(F.col("__n"))).alias("__t")).join(counts, bag).where(F.col("__n") == F.col("__t.__n")).groupBy(bag).agg(F.min(mode).alias("__mode"))
    own = F.when(F.col(mode) == F.col("__mode"), F.col(pos))
    rows = df.join(top, bag)
    mid = rows.groupBy(bag).agg(F.max("__mode").alias("mode"), F.percentile(own, F.lit([0.1, 0.25, 0.5, 0.75])).alias("__q"))
    far = (F.col(mode) != F.col("mode")) | (F.abs(F.col(pos) - F.col("__q")[2]) > within)
    return df.join(mid, bag).groupBy(bag, "mode", F.col("__q")[2].alias("median"), (F.col("__q")[3] - F.col("__q")[1]).alias("iqr"), F.col("__q")[0].alias("p10")).agg(F.avg(far.cast("double")).alias("deviant"))


def delta_of_maxima(a: DataFrame, b: DataFrame, key: list[str], x: str, by: list[str]) -> DataFrame:
    """by, mean, median, positive (share above 0), n of the differences a - b on equal keys."""
    both = a.select(*key, F.col(x).alias("__a")).join(b.select(*key, F.col(x).alias("__b")), key).withColumn("__d", F.col("__a") - F.col("__b"))
    return both.groupBy(*by).agg(F.avg("__d").alias("mean"), median("__d").alias("median"), F.avg((F.col("__d") > 0).cast("double")).alias("positive"), F.count(F.lit(1)).alias("n"))


def paired_deltas(df: DataFrame, by: list[str], d: str) -> DataFrame:
    """by, median, mad, std (population), positive, q10, q90."""
    mid = df.groupBy(*by).agg(F.percentile(d, F.lit([0.1, 0.5, 0.9])).alias("__q"))
    return df.join(mid, by).groupBy(*by, F.col("__q")[1].alias("median"), F.col("__q")[0].alias("q10"), F.col("__q")[2].alias("q90")).agg(median(F.abs(F.col(d) - F.col("__q")[1])).alias("mad"), F.stddev_pop(d).alias("std"), F.avg((F.col(d) > 0).cast("double")).alias("positive"))


def retention(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """by, before, after, percent kept."""
    a, b = (df.groupBy(by).agg(F.count(F.lit(1)).alias(n)) for df, n in ((before, "before"), (after, "after")))
    return a.join(b, by, "left").select(by, "before", F.coalesce("after", F.lit(0)).alias("after"), (100.0 * F.coalesce("after", F.lit(0)) / F.col("before")).alias("percent"))


def rank_table(df: DataFrame, by: list[str], rank: str, ks: list[int], least: int = 3, bad: float = 100) -> DataFrame:
    """by, n, median, q90, recall at each k, share of ranks above ``bad``; groups of ``least`` rows or more."""
    rates = [F.avg((F.col(rank) <= k).cast("double")).alias(f"recall_{k}") for k in ks]
    out = df.where(F.col(rank).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile(rank, F.lit([0.5, 0.9])).alias("__q"), *rates, F.avg((F.col(rank) > bad).cast("double")).alias("bad"))
    return out.where(F.col("n") >= least).select(*by, "n", F.col("__q")[0].alias("median"), F.col("__q")[1].alias("q90"), *[f"recall_{k}" for k in ks], "bad")


def against_planned(df: DataFrame, by: list[str], m: str, planned: str, low: float, high: float) -> DataFrame:
    """by, mode (smallest), equal, below, above: how m lies to its plan; in_band: equal within [low, high]."""
    counts = df.groupBy(*by, m).agg(F.count(F.lit(1)).alias("__n"))
    mode = counts.groupBy(*by).agg(F.max_by(m, F.struct(F.col("__n"), -F.col(m))).alias("mode"))
    share = lambda t: F.avg(t.cast("double"))
    rates = df.groupBy(*by).agg(share(F.col(m) == F.col(planned)).alias("equal"), share(F.col(m) < F.col(planned)).alias("below"), share(F.col(m) > F.col(planned)).alias("above"))
    return rates.join(mode, by).withColumn("in_band", F.col("equal").between(low, high))


def rate_table(df: DataFrame, cell: list[str], rate: str) -> DataFrame:
    """cell, rate: median rate of each cell, and n."""
    return df.groupBy(*cell).agg(median(rate).alias("rate"), F.count(F.lit(1)).alias("n"))


def two_level_mixture(rates: DataFrame, by: list[str], m: str, rate: str, wanted: float) -> DataFrame:
    """by, m_low, m_high, weight (of m_low): the neighbouring levels whose rates bracket the wanted one,
    and the log-linear weight that meets it; rates fall with m."""
    own = Window.partitionBy(*by).orderBy(m)
    steps = rates.withColumns({"__m": F.lead(m).over(own), "__r": F.lead(rate).over(own)})
    inside = (F.col(rate) >= wanted) & (F.col("__r") < wanted) & (F.col("__r") > 0)
    weight = (F.log(F.lit(wanted)) - F.log("__r")) / (F.log(rate) - F.log("__r"))
    return steps.where(inside).groupBy(*by).agg(F.min_by(F.struct(F.col(m).alias("a"), F.col("__m").alias("b"), weight.alias("w")), m).alias("s")).select(*by, F.col("s.a").alias("m_low"), F.col("s.b").alias("m_high"), F.col("s.w").alias("weight"))


def top_one(df: DataFrame, by: list[str], slot: str, score: str, truth: str) -> DataFrame:
    """One row: n, accuracy of the slot of best score (least slot on ties) against ``truth``."""
    best = df.groupBy(*by).agg(F.max_by(slot, F.struct(F.col(score), -F.col(slot))).alias("__s"), F.max(truth).alias("__t"))
    return best.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("__s") == F.col("__t")).cast("double")).alias("accuracy"))


def sweep(df: DataFrame, grid: DataFrame, family: str, unit: str, test: Column) -> DataFrame:
    """The grid's columns, family, n, fired: for every row of a (small) parameter table how many units of a
    family fire. One pass over the data: a row's tests are bits of a number, a bit for each setting, and rows are
    dealt by unit, so many to a task."""
    keys = grid.columns
    settings = grid.distinct().collect()
    kinds = dict(grid.dtypes)
    value = lambda row, c: F.lit(row[c]).cast(kinds[c])
    if not settings:
        return grid.crossJoin(df.select(family).limit(0)).withColumns({c: F.lit(0).cast("long") for c in ("n", "fired")})
    masks, tests = [], df
    for at, row in enumerate(settings):
        if at % 63 == 0:
            masks.append(free_name(tests.columns, f"fired{len(masks)}"))
            tests = tests.withColumn(masks[-1], F.lit(0).cast("long"))
        bit = F.when(test, F.lit(1 << at % 63).cast("long")).otherwise(F.lit(0).cast("long"))
        tests = tests.withColumns({c: value(row, c) for c in keys}).withColumn(masks[-1], F.col(masks[-1]).bitwiseOR(bit)).drop(*keys)
    rows = tests.select(family, unit, *masks).repartition(tasks_for(df, GROUPED), family, unit)
    units = rows.groupBy(family, unit).agg(*[F.bit_or(c).alias(c) for c in masks])
    fired = [F.struct(*[value(row, c).alias(c) for c in keys], F.count_if(F.getbit(masks[at // 63], F.lit(at % 63)) == 1).alias("fired")) for at, row in enumerate(settings)]
    wide = units.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.array(*fired).alias("f"))
    return wide.select(family, "n", F.explode("f").alias("f")).select(*[f"f.{c}" for c in keys], family, "n", "f.fired")


def resolution(swept: DataFrame, keys: list[str]) -> DataFrame:
    """keys, worst (largest rate of a family), mean, median: the settings of a sweep, best (least worst) first in ``place``."""
    rate = F.col("fired") / F.col("n")
    out = swept.groupBy(*keys).agg(F.max(rate).alias("worst"), F.avg(rate).alias("mean"), median(rate).alias("median"))
    return out.withColumn("place", F.row_number().over(Window.orderBy("worst", *keys)))  # a row per setting


def refined(best: DataFrame, steps: dict[str, float], keys: list[str]) -> DataFrame:
    """The settings around promoted ones: each key moved by -1, 0 or 1 of its step, distinct."""
    out = best.select(*keys)
    for k, step in steps.items():
        out = out.withColumn(k, F.explode(F.array(F.col(k) - step, F.col(k), F.col(k) + step)))
    return out.distinct()


def bag_score(hits: DataFrame, bag: str, site: str, pos: str, m: str, word: str, multiplicity: str) -> DataFrame:
    """bag, score: mean m * exp(-std / 5) * complexity of the commonest word * share of distinct words / root of the mean multiplicity."""
    words = hits.groupBy(bag, word).agg(F.count(F.lit(1)).alias("__n"))
    common = words.groupBy(bag).agg(F.max_by(word, F.struct(F.col("__n"), F.col(word))).alias("__w"), F.count(F.lit(1)).alias("__d"))
    facts = hits.groupBy(bag).agg(F.avg(m).alias("__m"), F.stddev_pop(pos).alias("__s"), F.avg(multiplicity).alias("__x"), F.count(F.lit(1)).alias("__k"))
    score = F.col("__m") * F.exp(-F.col("__s") / 5) * seq.complexity("__w") * (F.col("__d") / F.col("__k")) / F.sqrt("__x")
    return facts.join(common, bag).select(bag, score.alias("score"))


def multiplicity(nc: Column | str, word: Column | str, least: int) -> Column:
    """How many windows of nc agree with ``word`` in at least ``least`` letters; N agrees with N here."""
    return seq.let(F.struct(seq.chars(nc).alias("a"), seq.chars(word).alias("w")), lambda t: F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(t["a"]) - F.size(t["w"]), F.lit(0))), lambda i: F.aggregate(F.zip_with(F.slice(t["a"], i + 1, F.greatest(F.size(t["w"]), F.lit(1))), t["w"], lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) >= least)))


def composition(s: Column | str) -> list[Column]:
    """22 numbers: shares of the bases, of the 16 pairs, their entropy, and the GC share."""
    n = F.length(seq.col(s))
    bases = [seq.ratio(seq.count_of(s, c).cast("double"), n).alias(f"base_{c}") for c in "ACGT"]
    counts = seq.kmer_counts(s, 2)
    dinucleotides = [seq.ratio(F.get(counts, i).cast("double"), F.greatest(n - 1, F.lit(0))).alias(f"pair_{a}{b}") for i, (a, b) in enumerate((a, b) for a in "ACGT" for b in "ACGT")]
    return [*bases, *dinucleotides, seq.base_entropy(s).alias("entropy"), seq.ratio(seq.count_of(s, "GC").cast("double"), n).alias("gc")]


def chance_match(a: list[Column], b: list[Column], wobble: bool = False) -> Column:
    """Probability that letters drawn by shares a and b (A, C, G, T) agree, at most 0.99."""
    p = reduce(lambda x, y: x + y, [x * y for x, y in zip(a, b)])
    return F.least(p + (a[2] * b[3] + a[3] * b[2] if wobble else F.lit(0.0)), F.lit(0.99))


def joint_hazard(windows: DataFrame, by: list[str], tail: str, s: int) -> DataFrame:
    """by, hazard: expected number of windows that reach their tail in s sites at once by chance."""
    return windows.groupBy(*by).agg(F.sum(F.pow(tail, F.lit(s))).alias("hazard"))


def junction_distance(pos: Column, length: Column, n: Column, side: Column) -> Column:
    """From the edge of a window to the end of the flank that lies at the junction."""
    return F.when(side == "left", n - pos - length).when(side == "right", pos)


def least_over_lengths(df: DataFrame, key: list[str], e: str, threshold: float) -> DataFrame:
    """key, e: positions whose least expectation over all window lengths is below ``threshold``."""
    return df.groupBy(*key).agg(F.min(e).alias(e)).where(F.col(e) < threshold)


def evidence_groups(nodes: DataFrame, pairs: DataFrame, by: list[str], key: str, a: str, b: str, compared: Column, alike: Column, same_locus: Column) -> DataFrame:
    """by, node, root: two backgrounds are one if they are of one locus, too little of them could be
    compared, or what was compared is alike; so that groups are counted with caution."""
    return linkage.threshold_groups(nodes, pairs.where(same_locus | ~compared | alike), by, key, a, b)


def complete_families(groups: DataFrame, by: list[str], member: str, sites: DataFrame, site: str) -> DataFrame:
    """by, root of families that have exactly one member in every site of ``sites`` (by, site)."""
    need = sites.select(*by, site).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("__need"))
    got = groups.groupBy(*by, "root").agg(F.countDistinct(site).alias("__s"), F.count(member).alias("__m"))
    return got.join(need, by).where((F.col("__s") == F.col("__need")) & (F.col("__m") == F.col("__need"))).select(*by, "root")


def dataset_hash(df: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """One row: n, digest: independent of the order of rows and how they are dealt (sums of 60-bit
    pieces of each row's sha256, hashed again)."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in [*key, *content]]), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    return df.agg(F.count(F.lit(1)).alias("n"), *parts).select("n", F.sha2(F.concat_ws(",", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("digest"))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key of rows that both hold; none if they are disjoint."""
    return a.select(key).distinct().join(b.select(key).distinct(), key)


def length_buckets(df: DataFrame, key: str, length: str, size: int, seed: int = 0) -> DataFrame:
    """key, batch, place: rows in order of length (then key) in batches of ``size``; batches in hash order by ``place``."""
    from siftline.operators.windows import running

    rows = running(df.select(key, length), [], [length, key]).select(key, F.floor((F.col("__place") - 1) / size).alias("batch"))
    return rows.withColumn("place", seq.hash_uniform("batch", salt=str(seed)))


def minimal_edit(target: Column | str, guide: Column | str, wanted: Column | int) -> Column:
    """``target`` with as few letters changed as it takes to agree with ``guide`` in ``wanted`` places: from
    the left, mismatches become matches, or matches the next letter of ACGT."""
    want = F.lit(wanted) if isinstance(wanted, int) else wanted
    move = lambda c: F.translate(c, "ACGT", "CGTA")

    def edit(t: Column) -> Column:
        same = F.aggregate(F.zip_with(t["a"], t["b"], lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        step = lambda acc, p: F.when((acc["left"] > 0) & (p["x"] != p["y"]), F.struct((acc["left"] - 1).alias("left"), F.concat(acc["s"], p["y"]).alias("s"))).when((acc["left"] < 0) & (p["x"] == p["y"]), F.struct((acc["left"] + 1).alias("left"), F.concat(acc["s"], move(p["x"])).alias("s"))).otherwise(F.struct(acc["left"].alias("left"), F.concat(acc["s"], p["x"]).alias("s")))
        return F.aggregate(F.zip_with(t["a"], t["b"], lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.struct((want - same).cast("int").alias("left"), F.lit("").alias("s")), step)["s"]

    return seq.let(F.struct(seq.chars(target).alias("a"), seq.chars(guide).alias("b")), edit)


def direction_free_auroc(df: DataFrame, classes: str, features: list[str]) -> DataFrame:
    """class, feature, auroc: of each feature for one class against the rest, max(a, 1 - a)."""
    from siftline.operators.metrics import auroc

    long = df.select(classes, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([classes], features, "feature", "x").where("x is not null")
    names = df.select(classes).where(F.col(classes).isNotNull()).distinct().withColumnRenamed(classes, "class")
    wide = long.join(F.broadcast(names))  # a row for each of a few classes
    a = auroc(wide.withColumn("pos", F.col(classes) == F.col("class")), ["class", "feature"], "x", F.col("pos"))
    return a.select("class", "feature", F.greatest(F.col("auroc"), 1 - F.col("auroc")).alias("auroc"))


def seed_density(hits: DataFrame, by: list[str], i: str, j: str, m: str, length: int, radius: int) -> DataFrame:
    """by, i, j, box: how many perfect seeds (m = length) lie in the square around each perfect seed."""
    from siftline.operators.windows import box_sum

    return box_sum(hits.where(F.col(m) == length).withColumn("__one", F.lit(1)), by, i, j, "__one", radius)


def share_below(a: Column | str, start: Column, n: Column | int) -> Column:
    """Share of an array's entries that lie below the mean of its window of n from ``start``."""
    n = F.lit(n) if isinstance(n, int) else n
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v)
    return seq.let(F.struct(seq.col(a).alias("a"), seq.ratio(total(F.slice(seq.col(a), start + 1, n)), n).alias("m")), lambda t: seq.ratio(F.size(F.filter(t["a"], lambda x: x < t["m"])).cast("double"), F.size(t["a"])))


def gold_slot(candidates: DataFrame, gold: DataFrame, on: list[str], slot: str) -> DataFrame:
    """gold with the least candidate slot of equal coordinates, -1 without one."""
    found = candidates.groupBy(*on).agg(F.min(slot).alias("__s"))
    return gold.join(found, on, "left").withColumn(slot, F.coalesce("__s", F.lit(-1))).drop("__s")


def must_join(left: DataFrame, right: DataFrame, on: list[str], message: str) -> DataFrame:
    """left with the row of right of its key; running it raises where there is none."""
    from siftline.operators.validate import refuse

    both = left.join(right.withColumn("__found", F.lit(True)), on, "left")
    return refuse(both, F.col("__found").isNull(), message).drop("__found")


def slice_audit(claims: DataFrame, sources: DataFrame, on: list[str], s: str, lo: str, hi: str, claimed: str) -> DataFrame:
    """claims with ``problems`` (array of codes, empty for a good one): no source, out of its range, or a
    slice that is not the claimed letters on either strand. Those with problems are the quarantine."""
    from siftline.functions.arrays import reasons

    both = claims.join(sources.select(*on, s), on, "left")
    cut_ = seq.slice_at(s, F.col(lo), F.col(hi) - F.col(lo))
    bad = (F.col(lo) < 0) | (F.col(hi) > F.length(s)) | (F.col(hi) <= F.col(lo))
    problems = reasons(no_source=F.col(s).isNull(), out_of_range=bad, other_letters=~bad & (seq.canonical_strand(cut_) != seq.canonical_strand(claimed)))
    return both.withColumn("problems", problems).drop(s)


def exact_extension(nc: Column | str, flank: Column | str, i: Column, f: Column, length: Column | int, most: int = 30) -> Column:
    """struct(left, right): how many letters the exact match of a hit goes on before and after its window, at most ``most``."""
    n = F.lit(length) if isinstance(length, int) else length
    run = lambda a, b: F.length(F.regexp_extract(F.array_join(F.zip_with(seq.chars(a), seq.chars(b), lambda x, y: F.when(x == y, "1").otherwise("0")), ""), "^1*", 0))
    before = F.least(i, f, F.lit(most))
    after = F.least(F.length(seq.col(nc)) - i - n, F.length(seq.col(flank)) - f - n, F.lit(most))
    back = lambda s, at: F.reverse(seq.slice_at(s, at - before, before))
    return F.struct(run(back(nc, i), back(flank, f)).alias("left"), run(seq.slice_at(nc, i + n, after), seq.slice_at(flank, f + n, after)).alias("right"))


def with_flanks(sites: DataFrame, new: DataFrame, key: list[str], flank: str, evidence: str) -> DataFrame:
    """sites with the flanks of ``new`` (key, flank): of equal length, or running it raises; ``evidence``
    says from then on that the flank is a conditional null."""
    from siftline.operators.validate import refuse

    both = sites.join(large(new.select(*key, F.col(flank).alias("__new"))), key)
    both = refuse(both, F.length("__new") != F.length(flank), "a flank of another length")
    return both.withColumns({flank: F.col("__new"), evidence: F.lit("conditional_null")}).drop("__new")


def shuffled_around(df: DataFrame, key: list[str], s: str, lo: Column, n: Column, seed: int) -> DataFrame:
    """``s`` with the letters outside [lo, lo + n) dealt anew, left and right apart, in hash order: that of
    :func:`seq.hash_uniform` of key and place, whose eight hex digits sort as its number does."""
    def deal(part: Column, side: str) -> Column:
        named = F.concat_ws("::", F.lit(f"{side}{seed}"), *[F.col(c).cast("string") for c in key], F.lit(""))
        marked = lambda name: F.transform(seq.chars(part), lambda c, i: F.struct(F.substring(F.md5(F.concat(name, i.cast("string"))), 1, 8).alias("u"), i.alias("i"), c.alias("c")))
        return F.array_join(F.transform(F.sort_array(seq.let(named, marked)), lambda x: x["c"]), "")

    left, right = seq.slice_at(s, F.lit(0), lo), F.substring(F.col(s), (lo + n + 1).cast("int"), F.length(s))
    return df.withColumn(s, F.concat(deal(left, "l"), seq.slice_at(s, lo, n), deal(right, "r")))


def replicated(df: DataFrame, key: list[str], n: int, make) -> DataFrame:
    """``make`` (rows with a column ``replicate`` that is part of their key) for replicates 1 .. n in one plan."""
    return make(df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n)))), [*key, "replicate"])


RUNS = r"\(+|\)+"


def molecule_summary(values: Column | str, brackets: Column | str, energy: Column, least_energy: Column) -> Column:
    """struct(unpaired, helices, stability): share of values of 0.5 or more, runs of equal brackets, 1 - energy / least."""
    share = seq.ratio(F.size(F.filter(seq.col(values), lambda x: x >= 0.5)).cast("double"), F.size(seq.col(values)))
    return F.struct(share.alias("unpaired"), F.regexp_count(seq.col(brackets), F.lit(RUNS)).alias("helices"), (1 - seq.ratio(energy, least_energy)).alias("stability"))


def genbank(df: DataFrame, name: str, s: str, features: str) -> DataFrame:
    """value: flat records for a text sink: locus, features array<struct<lo, hi, label>>, sequence in lines of 60."""
    lines = F.array_join(F.transform(F.col(features), lambda f: F.concat(F.lit("     misc_feature    "), (f["lo"] + 1).cast("string"), F.lit(".."), f["hi"].cast("string"), F.lit('\n                     /label="'), f["label"], F.lit('"\n'))), "")
    rows = F.regexp_extract_all(F.lower(F.col(s)), F.lit(".{1,60}"), F.lit(0))
    body = F.array_join(F.transform(rows, lambda r, i: F.concat(F.lpad((60 * i + 1).cast("string"), 9, " "), F.lit(" "), F.rtrim(F.regexp_replace(r, "(.{10})", "$1 ")), F.lit("\n"))), "")
    return df.select(F.concat(F.lit("LOCUS       "), F.col(name), F.lit(" "), F.length(s).cast("string"), F.lit(" bp    DNA\nFEATURES             Location/Qualifiers\n"), lines, F.lit("ORIGIN\n"), body, F.lit("//")).alias("value"))
