"""Rank metrics, resampling, calibration and null models."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.functions.seq import hash_uniform
from siftline.operators.exact import binomial_tail, clopper_pearson
from siftline.operators.windows import running
from siftline.session import GROUPED, cut, large, ship, tasks_for


def auroc(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Midrank AUROC (ties count half) from counts per distinct score; null for one class. ``by`` may be empty."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    won = running(counts, by, [score], F.col("n")).withColumn("won", F.col("p") * (F.col("__sum") - F.col("n") / 2))
    total = won.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return total.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auroc"))


def stratified_auroc(df: DataFrame, score: str, positive: Column, group: str) -> DataFrame:
    """All positives against the negatives of one group at a time."""
    groups = df.where(~positive).select(group).distinct()
    pos = df.where(positive).drop(group).crossJoin(F.broadcast(groups))  # one row for each of a few groups
    both = pos.withColumn("__pos", F.lit(True)).unionByName(df.where(~positive).withColumn("__pos", F.lit(False)))
    return auroc(both, [group], score, F.col("__pos"))


def hanley_mcneil(rates: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """auroc with a normal-approximation interval, clipped to [0, 1]."""
    a, n, m = F.col("auroc"), F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    se = F.sqrt(F.greatest((a * (1 - a) + (n - 1) * (q1 - a * a) + (m - 1) * (q2 - a * a)) / (n * m), F.lit(0.0)))
    return rates.withColumns({"lo": F.greatest(a - z * se, F.lit(0.0)), "hi": F.least(a + z * se, F.lit(1.0))})


def average_precision(df: DataFrame, by: list[str], score: str, positive: Column, tie: str) -> DataFrame:
    """Mean over positives of the precision at their place; ``tie`` orders equal scores."""
    at = running(df.withColumn("__p", positive), by, [F.desc(score), tie], F.col("__p").cast("int"))
    return at.where("__p").groupBy(*by).agg(F.avg(F.col("__sum") / F.col("__place")).alias("ap"), F.count(F.lit(1)).alias("n_pos"))


def expected_ranks(df: DataFrame, by: str, score: str, gold: Column, ks: list[int]) -> DataFrame:
    """Rank, recall at k and reciprocal rank of the gold row, in expectation over random tie-breaking."""
    own = Window.partitionBy(by)
    g = F.max(F.when(gold, F.col(score))).over(own)
    n = df.withColumn("__g", g).groupBy(by).agg(F.count_if(F.col(score) > F.col("__g")).alias("above"), (F.count_if(F.col(score) == F.col("__g")) - 1).alias("tied"), F.max("__g").alias("__g")).where("__g is not null")
    span = F.col("tied") + 1
    mrr = F.aggregate(F.sequence(F.lit(1), span.cast("int")), F.lit(0.0), lambda t, i: t + 1 / (F.col("above") + i)) / span
    recall = lambda k: F.greatest(F.least(F.lit(k) - F.col("above"), span), F.lit(0)) / span
    return n.select(by, (F.col("above") + 1 + F.col("tied") / 2).alias("rank"), mrr.alias("mrr"), *[recall(k).alias(f"recall_{k}") for k in ks])


def _numbered(units: DataFrame, by: list[str], key: str) -> DataFrame:
    """``units`` (distinct in by and key) with __i, a number from 0 in the order of ``key``, and __n, how many there are; written."""
    return cut(running(units, by, [key]).withColumn("__i", F.col("__place") - 1).drop("__place", "__sum"), "units")


def _picked(n_boot: int, numbered: DataFrame, by: list[str], seed: int) -> DataFrame:
    """by, __b, __i: a row for each draw. A draw is md5 of (b, place) scaled to the unit's number, so any engine repeats it."""
    slots = numbered.select(*by, "__i", "__n", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("__b"))
    pick = F.floor(hash_uniform("__b", "__i", *by, salt=str(seed)) * F.col("__n"))
    return slots.select(*by, "__b", F.coalesce(pick.cast("long"), F.lit(0)).alias("__i"))  # never null, or joins would test the hash before they make it


def draws(n_boot: int, units: DataFrame, key: str, seed: int, by: list[str] | None = None) -> DataFrame:
    """by, __b, key, times: how often each unit is drawn in each of n_boot resamples of as many units
    with replacement."""
    by = by or []
    numbered = _numbered(units.select(*by, key).distinct(), by, key)
    drawn = _picked(n_boot, numbered, by, seed).groupBy(*by, "__b", "__i").agg(F.count(F.lit(1)).alias("times"))
    return drawn.join(numbered.drop("__n"), [*by, "__i"]).select(*by, "__b", key, "times")


def drawn_facts(n_boot: int, numbered: DataFrame, facts: DataFrame, seed: int, by: list[str]) -> DataFrame:
    """__b and the columns of ``facts`` (by, __i and others) once for each draw of its unit. Draws move once, to the tasks
    that hold so many units each; they are neither sorted nor counted first, since nearly all are distinct."""
    n = tasks_for(numbered, GROUPED)
    on = [*by, "__i"]
    drawn = _picked(n_boot, numbered.repartition(n, *on), by, seed).repartition(n, *on)
    return drawn.join(facts.repartition(n, *on).hint("shuffle_hash"), on)


def bootstrap_ratio(facts: DataFrame, unit: str, num: Column, den: Column, n_boot: int = 200, seed: int = 0, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """sum(num) / sum(den) with a percentile interval from resampling whole units (clusters)."""
    by = by or []
    sums = facts.groupBy(*by, unit).agg(F.sum(num).cast("double").alias("num"), F.sum(den).cast("double").alias("den"))
    sums = _numbered(sums, by, unit)
    known = sums.where(F.col(unit).isNotNull()).select(*by, "__i", "num", "den")  # no unit is drawn by a null name
    per = drawn_facts(n_boot, sums, known, seed, by).groupBy(*by, "__b").agg((F.sum("num") / F.sum("den")).alias("ratio"))
    ci = per.groupBy(*by).agg(F.percentile("ratio", F.lit([alpha / 2, 1 - alpha / 2])).alias("ci"))
    point = sums.groupBy(*by).agg((F.sum("num") / F.sum("den")).alias("ratio"), F.count(F.lit(1)).alias("n_units"))
    joined = point.join(ci, by) if by else point.crossJoin(ci)
    return joined.select(*by, "n_units", "ratio", F.col("ci")[0].alias("lo"), F.col("ci")[1].alias("hi"))


def _solved(df: DataFrame, keys: list[str], names: list[str], f) -> DataFrame:
    """keys (long) and double columns ``names`` of the distinct keys, from arrays of a batch at a time."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            found = f(*[batch.column(k).to_numpy() for k in range(len(keys))])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.float64()) for x in found)], [*keys, *names])

    distinct = df.select(*[F.col(c).cast("long").alias(c) for c in keys]).dropna().distinct()
    return distinct.mapInArrow(run, ", ".join([f"`{c}` bigint" for c in keys] + [f"{c} double" for c in names]))


def with_interval(df: DataFrame, k: str, n: str, alpha: float = 0.05) -> DataFrame:
    """Adds lo, hi (Clopper-Pearson) of k of n: distinct pairs are solved once each, many at a time, and the work
    does not depend on n."""
    return df.join(_solved(df, [k, n], ["lo", "hi"], lambda a, b: clopper_pearson(a, b, alpha)), [k, n])


def tail_table(pairs: DataFrame, length: str, m: str, p: float = 0.25) -> DataFrame:
    """P(Bin(length, p) >= m) of each distinct (length, m)."""
    return _solved(pairs, [length, m], ["tail"], lambda n, k: [binomial_tail(k, n, p)])


def fp_profile(units: DataFrame, family: str, layers: list[str]) -> DataFrame:
    """family, layer, n, passed, rate, lo, hi: how many units (a row each) of a family get through each of the
    boolean columns ``layers``, with exact intervals; a null layer is not passed."""
    counts = units.groupBy(family).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(c) for c in layers])
    rows = counts.select(family, "n", F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("passed")) for c in layers])).alias("l")).select(family, "l.layer", "n", "l.passed")
    return with_interval(rows, "passed", "n").select(family, "layer", "n", "passed", (F.col("passed") / F.col("n")).alias("rate"), "lo", "hi")


def worst_family(swept: DataFrame, keys: list[str], family: str) -> DataFrame:
    """keys, worst_family, worst_hi: of every setting of a sweep (keys, family, n, fired) the family whose share
    may be highest, by the upper end of its exact interval (the least name on ties)."""
    bound = with_interval(swept, "fired", "n")
    worst = F.min_by(F.struct(F.col(family).alias("f"), F.col("hi").alias("hi")), F.struct(-F.col("hi"), F.col(family))).alias("w")
    return bound.groupBy(*keys).agg(worst).select(*keys, F.col("w.f").alias("worst_family"), F.col("w.hi").alias("worst_hi"))


def variant_score(peaks: DataFrame, truth: DataFrame, negatives: DataFrame, variant: str, bag: str, pos: str, length: str) -> DataFrame:
    """The full score of each variant, a row each. ``peaks``: variant, bag, pos, length; ``truth``: bag, gold, gold_length
    (all positive bags); ``negatives``: variant, family, n, fired (a sweep). coverage: bags with a peak; ppv_peak and
    ppv_bag: peaks that overlap the gold window by half of the union, and bags of those with peaks that have such a
    one, with exact intervals; exact_peaks: peaks at the gold place; near_bags: bags whose nearest peak is at most
    one off; worst_family and worst_hi over the negatives, and selection, the larger the better."""
    gold = truth.select(bag, "gold", "gold_length")
    p, g = F.col(pos), F.col("gold")
    both = F.greatest(F.lit(0), F.least(p + F.col(length), g + F.col("gold_length")) - F.greatest(p, g))
    right = 2 * both >= F.col(length) + F.col("gold_length") - both
    away = F.abs(p - g)
    bags = peaks.join(gold, bag).groupBy(variant, bag).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"), F.count_if(away == 0).alias("exact"), F.min(away).alias("away"))
    total = gold.select(bag).distinct().agg(F.count(F.lit(1)).alias("n_bags"))
    found = bags.groupBy(variant).agg(F.count(F.lit(1)).alias("detected"), F.sum("n").alias("n_peaks"), F.sum("right").alias("right_peaks"), F.count_if(F.col("right") > 0).alias("right_bags"), F.sum("exact").alias("exact_peaks"), F.count_if(F.col("away") <= 1).alias("near_bags"))
    zero = ["detected", "n_peaks", "right_peaks", "right_bags", "exact_peaks", "near_bags"]
    rows = worst_family(negatives, [variant], "family").join(found, variant, "left").crossJoin(F.broadcast(total)).withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    rows = with_interval(rows, "right_peaks", "n_peaks").withColumnsRenamed({"lo": "ppv_peak_lo", "hi": "ppv_peak_hi"})
    rows = with_interval(rows, "right_bags", "detected").withColumnsRenamed({"lo": "ppv_bag_lo", "hi": "ppv_bag_hi"})
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select(
        variant, "n_bags", "detected", share("detected", "n_bags").alias("coverage"), "n_peaks", share("right_peaks", "n_peaks").alias("ppv_peak"), "ppv_peak_lo", "ppv_peak_hi",
        share("right_bags", "detected").alias("ppv_bag"), "ppv_bag_lo", "ppv_bag_hi", "exact_peaks", "near_bags", "worst_family", "worst_hi", (-F.col("worst_hi")).alias("selection"),
    )


def e_values(tails: Column, flank_starts: Column, nc_positions: Column, orients: Column) -> dict[str, Column]:
    """Three expectations that must stay apart: per position, global, and of one record (no orientations)."""
    return {"e_position": tails * flank_starts * orients, "e_global": tails * flank_starts * orients * nc_positions, "e_record": tails * flank_starts * nc_positions}


def poisson_binomial_tail(ps: Column | str, k: int) -> Column:
    """P(at least k of independent events): exact, by an array of the distribution so far up to k."""
    start = F.lit([1.0] + [0.0] * k)
    step = lambda acc, p: F.transform(acc, lambda x, i: x * F.when(i == k, 1.0).otherwise(1 - p) + F.when(i > 0, F.get(acc, i - 1) * p).otherwise(0.0))
    return F.get(F.aggregate(F.col(ps) if isinstance(ps, str) else ps, start, step), k)


def threshold_for(df: DataFrame, condition: str, unit: str, score: str, target: float) -> DataFrame:
    """The smallest observed score that at most ``target`` of any condition's units exceed; pass rates are of > threshold.
    Each condition allows its own scores from some place on, and the threshold is the largest of those places."""
    per = df.groupBy(condition).agg(F.count(F.lit(1)).alias("n"))
    counts = df.where(F.col(score).isNotNull()).groupBy(condition, score).agg(F.count(F.lit(1)).alias("c"))
    above = running(counts, [condition], [F.desc(score)], F.col("c")).drop("__n").join(per, condition)
    own = above.where(F.col("__sum") - F.col("c") <= target * F.col("n")).groupBy(condition).agg(F.min(score).alias("own"))
    threshold = own.agg((F.max("own") if target < 1 else F.min("own")).alias("threshold"))
    rates = df.crossJoin(F.broadcast(threshold)).groupBy(condition, "threshold").agg((F.count_if(F.col(score) > F.col("threshold")) / F.count(F.lit(1))).alias("rate"))  # one row
    return rates.where("threshold is not null").agg(F.first("threshold", True).alias("threshold"), F.max("rate").alias("worst_rate"))


def leave_one_out(df: DataFrame, x: str) -> DataFrame:
    """Mean, and the deviation (n - 1) and largest drop of the means without one row each, in closed form."""
    total = df.agg(F.sum(x).alias("s"), F.count(x).alias("n"), F.avg(x).alias("mean"))
    loo = df.select(F.col(x).alias("x")).where("x is not null").join(F.broadcast(total)).select("mean", ((F.col("s") - F.col("x")) / (F.col("n") - 1)).alias("loo"))
    return loo.agg(F.first("mean").alias("mean"), F.stddev_samp("loo").alias("loo_std"), F.max(F.col("mean") - F.col("loo")).alias("max_drop"))


def importance_weights(source: DataFrame, target: DataFrame, cell: list[str], laplace: float = 1.0) -> DataFrame:
    """cell, n, weight: smoothed ratio of the target's share of a cell to the source's."""
    a, b = (df.groupBy(*cell).agg(F.count(F.lit(1)).alias(n)) for df, n in ((source, "n"), (target, "m")))
    cells = a.join(b, cell, "full").select(*cell, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    total = cells.agg(F.sum("n").alias("tn"), F.sum("m").alias("tm"), F.count(F.lit(1)).alias("k"))
    w = ((F.col("m") + laplace) / (F.col("tm") + laplace * F.col("k"))) / ((F.col("n") + laplace) / (F.col("tn") + laplace * F.col("k")))
    return cells.crossJoin(F.broadcast(total)).select(*cell, "n", w.alias("weight"))


def effective_size(weights: DataFrame) -> DataFrame:
    """(sum w)^2 / sum w^2 over rows, from cells with their counts."""
    return weights.agg((F.pow(F.sum(F.col("n") * F.col("weight")), 2) / F.sum(F.col("n") * F.pow("weight", F.lit(2)))).alias("ess"), F.sum("n").alias("n"))


def empirical_tail(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, x, p = (1 + #>=x) / (1 + N), and ln(1 / p)."""
    counts = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy(*by).agg(F.sum("c").alias("total"))
    tails = running(counts, by, [F.desc(x)], F.col("c"))
    p = (1 + F.col("__sum")) / (1 + F.col("total"))
    return (tails.join(total, by) if by else tails.crossJoin(total)).select(*by, x, p.alias("p"), (-F.log(p)).alias("log_inverse"))


def cohens_d(df: DataFrame, x: str, first: Column) -> DataFrame:
    """Difference of means over the root of the mean of the two population variances."""
    a, b = F.when(first, F.col(x)), F.when(~first, F.col(x))
    return df.agg(((F.avg(a) - F.avg(b)) / F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)).alias("d"), F.count(a).alias("n_a"), F.count(b).alias("n_b"))


def platt(df: DataFrame, score: str, positive: Column) -> tuple[float, float]:
    """Slope and intercept of a one-feature logistic fit; (1, 0) for one class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(F.col(score).cast("double").alias("x"), positive.cast("double").alias("label")).where("x is not null and label is not null")
    if rows.select("label").distinct().count() < 2:
        return 1.0, 0.0
    fitted = LogisticRegression(regParam=0.0, maxIter=100, tol=1e-9).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))
    return float(fitted.coefficients[0]), float(fitted.intercept)


def fused(ps: list[Column], tau: float = 1.0) -> dict[str, Column]:
    """Fusion of probabilities: sum of log-sigmoids of logits, least, and a soft least."""
    logit = [F.log(p / (1 - p)) for p in ps]
    return {
        "raw_and": reduce(lambda a, b: a + b, [-F.log1p(F.exp(-x)) for x in logit]),
        "hard_min": F.least(*ps),
        "soft_min": -tau * F.log(reduce(lambda a, b: a + b, [F.exp(-x / tau) for x in logit])),
    }


def rank_vs_replicates(real: DataFrame, replicates: DataFrame, by: list[str], x: str) -> DataFrame:
    """Share of replicates below (ties half), difference from their mean, and z (null without spread)."""
    both = real.select(*by, F.col(x).alias("x")).join(replicates.select(*by, F.col(x).alias("r")), by)
    out = both.groupBy(*by, "x").agg(F.avg((F.col("r") < F.col("x")).cast("double") + 0.5 * (F.col("r") == F.col("x")).cast("double")).alias("rank"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
    return out.select(*by, "x", "rank", (F.col("x") - F.col("m")).alias("delta"), F.when(F.col("sd") > 0, (F.col("x") - F.col("m")) / F.col("sd")).alias("z"))


def mean_difference(df: DataFrame, unit: str, a: str, b: str, n_boot: int = 200, seed: int = 0) -> DataFrame:
    """Paired mean difference with a percentile interval from resampling units."""
    return bootstrap_ratio(df, unit, F.col(a) - F.col(b), F.lit(1), n_boot, seed).withColumnRenamed("ratio", "delta")



def nested_bootstrap(draws_table: DataFrame, unit: str, draw: str, num: str, den: str, n_inner: int, n_boot: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """ratio, lo, hi: units are resampled, and each drawn unit takes one of its n_inner scored draws
    (unit, draw 0 .. n_inner - 1, num, den)."""
    outer = draws(n_boot, draws_table.select(unit), unit, seed)
    copies = outer.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    inner = copies.withColumn(draw, F.floor(hash_uniform("__b", unit, "copy", salt=f"inner{seed}") * n_inner).cast("int"))
    per = inner.join(draws_table.withColumn(draw, F.col(draw).cast("int")), [unit, draw]).groupBy("__b").agg((F.sum(num) / F.sum(den)).alias("r"))
    point = draws_table.agg((F.sum(num) / F.sum(den)).alias("ratio"))
    ci = per.agg(F.percentile("r", F.lit([alpha / 2, 1 - alpha / 2])).alias("ci"))
    return point.crossJoin(ci).select("ratio", F.col("ci")[0].alias("lo"), F.col("ci")[1].alias("hi"))


def auroc_delta(scores: DataFrame, by: list[str], unit: str, a: str, b: str, positive: str, n_boot: int = 200, seed: int = 0) -> DataFrame:
    """by, delta (AUROC of a minus that of b on the same units), lo, hi: positives and negatives are
    resampled apart, both models on the same draw."""
    numbered = _numbered(scores.select(*by, positive, unit).distinct(), [*by, positive], unit)
    facts = scores.join(large(numbered), [*by, positive, unit]).select(*by, positive, "__i", a, b)
    drawn = drawn_facts(n_boot, numbered, facts, seed, [*by, positive])
    kinds = F.array(*[F.struct(F.lit(k).alias("__k"), F.col(c).cast("double").alias("__s")) for k, c in enumerate((a, b))])
    # both scores from one pass: draws are counted by score before they move
    seen = drawn.select(*by, "__b", F.col(positive).alias("__pos"), F.explode(kinds).alias("s")).groupBy(*by, "__b", "s.__k", "s.__s").agg(F.count_if(F.col("__pos")).alias("p"), F.count_if(~F.col("__pos")).alias("n"))
    own = Window.partitionBy(*by, "__b", "__k")
    below = F.coalesce(F.sum("n").over(own.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = seen.withColumn("won", F.col("p") * (below + F.col("n") / 2)).groupBy(*by, "__b", "__k").agg(F.sum("won").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    auc = lambda k: F.max(F.when(F.col("__k") == k, F.try_divide(F.col("w"), F.col("p").cast("double") * F.col("n"))))
    per = won.groupBy(*by, "__b").agg((auc(0) - auc(1)).alias("d")).groupBy(*by).agg(F.percentile("d", F.lit([0.025, 0.975])).alias("ci"))
    point = auroc(scores, by, a, F.col(positive)).withColumnRenamed("auroc", "x").join(auroc(scores, by, b, F.col(positive)).select(*by, F.col("auroc").alias("y")), by)
    return point.join(per, by).select(*by, (F.col("x") - F.col("y")).alias("delta"), F.col("ci")[0].alias("lo"), F.col("ci")[1].alias("hi"))


def decision_gate(a: DataFrame, b: DataFrame, unit: str, hit: str, least_shared: int = 20, cutoff: float = 0.5) -> DataFrame:
    """One row: shared units, rates, discordant counts, and which of two detectors fires less (locked:
    the interval of the paired difference leaves out 0 and not both rates are high)."""
    both = a.select(unit, F.col(hit).cast("double").alias("x")).join(b.select(unit, F.col(hit).cast("double").alias("y")), unit)
    facts = both.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("rate_a"), F.avg("y").alias("rate_b"), F.count_if(F.col("x") > F.col("y")).alias("only_a"), F.count_if(F.col("y") > F.col("x")).alias("only_b"))
    delta = mean_difference(both, unit, "x", "y").select("delta", "lo", "hi")
    out = facts.crossJoin(delta)
    why = F.when(F.col("n") < least_shared, "too_few_shared").when((F.col("rate_a") > cutoff) & (F.col("rate_b") > cutoff), "both_high").when((F.col("lo") <= 0) & (F.col("hi") >= 0), "undecided").when(F.col("delta") > 0, "b_lower").otherwise("a_lower")
    return out.withColumn("verdict", why).withColumn("locked", F.col("verdict").isin("a_lower", "b_lower"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's coefficient, with mean ranks for ties: ranks come from counts per distinct value."""
    rows = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y")), "pairs")

    def ranks(c: str) -> DataFrame:
        counts = running(rows.groupBy(c).agg(F.count(F.lit(1)).alias("c")), [], [c], F.col("c"))
        return counts.select(c, (F.col("__sum") - F.col("c") + (F.col("c") + 1) / 2).alias(f"r{c}"))

    return rows.join(ranks("x"), "x").join(ranks("y"), "y").agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def two_samples(df: DataFrame, x: str, first: Column) -> DataFrame:
    """Kolmogorov-Smirnov statistic and Mann-Whitney U of two samples, from counts per distinct value."""
    counts = cut(df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b")), "values")
    upto = running(counts, [], ["x"], F.col("a")).withColumnRenamed("__sum", "a_upto").drop("__place", "__n")
    upto = running(upto, [], ["x"], F.col("b"))
    total = F.broadcast(counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))  # one row
    gap = F.abs(F.try_divide(F.col("a_upto"), F.col("ta")) - F.try_divide(F.col("__sum"), F.col("tb")))
    return upto.join(total).agg(F.max(gap).alias("ks"), F.sum(F.col("a") * (F.col("__sum") - F.col("b") + F.col("b") / 2)).alias("u"))


def cross_validated_auroc(df: DataFrame, key: str, features: list[str], positive: str, folds: int = 5, seed: int = 0, model: str = "logistic", block: str | None = None) -> DataFrame:
    """fold, n_pos, n_neg, auroc of held-out scores of a logistic model or boosted ``trees``; folds are
    hashes of ``block`` (whole groups; of ``key`` unless given); one-class folds are null."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.withColumn("label", F.col(positive).cast("double")).withColumn("fold", F.floor(hash_uniform(block or key, salt=str(seed)) * folds).cast("int")).na.drop(subset=[*features, "label"])
    rows = cut(rows.select("fold", "label", *features), "folds")  # every fit and every step of it reads these again
    steps = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), GBTClassifier(maxIter=10, maxDepth=3, seed=seed) if model == "trees" else LogisticRegression(regParam=0.01)])
    out = None
    for fold in range(folds):
        train = rows.where(F.col("fold") != fold)
        if train.select("label").distinct().count() < 2:
            continue
        scored = steps.fit(train).transform(rows.where(F.col("fold") == fold)).select("fold", "label", vector_to_array("probability")[1].alias("score"))
        part = auroc(scored, ["fold"], "score", F.col("label") == 1)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "fold int, n_pos bigint, n_neg bigint, auroc double")


def coherence_permutation(hits: DataFrame, bag: str, site: str, key: str, n_perm: int, seed: int = 0) -> DataFrame:
    """perm, s, n: how many (bag, key) have hits in at least s sites, for the real bags (perm 0) and
    for sites dealt anew to bags of the same sizes in hash order."""
    sites = hits.select(bag, site).distinct()
    slots = running(sites, [], [bag, site]).withColumnRenamed("__place", "__k")
    perms = sites.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    dealt = running(perms, ["perm"], [hash_uniform("perm", bag, site, salt=str(seed)), bag, site]).withColumnRenamed("__place", "__k")
    moved = dealt.join(slots.select("__k", F.col(bag).alias("__to")), "__k").select("perm", bag, site, "__to")
    every = hits.join(moved, [bag, site]).select("perm", F.col("__to").alias("g"), F.concat_ws("|", bag, site).alias("s"), key).unionByName(hits.select(F.lit(0).alias("perm"), F.col(bag).alias("g"), F.concat_ws("|", bag, site).alias("s"), key))
    support = every.groupBy("perm", "g", key).agg(F.countDistinct("s").alias("support"))
    steps = support.withColumn("s", F.explode(F.sequence(F.lit(1).cast("long"), F.least("support", F.lit(5)))))
    return steps.groupBy("perm", "s").agg(F.count(F.lit(1)).alias("n"))


def probes(df: DataFrame, key: str, features: list[str], label: str, folds: int, steps: int = 25, ridge: float = 0.0, seed: int = 0) -> DataFrame:
    """feature, fold, intercept, slope, n_pos, n_neg, auroc: a one-feature logistic regression for every feature and
    fold (of the hash of ``key``), fitted on the other folds and judged on the fold. Fits of one class are left out.

    All fits take their Newton steps together: a step is one aggregation of the gradient and the curvature by
    (feature, fold) over the rows, which meet the coefficients as they stand (a row for each fit, broadcast), and a
    2 x 2 system solved in columns. Features are standardised over all rows first. Steps end when no
    coefficient moves by 1e-10; ``ridge`` / 2 times slope squared is added to the mean loss."""
    spark = df.sparkSession
    fold = F.floor(hash_uniform(key, salt=str(seed)) * folds).cast("int")
    moments = df.select(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in features for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    scaled = [F.struct(F.lit(c).alias("feature"), ((F.col(c).cast("double") - F.lit(moments[f"{c}_m"])) / F.lit(moments[f"{c}_s"] or 1.0)).alias("x")) for c in features]
    rows = df.where(F.col(label).isNotNull()).select(fold.alias("own"), F.col(label).cast("double").alias("y"), F.explode(F.array(*scaled)).alias("f")).select("own", "y", "f.*").where("x is not null")
    rows = cut(rows, "probes")
    two = rows.groupBy("feature", "own").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    fits = two.alias("a").join(two.alias("b"), (F.col("a.feature") == F.col("b.feature")) & (F.col("a.own") != F.col("b.own")))
    fits = fits.groupBy(F.col("a.feature").alias("feature"), F.col("a.own").alias("fold")).agg(F.sum("b.p").alias("p"), F.sum("b.n").alias("n")).where("p > 0 and p < n").collect()
    at = {(r.feature, r.fold): (0.0, 0.0) for r in fits}
    schema = "feature string, fold int, b0 double, b1 double"
    table = lambda: spark.createDataFrame([(*k, *v) for k, v in at.items()], schema)
    for _ in range(steps if at else 0):
        q = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col("x"))))
        w = q * (1 - q)
        terms = {"g0": F.col("y") - q, "g1": (F.col("y") - q) * F.col("x"), "h0": w, "h1": w * F.col("x"), "h2": w * F.col("x") * F.col("x")}
        sums = rows.join(F.broadcast(table()), "feature").where("own != fold").groupBy("feature", "fold", "b0", "b1").agg(*[F.avg(c).alias(n) for n, c in terms.items()])
        g1, h2 = F.col("g1") - ridge * F.col("b1"), F.col("h2") + ridge
        det = F.col("h0") * h2 - F.col("h1") * F.col("h1")
        moved = sums.select("feature", "fold", ((h2 * F.col("g0") - F.col("h1") * g1) / det).alias("d0"), ((F.col("h0") * g1 - F.col("h1") * F.col("g0")) / det).alias("d1")).collect()
        for r in moved:
            b0, b1 = at[r.feature, r.fold]
            at[r.feature, r.fold] = b0 + (r.d0 or 0.0), b1 + (r.d1 or 0.0)
        if all(abs(r.d0 or 0) < 1e-10 and abs(r.d1 or 0) < 1e-10 for r in moved):
            break
    fitted = table()
    scored = rows.join(F.broadcast(fitted.withColumnRenamed("fold", "own")), ["feature", "own"]).withColumn("score", F.col("b0") + F.col("b1") * F.col("x"))
    rates = auroc(scored.withColumnRenamed("own", "fold"), ["feature", "fold"], "score", F.col("y") == 1)
    return fitted.join(rates, ["feature", "fold"]).select("feature", "fold", F.col("b0").alias("intercept"), F.col("b1").alias("slope"), "n_pos", "n_neg", "auroc")
