"""Joins that a plain equi-join does not express by itself. All are equi-joins underneath; range
conditions get a bucket key, so that no plan falls back to a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.session import GROUPED, tasks_for


def resolve_unique(requests: DataFrame, candidates: DataFrame, on: list[str], identity: list[str]) -> DataFrame:
    """Each request with the one candidate of its key: status matched, missing or ambiguous, and the
    candidate's ``identity`` columns where there is just one. Candidates equal in ``identity`` are one."""
    found = candidates.groupBy(*on).agg(F.countDistinct(*identity).alias("n_matches"), *[F.min(c).alias(c) for c in identity])
    n = F.coalesce("n_matches", F.lit(0))
    one = n == 1
    status = F.when(n == 0, "missing").when(one, "matched").otherwise("ambiguous")
    return requests.join(found, on, "left").select(*requests.columns, status.alias("status"), n.alias("n_matches"), *[F.when(one, F.col(c)).alias(c) for c in identity])


def audit_chain(start: DataFrame, hops: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Follows left joins hop by hop; ``failure`` names the first hop that finds nothing, else ok.
    A hop's table must have one row for each key (checked by the caller or made so)."""
    out, tests = start, []
    for name, right, on in hops:
        out = out.join(right.withColumn(f"__{name}", F.lit(True)), on, "left")
        tests.append((name, F.col(f"__{name}").isNull()))
    failure = F.coalesce(*[F.when(test, F.lit(f"fail:{name}")) for name, test in tests], F.lit("ok"))
    return out.withColumn("failure", failure).drop(*[f"__{name}" for name, _, _ in hops])


def having_all(facts: DataFrame, parent: str, child: str, required: DataFrame) -> DataFrame:
    """Relational division: parents that have every required child. Facts are dealt by parent, so many to a task."""
    need = required.select(child).distinct()
    facts = facts.select(parent, child).repartition(tasks_for(facts, GROUPED), parent)
    n = need.agg(F.count(F.lit(1)).alias("__need"))
    held = facts.join(need, child, "left_semi").groupBy(parent).agg(F.countDistinct(child).alias("n_held"))
    return held.join(F.broadcast(n), F.col("n_held") == F.col("__need")).drop("__need")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], least: float, width: float, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Pairs on equal keys whose intervals [lo, hi) share at least ``least``. Intervals are dealt to
    buckets of ``width``; a pair is made in the bucket where its overlap begins, once. Columns of the
    two sides are prefixed l_ and r_; rows with null keys or bounds, or hi <= lo, find nothing."""
    def dealt(df: DataFrame, side: str) -> DataFrame:
        ok = df.where((F.col(hi) > F.col(lo)) & F.col(lo).isNotNull())
        b = F.explode(F.sequence(F.floor(F.col(lo) / width), F.ceil(F.col(hi) / width) - 1))
        return ok.select(*[F.col(c).alias(f"{side}_{c}") for c in ok.columns], *[F.col(c).alias(f"__{c}") for c in on], b.alias("__b"))

    a, b = dealt(left, "l"), dealt(right, "r")
    begin, end = F.greatest(f"l_{lo}", f"r_{lo}"), F.least(f"l_{hi}", f"r_{hi}")
    keys = [*(f"__{c}" for c in on), "__b"]
    return a.join(b, keys).where((F.floor(begin / width) == F.col("__b")) & (end - begin >= least) & (end > begin)).withColumn("overlap", end - begin).drop(*keys)


def next_above(left: DataFrame, right: DataFrame, on: list[str], value: str, take: list[str]) -> DataFrame:
    """For each left row the right row of its key with the least value >= its own, else the one of
    the greatest value: a sort-merge of the two sides in one window, without pairs."""
    right = right.groupBy(*on, value).agg(*[F.min(c).alias(c) for c in take])
    both = left.withColumn("__left", F.lit(True)).unionByName(right.select(*on, value, F.struct(value, *take).alias("__hit")), allowMissingColumns=True)
    down = Window.partitionBy(*on).orderBy(F.desc(value), F.col("__left").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.last("__hit", ignorenulls=True).over(down)
    most = F.max("__hit").over(Window.partitionBy(*on))
    got = both.withColumn("__got", F.coalesce(hit, most)).where("__left")
    return got.select(*left.columns, F.col(f"__got.{value}").alias(f"next_{value}"), *[F.col(f"__got.{c}").alias(c) for c in take])


def pivot_pair(facts: DataFrame, keys: list[str], side: str, values: tuple[str, str], take: str, order: Column) -> DataFrame:
    """Rows of the two sides of a key side by side; of several the last in ``order``; both must exist."""
    last = lambda v: F.max_by(F.when(F.col(side) == v, F.col(take)), F.when(F.col(side) == v, order))
    return facts.where(F.col(side).isin(*values)).groupBy(*keys).agg(*[last(v).alias(v) for v in values]).where(F.col(values[0]).isNotNull() & F.col(values[1]).isNotNull())


def pairs_within(df: DataFrame, group: list[str], key: str, take: list[str], most: int = 5000) -> DataFrame:
    """Unordered pairs a < b of rows of a group. Groups of more than ``most`` rows are dealt to blocks,
    each pair of blocks to a task of its own. For analyses whose result is these pairs: where only near
    ones count, see :func:`near_pairs`."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    dealt = df.withColumn("__blocks", F.ceil(n / most)).withColumn("__b", F.pmod(F.xxhash64(key), F.col("__blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))
    side = lambda s, own, other: dealt.select(*group, F.col(key).alias(f"{key}_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in take], F.col("__b").alias(own), every.alias(other))
    return side("a", "__x", "__y").join(side("b", "__y", "__x"), [*group, "__x", "__y"]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).drop("__x", "__y")


def near_pairs(df: DataFrame, group: list[str], key: str, value: str, within: float) -> DataFrame:
    """Unordered pairs a < b (by key) of rows of a group whose values differ by ``within`` at most: values
    are bucketed by it, and a row meets its own bucket and the next."""
    bucket = F.floor(F.col(value) / within)
    a = df.select(*group, F.col(key).alias("__k"), F.col(value).alias("__v"), F.explode(F.array(bucket, bucket + 1)).alias("__at"), bucket.alias("__own"))
    b = df.select(*group, F.col(key).alias("__l"), F.col(value).alias("__w"), bucket.alias("__at"))
    met = a.join(b, [*group, "__at"]).where((F.abs(F.col("__v") - F.col("__w")) <= within) & ((F.col("__own") < F.col("__at")) | (F.col("__k") < F.col("__l"))) & (F.col("__k") != F.col("__l")))
    low = F.col("__k") < F.col("__l")
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    return met.select(*group, pick("__k", "__l").alias(f"{key}_a"), pick("__l", "__k").alias(f"{key}_b"), pick("__v", "__w").alias(f"{value}_a"), pick("__w", "__v").alias(f"{value}_b"))


def suffix_pairs(scores: DataFrame, key: str, score: str, suffix: str) -> DataFrame:
    """Rows of ``key`` with those of ``key + suffix``: key, positive, negative, delta."""
    neg = scores.select(F.col(key).alias("__k"), F.col(score).alias("negative"))
    out = scores.select(F.col(key), F.concat(F.col(key), F.lit(suffix)).alias("__k"), F.col(score).alias("positive")).join(neg, "__k")
    return out.select(key, "positive", "negative", (F.col("positive") - F.col("negative")).alias("delta"))


def outer_status(asked: DataFrame, on: str, passed: DataFrame, failed: DataFrame) -> DataFrame:
    """PASS, FAIL or UNSCORED of each asked key, by two lookups; PASS wins."""
    p, f = (x.select(on).distinct().withColumn(n, F.lit(True)) for x, n in ((passed, "__p"), (failed, "__f")))
    status = F.when(F.col("__p"), "SCORED_PASS").when(F.col("__f"), "SCORED_FAIL").otherwise("UNSCORED")
    return asked.join(p, on, "left").join(f, on, "left").withColumn("status", status).drop("__p", "__f")


def nearest_in_range(left: DataFrame, right: DataFrame, on: list[str], value: str, within: float, order: list[Column], take: list[str]) -> DataFrame:
    """A tolerant match: of right rows with equal keys and a value within ``within``, the first in
    ``order``. Values are bucketed by the tolerance; a left row looks in three buckets."""
    row = left.withColumn("__row", F.monotonically_increasing_id())
    a = row.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.floor(F.col(value) / within) + o)))
    b = right.select(*on, F.floor(F.col(value) / within).alias("__b"), F.col(value).alias(f"match_{value}"), *take)
    found = a.join(b, [*on, "__b"]).where(F.abs(F.col(value) - F.col(f"match_{value}")) <= within)
    best = F.row_number().over(Window.partitionBy("__row").orderBy(*order))
    return found.withColumn("__n", best).where("__n = 1").drop("__n", "__b", "__row")


def audited_alleles(audit: DataFrame, alleles: DataFrame, locus: str = "locus_id_full", keep: list[str] = []) -> DataFrame:  # noqa: B006
    """keep, locus, status, longest, shortest: the longest and shortest allele (name of least order on ties) of every
    audited locus, named ``panel/dir|locus``. ``alleles`` (locus_id, allele, sequence) lies in folders panel=/dir=; of
    these only such are read as the audit names, since both join keys are partition columns and the audit is
    the pruning side. status: malformed (no such name), missing (no allele), single (one length), resolved."""
    part = lambda k: F.regexp_extract(locus, r"^([^/|]+)/([^|]+)\|(.+)$", k)
    asked = audit.select(*keep, F.col(locus), part(1).alias("panel"), part(2).alias("dir"), part(3).alias("locus_id"))
    wanted = asked.where("locus_id <> ''").select("panel", "dir", "locus_id").distinct()
    n = F.length("sequence")
    order = lambda size: F.struct(size.alias("n"), F.col("allele").alias("a"))
    pick = F.struct("allele", F.upper("sequence").alias("sequence"))
    found = alleles.join(wanted, ["panel", "dir", "locus_id"]).groupBy("panel", "dir", "locus_id").agg(F.min_by(pick, order(-n)).alias("longest"), F.min_by(pick, order(n)).alias("shortest"), (F.max(n) > F.min(n)).alias("differ"))
    status = F.when(F.col("locus_id") == "", "malformed").when(F.col("differ").isNull(), "missing").when(F.col("differ"), "resolved").otherwise("single")
    return asked.join(found, ["panel", "dir", "locus_id"], "left").select(*keep, locus, status.alias("status"), "longest", "shortest")
