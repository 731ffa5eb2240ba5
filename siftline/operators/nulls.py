"""Null models and seeded generators. Draws come from hashes of keys, so they do not depend on how
rows are dealt to tasks; the distributions, not the streams, are those of a seeded generator."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.functions.seq import hash_uniform
from siftline.operators.windows import following, running
from siftline.session import ship


def _random(*parts) -> random.Random:
    return random.Random(hashlib.sha256("::".join(map(str, parts)).encode()).digest())


def euler_shuffle(s: str, draw: random.Random) -> str:
    """A random sequence with the same first and last letters and exactly the same counts of adjacent
    pairs: a random walk over the pairs as edges, whose last exits form a tree to the last letter."""
    if len(s) < 3:
        return s
    out: dict[str, list[str]] = {}
    for a, b in zip(s, s[1:]):
        out.setdefault(a, []).append(b)
    end = s[-1]
    while True:
        last = {a: draw.choice(bs) for a, bs in out.items() if a != end}
        ok = True
        for a in last:
            seen = set()
            while a != end and a not in seen:
                seen.add(a)
                a = last.get(a, end)
            ok &= a == end
        if ok:
            break
    walk = {}
    for a, bs in out.items():
        rest = list(bs)
        if a in last:
            rest.remove(last[a])
        draw.shuffle(rest)
        walk[a] = rest + ([last[a]] if a in last else [])
    at, made = s[0], [s[0]]
    step = dict.fromkeys(walk, 0)
    for _ in range(len(s) - 1):
        b = walk[at][step[at]]
        step[at] += 1
        made.append(b)
        at = b
    return "".join(made)


def walk_shuffle(s: str, k: int, draw: random.Random) -> str:
    """A walk over (k - 1)-letter states with the sequence's own transitions; at a dead end, from anywhere."""
    if len(s) < k:
        return s
    after: dict[str, list[str]] = {}
    for i in range(len(s) - k + 1):
        after.setdefault(s[i : i + k - 1], []).append(s[i + k - 1])
    made = s[: k - 1]
    while len(made) < len(s):
        made += draw.choice(after.get(made[-(k - 1) :]) or s)
    return made


def shuffled(df: DataFrame, keys: list[str], s: str, seed: int, k: int | None = None) -> DataFrame:
    """``s`` replaced by its shuffle (exact pairs, or a walk for ``k``); the seed of a row is its keys'."""
    ship(df.sparkSession)

    def run(batches):
        for x in batches:
            made = []
            for *key, text in x[[*keys, s]].itertuples(index=False, name=None):
                draw = _random(seed, *key)
                made.append(None if text is None else euler_shuffle(text, draw) if k is None else walk_shuffle(text, k, draw))
            yield x.assign(**{s: pd.Series(made, dtype=object, index=x.index)})

    return df.mapInPandas(run, df.schema)


def rotated(df: DataFrame, by: list[str], key: str, take: str, seed: int) -> DataFrame:
    """A derangement: each row gets ``take`` of the next row of its group in hash order (alone: its own)."""
    return following(df, by, [hash_uniform(key, salt=str(seed)), key], take).withColumnRenamed("__next", f"shuffled_{take}")


def next_bags(bags: DataFrame, bag: str) -> DataFrame:
    """bag, donor: the next bag by name, the first for the last."""
    return following(bags.select(bag).distinct(), [], [bag], bag).select(bag, F.col("__next").alias("donor"))


def donor_join(df: DataFrame, bag: str, ordinal: str, take: str, donors: DataFrame) -> DataFrame:
    """Each row with ``take`` of its bag's donor bag (bag, donor), donors' rows being cycled."""
    own = Window.partitionBy(bag).orderBy(ordinal)
    rows = df.withColumn("__i", F.row_number().over(own) - 1)
    d = rows.select(F.col(bag).alias("donor"), F.col("__i").alias("__j"), F.col(take).alias(f"donor_{take}"))
    n = d.groupBy("donor").agg(F.count(F.lit(1)).alias("__n"))
    return rows.join(donors, bag).join(n, "donor").withColumn("__j", F.pmod("__i", "__n").cast("int")).join(d, ["donor", "__j"]).drop("__i", "__j", "__n")


def conditions(df: DataFrame, names: list[str]) -> DataFrame:
    """Every row once for each condition."""
    return df.withColumn("condition", F.explode(F.lit(names)))


def mixture(key: Column | str, target: Column, shares: tuple[float, float, float] = (0.86, 0.10, 0.04), seed: int = 0) -> Column:
    """target, target - 1 or target - 2 with the given shares."""
    u = hash_uniform(key, salt=str(seed))
    return F.when(u < shares[0], target).when(u < shares[0] + shares[1], target - 1).otherwise(target - 2)


def subsets(df: DataFrame, group: str, key: str, n_sets: int, least: int, most: int, seed: int = 0) -> DataFrame:
    """group, set, key: n_sets subsets of each group without replacement, of a hash-drawn size."""
    wide = df.select(group, key).distinct().withColumn("set", F.explode(F.sequence(F.lit(1), F.lit(n_sets))))
    size = F.lit(least) + F.floor(hash_uniform(group, "set", salt=f"size{seed}") * (most - least + 1))
    order = Window.partitionBy(group, "set").orderBy(hash_uniform(group, "set", key, salt=f"row{seed}"), key)
    return wide.withColumns({"__n": F.row_number().over(order), "__size": size}).where("__n <= __size").drop("__n", "__size")


def batches(df: DataFrame, stratum: str, key: str, per_batch: int, seed: int = 0) -> DataFrame:
    """batch number of each row: per_batch rows of every stratum in each batch, in hash order."""
    placed = running(df, [stratum], [hash_uniform(key, salt=str(seed)), key])
    return placed.withColumn("batch", F.floor((F.col("__place") - 1) / per_batch)).drop("__place", "__n", "__sum")


def mismatch_classes(words: DataFrame, length: str, n_mm: str, most: int = 32) -> DataFrame:
    """Of each distinct (length, n_mm) all placements of n_mm mismatches on a word of that length: length, n_mm, class
    (from 0, in the order of the places), positions. A placement grows by a later place a step, as rows."""
    grown = words.select(F.col(length).cast("int").alias(length), F.col(n_mm).cast("int").alias(n_mm)).dropna().distinct().where(F.col(n_mm).between(0, F.least(F.col(length), F.lit(most)))).withColumn("positions", F.array().cast("array<int>"))
    whole = None
    for k in range(grown.agg(F.max(n_mm)).first()[0] or 0):
        full = grown.where(F.col(n_mm) == k)
        whole = full if whole is None else whole.unionByName(full)
        last = F.coalesce(F.try_element_at("positions", F.lit(-1)), F.lit(-1))
        next_ = F.sequence(last + 1, F.col(length) - F.col(n_mm) + k)
        grown = grown.where(F.col(n_mm) > k).withColumn("__p", F.explode(next_)).withColumn("positions", F.concat("positions", F.array("__p"))).drop("__p")
    whole = grown if whole is None else whole.unionByName(grown)
    return whole.withColumn("class", F.row_number().over(Window.partitionBy(length, n_mm).orderBy("positions")) - 1).select(length, n_mm, "class", "positions")


def counterfactual(df: DataFrame, key: str, kind: str, nc: str, flank: str, lo: str, length: str, seed: int = 0) -> DataFrame:
    """A negative made from each row by one named change: orientation (the target is reverse-complemented
    in place), position (the flank is rotated by 1 to its length - 1), or target (its letters in reverse)."""
    from siftline.functions.seq import revcomp, slice_at

    n = F.length(flank)
    target = slice_at(flank, F.col(lo), F.col(length))
    put = lambda new: F.concat(slice_at(flank, 0, F.col(lo)), new, F.substring(F.col(flank), F.col(lo) + F.col(length) + 1, n))
    turn = (F.lit(1) + F.floor(hash_uniform(key, salt=str(seed)) * (n - 1))).cast("int")
    made = {"orientation": put(revcomp(target)), "position": F.concat(F.substring(F.col(flank), turn + 1, n), slice_at(flank, 0, turn)), "target": put(F.reverse(target))}
    return df.withColumn(flank, made[kind]).withColumn("negative_mode", F.lit(kind))


def broken_invariants(positive: DataFrame, negative: DataFrame, key: str, same: list[str], lengths: list[str]) -> DataFrame:
    """key, problem: where a negative changes what its kind must not change, or a length."""
    a = positive.select(key, *[F.col(c).alias(f"__{c}") for c in {*same, *lengths}])
    both = negative.join(a, key, "left")
    tests = [F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), f"changed:{c}") for c in same] + [F.when(F.length(c) != F.length(f"__{c}"), f"length:{c}") for c in lengths]
    return both.select(key, F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def target_matches(rates: DataFrame, length: str, m: str, rate: str, wanted: float, floor: float) -> DataFrame:
    """length, m: the number of matches whose rate is nearest (in ratio) to the wanted one among rates
    of at least ``floor``; without any, the one of the highest rate."""
    off = F.abs(F.log(F.col(rate) / wanted))
    return rates.groupBy(length).agg(F.coalesce(F.min_by(F.when(F.col(rate) >= floor, F.col(m)), F.when(F.col(rate) >= floor, F.struct(off, F.col(m)))), F.max_by(m, F.struct(rate, -F.col(m)))).alias(m))


def synthetic_bags(spark, n_bags: int, n_sites: int, nc_length: int, flank_length: int, target_length: int, mismatches: int, seed: int = 0) -> DataFrame:
    """bag_id, site_ord, nc, flank, planted, target_at: bags whose sites carry a copy of one nc window at
    a flank position of their own, with some letters changed. Letters and places are hashes of their
    coordinates, so a bag is the same however the range is dealt out."""
    ship(spark)

    def run(batches):
        for batch in batches:
            out = []
            for bag in batch["id"]:
                draw = _random(seed, bag)
                nc = "".join(draw.choices("ACGT", k=nc_length))
                planted = draw.randrange(nc_length - target_length + 1)
                for site in range(n_sites):
                    flank = draw.choices("ACGT", k=flank_length)
                    at = draw.randrange(flank_length - target_length + 1)
                    copy = list(nc[planted : planted + target_length])
                    for i in draw.sample(range(target_length), mismatches):
                        copy[i] = draw.choice([c for c in "ACGT" if c != copy[i]])
                    flank[at : at + target_length] = copy
                    out.append((f"bag{bag}", site, nc, "".join(flank), planted, at))
            yield pd.DataFrame(out, columns=["bag_id", "site_ord", "nc", "flank", "planted", "target_at"])

    return spark.range(n_bags).mapInPandas(run, "bag_id string, site_ord int, nc string, flank string, planted int, target_at int")
