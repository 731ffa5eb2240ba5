"""Approximate nearest neighbours by cosine with an adaptive dimension scan (operator 1).

Method: unit vectors are dealt to the lists of an inverted file and all turned by one random rotation,
so that any leading block of dimensions is a fair sample of a distance. A query scans its probed lists
in column blocks: after d of D dimensions a candidate whose partial squared distance p fails the test
p D / d <= c(d) r is abandoned, r being the query's k-th smallest squared distance so far and c(d) the
critical value that all but ``ALPHA`` of near pairs of the fitting sample meet at d. While many pairs of
a chunk are alive, the next columns are multiplied for all its rows that any query still wants; then for
the pairs that are left alone. The ``SEED`` nearest lists are scanned first; what they give is the r
with which the other probed lists begin. Survivors are scored on the original vectors in double precision.

The index is written once: a row per block (at most about ``block`` vectors of one list), which holds ids,
vectors and rotated vectors as bytes. The queries among a block's rows are written beside it, a row for
each list that any of them probes. A task compares one block with one group of about ``group`` queries,
whatever the sizes of lists, and passes on k rows a query; so a block moves once for each group of
queries of its list, and a query once for each block that it probes.

The fit takes the ``sample`` rows of least hash (at most 16384; every row is indexed): centroids (the
square root of the rows, at most ``MAX_LISTS``), critical values, and the number of lists to probe, which
is what ``REACH`` of the sample's own neighbours need; all are broadcast. Vectors of each length are
indexed apart.

Cases: vectors that are null, zero, empty or hold null or non-finite components take no part, nor do
rows without an id; repeated rows count once; a query is not its own candidate; ties go to the
smaller id; fewer candidates than k are all returned if their lists are probed; an empty table gives an
empty result; extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.llm.bitslice import finite, ranked
from siftline.session import cut, ship

SAMPLE, MAX_LISTS, BLOCK, GROUP = 16384, 2048, 65536, 8192
REACH, ALPHA, STEP, CHUNK, SEED, DENSE = 0.975, 0.003, 16, 1024, 4, 0.2
NEAR = 5  # neighbours of a sample row on which the fit's shares are measured
ASKED = 256  # sample rows that ask


def unit(x: np.ndarray) -> np.ndarray:
    """Rows by their length; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Fit:
    rotation: np.ndarray
    centroids: np.ndarray
    critical: np.ndarray  # for each number of columns read
    probes: int
    share: np.ndarray  # the largest part of all rows that a list should hold


def to_lists(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Half squared distances, but for what is the same for all lists."""
    return (centroids * centroids).sum(1) / 2 - x @ centroids.T


def fit(x: np.ndarray, lists: int, probes: int | None = None, rounds: int = 8, seed: int = 7) -> Fit:
    rng = np.random.default_rng(seed)
    dims = x.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    x = unit(x) @ rotation
    centroids = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = to_lists(x, centroids).argmin(1)
        size = np.bincount(own, minlength=len(centroids))
        order = np.argsort(own, kind="stable")
        begin = np.cumsum(size) - size
        total = np.add.reduceat(x[order], begin[size > 0])
        centroids[size > 0] = total / size[size > 0, None]
    own = to_lists(x, centroids).argmin(1)
    size = np.bincount(own, minlength=len(centroids))
    asked = rng.choice(len(x), min(ASKED, len(x)), replace=False)
    away = np.maximum(2 - 2 * x[asked] @ x.T, 0)
    away[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(away, 1)[:, : max(0, min(NEAR, len(x) - 1))]
    pair = np.repeat(np.arange(len(asked)), near.shape[1]), near.ravel()
    place = np.argsort(np.argsort(to_lists(x[asked], centroids), 1), 1)[pair[0], own[pair[1]]]
    needed = int(np.quantile(place, REACH)) + 1 if len(place) else len(centroids)
    steps = [min(d + STEP, dims) for d in range(0, dims, STEP)]
    part = np.cumsum(np.square(x[asked][pair[0]] - x[pair[1]]), 1)
    full = np.maximum(part[:, -1:], 1e-12) if len(part) else np.ones((0, 1))
    ratio = part[:, [d - 1 for d in steps]] / full * dims / np.array(steps)
    critical = np.quantile(ratio, 1 - ALPHA, axis=0) if len(ratio) else np.full(len(steps), np.inf)
    critical[-1] = 1 + 1e-6
    return Fit(rotation, centroids, critical, min(len(centroids), probes or max(needed, SEED)), (size + 3 * np.sqrt(size) + 3) / len(x))


def scan(q: np.ndarray, x: np.ndarray, k: int, r2: np.ndarray, critical: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, row) pairs that the tests have not abandoned, of rotated unit vectors ``q`` and ``x``, and
    how many products were made. ``r2``: squared distances beyond which a query needs nothing (inf: not
    known yet)."""
    dims, found, made = x.shape[1], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))], 0
    best = np.repeat(r2[:, None].astype(np.float32), k, 1)
    at, size = 0, 64 if np.isinf(r2).any() else CHUNK
    while at < len(x):
        rows = np.arange(at, min(at + size, len(x)))
        at, size = at + len(rows), CHUNK
        r = best.max(1)
        dense, partial = True, np.zeros((len(q), len(rows)), np.float32)
        for c, d in enumerate(range(0, dims, STEP)):
            a, b = q[:, d : d + STEP], x[:, d : d + STEP]
            bound = critical[c] * r * (min(d + STEP, dims) / dims) + 1e-6
            if dense:
                own = b[rows]
                partial += (a * a).sum(1)[:, None] + (own * own).sum(1) - 2 * a @ own.T
                made += own.size * len(q)
                alive = partial <= bound[:, None]
                some = alive.any(0)
                if not some.all():
                    rows, partial, alive = rows[some], partial[:, some], alive[:, some]
                if alive.sum() <= DENSE * alive.size or d + STEP >= dims:
                    dense = False
                    i, j = np.nonzero(alive)
                    p, j = partial[i, j], rows[j]
            else:
                away = a[i] - b[j]
                made += away.size
                p = p + np.einsum("ij,ij->i", away, away)
                left = p <= bound[i]
                i, j, p = i[left], j[left], p[left]
            if not dense and not len(i):
                break
        if len(i):
            order = np.lexsort((p, i))
            i, j, p = i[order], j[order], p[order]
            found.append((i, j, p))
            place = np.arange(len(i)) - np.searchsorted(i, i)
            new = np.full((len(q), k), np.inf, np.float32)
            new[i[place < k], place[place < k]] = p[place < k]
            best = np.partition(np.concatenate([best, new], 1), k - 1, axis=1)[:, :k]
    i, j, p = (np.concatenate(f) for f in zip(*found))
    left = p <= best.max(1)[i] * (1 + 1e-4) + 1e-5
    return i[left], j[left], made


INDEX = "asks boolean, list bigint, rb bigint, src bigint, phase int, n bigint, ids binary, v binary, turned binary"


def _index(rows: DataFrame, fitted: Fit, n: int, kind: type, block: int) -> DataFrame:
    """A row per block of a list (asks false), and for each list that queries among its rows probe one
    with these queries (asks true; src: the block they are from; phase 0 for the nearest lists)."""
    held = rows.sparkSession.sparkContext.broadcast(fitted)
    blocks = np.maximum(1, np.ceil(fitted.share * n / block)).astype(np.int64)

    def dealt(batches):
        own = held.value
        for batch in batches:
            if len(batch):
                near = to_lists(unit(np.stack(batch["v"].to_list()).astype(np.float64)) @ own.rotation, own.centroids).argmin(1)
                yield batch.assign(list=near, rb=batch["h"].to_numpy() % blocks[near])

    def built(x: pd.DataFrame) -> pd.DataFrame:
        own = held.value
        x = x.sort_values("id")
        v = np.stack(x["v"].to_list()).astype(kind)
        turned = (unit(v.astype(np.float64)) @ own.rotation).astype(np.float32)
        ids, here, rb = x["id"].to_numpy(np.int64), int(x["list"].iloc[0]), int(x["rb"].iloc[0])
        src = here << 32 | rb
        out = [(False, here, rb, src, 0, len(ids), ids.tobytes(), v.tobytes(), turned.tobytes())]
        asked = np.flatnonzero(x["q"].to_numpy(bool))
        if len(asked):
            probed = np.argsort(to_lists(turned[asked], own.centroids), 1, kind="stable")[:, : own.probes]
            for phase, part in ((0, probed[:, :SEED]), (1, probed[:, SEED:])):
                to = part.ravel()
                order = np.argsort(to, kind="stable")
                to, who = to[order], asked[np.repeat(np.arange(len(asked)), part.shape[1])[order]]
                edge = np.flatnonzero(np.diff(to, prepend=-1))
                for a, b in zip(edge, [*edge[1:], len(to)]):
                    w = who[a:b]
                    out.append((True, int(to[a]), -1, src, phase, len(w), ids[w].tobytes(), v[w].tobytes(), turned[w].tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in INDEX.split(", ")])

    spread = rows.select("id", "v", "q", F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)).alias("h"))
    kinds = dict(spread.dtypes)
    dealt_rows = spread.mapInPandas(dealt, f"id bigint, v {kinds['v']}, q boolean, h bigint, list bigint, rb bigint").drop("h")
    return dealt_rows.groupBy("list", "rb").applyInPandas(built, INDEX)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, lists: int | None = None, probes: int | None = None, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, id_col, score (cosine of the original vectors): the k nearest found of each query."""
    spark = vectors.sparkSession
    ship(spark)
    x = F.col(vector_col)
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    usable = finite(x) & F.exists(x, lambda v: v != 0) & F.col(id_col).isNotNull()
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), (x if single else x.cast("array<double>")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    found = None
    for dim, n in rows.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():  # lengths of vectors, not rows
        own = rows.where(F.size("v") == dim)
        chosen = own.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(min(sample, SAMPLE)).toPandas()
        fitted = fit(np.stack(chosen["v"].to_list()).astype(np.float64), lists or min(MAX_LISTS, int(np.ceil(np.sqrt(n)))), probes)
        kind = np.float32 if single else np.float64
        index = cut(_index(own.groupBy("id", "v").agg(F.max("q").alias("q")), fitted, n, kind, block), "index")
        blocks, asks = index.where(~F.col("asks")), index.where("asks")
        near = cut(_searched(blocks, asks.where("phase = 0").withColumn("reach", F.lit(None).cast("array<struct<id:bigint,r2:double>>")), fitted.critical, kind, dim, k, group), "near")
        best = near.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("n") == k)
        reach = best.groupBy("src").agg(F.collect_list(F.struct(F.col("query_id").alias("id"), F.greatest(2 - 2 * F.col("score"), F.lit(0.0)).alias("r2"))).alias("reach"))
        rest = asks.where("phase = 1").join(reach, "src", "left")
        part = near.unionByName(_searched(blocks, rest, fitted.critical, kind, dim, k, group)).drop("src")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id bigint, id bigint, score double")
    return ranked(found, k, id_col)


def _searched(blocks: DataFrame, asks: DataFrame, critical: np.ndarray, kind: type, dim: int, k: int, group: int) -> DataFrame:
    """(src, query_id, id, score): the k nearest that each query finds in each block of its lists."""
    # a row for each list, of which there are at most MAX_LISTS
    sizes = blocks.groupBy("list").agg(F.count(F.lit(1)).alias("blocks"))
    asked = asks.groupBy("list").agg(F.ceil(F.sum("n") / F.lit(group)).alias("groups"))
    grid = F.broadcast(sizes.join(asked, "list"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = blocks.join(grid, "list").select("list", "rb", upto("groups").alias("qb"), "ids", "v", "turned")
    own = blocks.select("list", "rb")
    right = asks.join(grid, "list").select("list", F.pmod(F.xxhash64("src"), F.col("groups")).alias("qb"), "src", "ids", "v", "turned", "reach").join(own, "list").select("list", "rb", "qb", "src", "ids", "v", "turned", "reach")
    right = right.toDF(*right.columns)  # both sides come from one table

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"src": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        for at in range(len(a)):
            ids, v, turned = (np.frombuffer(a[c].iloc[at], t) for c, t in (("ids", np.int64), ("v", kind), ("turned", np.float32)))
            own, turned = v.reshape(-1, dim), turned.reshape(-1, dim)
            for src, q_ids, q_v, q_turned, reach in zip(b["src"], b["ids"], b["v"], b["turned"], b["reach"]):
                query, asked = np.frombuffer(q_ids, np.int64), np.frombuffer(q_v, kind).reshape(-1, dim)
                q_turned, r2 = np.frombuffer(q_turned, np.float32).reshape(-1, dim), np.full(len(query), np.inf)
                if reach is not None:
                    known = {r["id"]: r["r2"] for r in reach}
                    r2 = np.array([known.get(i, np.inf) for i in query.tolist()])
                for lo in range(0, len(query), 512):
                    part = slice(lo, lo + 512)
                    i, j, _ = scan(q_turned[part], turned, k + 1, r2[part], critical)
                    i = i + lo
                    other = ids[j] != query[i]
                    i, j = i[other], j[other]
                    x, y = own[j].astype(np.float64), asked[i].astype(np.float64)
                    score = np.einsum("ij,ij->i", x, y) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                    if not np.isfinite(score).all():  # squares out of range
                        score = np.einsum("ij,ij->i", unit(x), unit(y))
                    order = np.lexsort((ids[j], -score, i))
                    i, j, score = i[order], j[order], score[order]
                    top = np.arange(len(i)) - np.searchsorted(i, i) < k
                    out.append(pd.DataFrame({"src": src, "query_id": query[i][top], "id": ids[j][top], "score": score[top]}))
        return pd.concat(out)

    keys = ["list", "rb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "src bigint, query_id bigint, id bigint, score double")
