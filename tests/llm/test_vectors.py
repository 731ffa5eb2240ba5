"""Exact search and nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import ann, bitslice


@pytest.fixture(params=["true", "false"])
def coalescing(spark, request):
    """Few partitions hide keys that do not meet: both ways must give the same."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield
    spark.conf.set(key, old)


def vectors(spark, n=400, dims=12, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dims))
    x[5] = x[10] = x[15]  # ties
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    rows += [(n, None, "x"), (n + 1, [1.0, None], "x"), (n + 2, [float("nan")] * dims, "x"), (None, [1.0] * dims, "x"), (3, x[3].tolist(), "again")]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")


def test_exact_top_k(spark, coalescing):
    x, df = vectors(spark)
    ints = np.floor(256 * x).astype(np.int64)
    found = bitslice.top_k(df, F.col("vec_id") % 20 == 0, block=50, group=3).toPandas()
    assert len(found) == 100
    for query, part in found.sort_values("rank").groupby("query_id"):
        score = ints @ ints[query]
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != query][:5]
        assert part["vec_id"].tolist() == order and part["score"].tolist() == score[order].tolist()


def hits_of(found, x, k=5):
    """How many of the returned are as near as the k-th nearest; scores must be the cosines."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for query, part in found.groupby("query_id"):
        score = unit @ unit[query]
        score[query] = -2
        assert len(part) == k and query not in set(part["vec_id"]) and part.sort_values("rank")["score"].is_monotonic_decreasing
        assert np.allclose(part["score"], score[part["vec_id"]], atol=1e-12)
        hits += (part["score"] >= np.sort(score)[-k] - 1e-12).sum()
    return hits / len(found)


def test_neighbours(spark, coalescing):
    x, df = vectors(spark)
    found = ann.neighbours(df, F.col("vec_id") % 20 == 0, probes=10, lists=10, block=50, group=3).toPandas()
    assert len(found) == 100 and hits_of(found, x) >= 0.95


def test_ties_go_to_the_smaller_id(spark):
    x = np.random.default_rng(8).standard_normal((60, 8))
    x[20:40] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.neighbours(df, F.col("vec_id") == 30, probes=8, block=7).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [20, 21, 22, 23, 24]


def test_recall_of_the_registered_query(spark):
    from siftline.llm import queries

    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().set_index("vec_id").sort_index()
        assert (rows.index == np.arange(len(rows))).all()
        x = np.stack(rows["embedding"].to_list()).astype(np.float64)
        assert hits_of(queries.op1_ann(spark, folder).toPandas(), x) >= 0.9


def test_scan_abandons_early():
    """On clustered vectors far fewer products than a full scan, and nothing near is lost."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 96))
    x = ann.unit(np.repeat(centres, 100, 0) + 0.3 * rng.standard_normal((4000, 96)))
    fitted = ann.fit(x, 40)
    turned = (x @ fitted.rotation).astype(np.float32)
    asked = np.arange(0, 4000, 80)
    # as in the second phase: the nearest list has given each query a distance
    own = ann.to_lists(turned.astype(float), fitted.centroids).argmin(1)
    reach = np.array([np.sort(2 - 2 * x[a] @ x[own == own[a]].T)[min(5, (own == own[a]).sum() - 1)] for a in asked])
    i, j, made = ann.scan(turned[asked], turned, 6, reach, fitted.critical)
    assert made < 0.35 * len(asked) * x.size
    found = {(a, b) for a, b in zip(i.tolist(), j.tolist())}
    score = x[asked] @ x.T
    near = [(a, b) for a in range(len(asked)) for b in np.argsort(-score[a])[:6].tolist()]
    assert sum(p in found for p in near) >= 0.97 * len(near)
    assert fitted.probes < 20


def test_empty_and_few(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bitslice.top_k(none, F.col("vec_id") % 2 == 0).count() == 0 and ann.neighbours(none, F.col("vec_id") % 2 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (4, [])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in bitslice.top_k(two, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 0), (0, 2, 2, 0)]
    assert [tuple(r) for r in ann.neighbours(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.0)]
