"""Quality classifier with hierarchical empirical Bayes over sites (operator 6).

Method: a document's own evidence is a log-likelihood ratio of good against bad, from a logistic
model of the words and of the shape (shares of capitals, signs, distinct words and so on) of its
whole text. Sites are hosts and, within them, paths. All documents' rates (labels where there are
any, classifier probabilities else) are added up by path, host and in all; a host's rate is shrunk to
the global one and a path's to its host's, by pseudo-counts that the method of moments takes from how
far the groups' rates differ. So a sparse site keeps its prior, and a document's final probability is
its evidence on top of what the rest of its path (the document itself left out) says. ``documents``
has no URL: op6_quality and the pipeline pass ``source`` for the host and ``lang`` for the path.

The logistic model is fitted on at most ``sample`` labelled documents (those whose ids hash lowest;
the bound is a parameter), on the ``FEATURES`` features that tell the classes apart best. Everything
else covers all documents. Texts are not shuffled: a row for each document is.

Cases: null and empty texts have only shape features; a null host or path is a site of its own;
labels with a null id or quality don't count, null toxic counts as 0, of several labels of one id the
worst holds; without labels of both classes the evidence is 0; repeated rows are judged apart; an empty
table gives an empty result; extra columns are left out by ``judge`` and kept as they are by ``accept``,
whatever their names; texts are judged whole, a batch of about 2 MB (or one longer text) at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.textops import Counts, Lookup, U, content_keys, mix, slices, words
from siftline.session import cut, free_name, ship

SAMPLE, FEATURES, LEAST_DF, LEAST_Z = 20_000, 4096, 5, 2.5
_BYTES = np.arange(256)
_UPPER, _LOWER, _DIGIT = ((_BYTES >= a) & (_BYTES <= b) for a, b in ((65, 90), (97, 122), (48, 57)))
_LETTER = _UPPER | _LOWER | (_BYTES >= 128)
_LINE = _BYTES == 10
_SPACE = np.isin(_BYTES, [32, *range(9, 14)])
_SIGN = ~(_LETTER | _DIGIT | _SPACE)
_BETWEEN = ~(_LETTER | _DIGIT)


def _shares(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(kind[data])])
    return total[offsets[1:]] - total[offsets[:-1]]


def shapes(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """[row, feature]: keys of a document's shape features, each a number in steps."""
    n = len(offsets) - 1
    upper, letter, digit, sign, line = (_shares(data, offsets, k) for k in (_UPPER, _LETTER, _DIGIT, _SIGN, _LINE))
    size, n_words = np.diff(offsets), np.bincount(row, minlength=n)
    first = np.searchsorted(row, np.arange(n + 1))
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:])])
    per = lambda a, b: a / np.maximum(b, 1)
    steps = [20 * per(upper, letter), 40 * per(sign, size), 40 * per(digit, size), 10 * per(distinct, n_words), per(letter, n_words), 10 * per(sign, n_words), np.log2(n_words + 1), 20 * per(line, n_words)]
    return np.stack([mix(np.minimum(s, 63).astype(U) + U((i + 1) << 32)) for i, s in enumerate(steps)], 1)


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (word hashes and shape features) and rows, words perhaps repeated."""
    h, row = words(data, offsets, _BETWEEN)
    shape = shapes(data, offsets, h, row)
    return np.concatenate([h, shape.ravel()]).view(np.int64), np.concatenate([row, np.repeat(np.arange(len(shape)), shape.shape[1])])


def _once(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])]) if len(keys) else np.zeros(0, bool)
    return keys[new], row[new]


def fit(labelled: DataFrame) -> dict:
    """A logistic model from (__text, good) rows, which are few (a bounded sample)."""
    spark = labelled.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {False: Counts(), True: Counts()}
        for batch in batches:
            for rows, data, offsets in slices(batch):
                good = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
                keys, row = _once(*_keys(data, offsets))
                for kind, own in counts.items():
                    own.add(*np.unique(keys[good[row] == kind], return_counts=True))
        for kind, own in counts.items():
            keys, n = own.total()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n if kind else n * 0), pa.array(n * 0 if kind else n)], ["key", "good", "bad"])

    n_good, n_bad = (int(x or 0) for x in labelled.agg(F.count_if("good"), F.count_if(~F.col("good"))).first())
    if not n_good or not n_bad:
        return {"keys": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": 0.0}
    df = labelled.mapInArrow(count, "key bigint, good bigint, bad bigint").groupBy("key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    a, b, c, d = (F.col("good") + 0.5, F.lit(n_good + 0.5) - F.col("good"), F.col("bad") + 0.5, F.lit(n_bad + 0.5) - F.col("bad"))
    z = F.abs(F.log(a * d / (b * c))) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    chosen = df.where(F.col("good") + F.col("bad") >= LEAST_DF).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "key").limit(FEATURES).toPandas()
    keys = chosen["key"].to_numpy(np.int64)
    at = spark.sparkContext.broadcast(Lookup(keys, np.arange(len(keys), dtype=np.float64)))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                found, row = _keys(data, offsets)
                place = at.value.get(found, -1.0).astype(np.int64)
                place, row = _once(place[place >= 0], row[place >= 0])
                first = np.searchsorted(row, np.arange(rows.num_rows + 1))
                yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(np.split(place, first[1:-1]), pa.list_(pa.int64()))], ["good", "at"])

    rows = labelled.mapInArrow(sparse, "good boolean, at array<bigint>").toPandas()
    size = np.array([len(x) for x in rows["at"]])
    row, col = np.repeat(np.arange(len(rows)), size), np.concatenate([*rows["at"], np.zeros(0, np.int64)]).astype(np.int64)
    y = rows["good"].to_numpy(float)
    weight = np.where(y == 1, 0.5 / n_good, 0.5 / n_bad)  # both classes count alike: the result is a likelihood ratio
    weights, bias, speed, move, move_bias = np.zeros(len(keys)), 0.0, 2.0, np.zeros(len(keys)), 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[col], len(rows)) + bias, -30, 30)))
        error = weight * (y - p)
        move = 0.9 * move + np.bincount(col, error[row], len(keys)) - 2e-5 * weights
        move_bias = 0.9 * move_bias + error.sum()
        weights, bias = weights + speed * move, bias + speed * move_bias
    return {"keys": keys, "weights": weights, "bias": bias}


def evidence(docs: DataFrame, fitted: dict, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with llr: the log-likelihood ratio of good against bad of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast((Lookup(fitted["keys"], fitted["weights"]), fitted["bias"]))
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, bias = held.value
        for batch in batches:
            for rows, data, offsets in slices(batch):
                keys, row = _keys(data, offsets)
                w = lookup.get(keys, np.nan)
                known = ~np.isnan(w)
                keys, row = _once(keys[known], row[known])
                llr = np.bincount(row, lookup.get(keys, 0.0), rows.num_rows) + bias
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(llr)], [*keep, "llr"])

    return docs.select(F.col(text_col).alias("__text"), *keep).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "llr double"]))


def _pseudo_count(groups: DataFrame, rate: str, prior: str) -> float:
    """How many documents a group's prior rate is worth: the m (1 to 10000) at which the spread of the
    groups' rates around their priors is what a beta distribution of weight m and binomial draws give."""
    m = F.col(prior)
    spread, drawn, expected = groups.where("n > 1").agg(F.sum(F.col("n") * F.pow(F.col(rate) - m, 2)), F.sum(m * (1 - m)), F.sum(m * (1 - m) * F.col("n"))).first()
    if not expected:
        return 10.0
    share = ((spread or 0) - drawn) / max(expected - drawn, 1e-12)  # 1 / (m + 1)
    return min(max(1 / share - 1, 1.0), 10_000.0) if share > 0 else 10_000.0


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | str = "source", path: Column | str = "lang", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """id_col, evidence, site_rate, score (probability of good), accepted of every document."""
    return _judged(docs, labels, id_col, text_col, host, path, sample, threshold).select(F.col("doc").alias(id_col), "evidence", "site_rate", "score", "accepted")


def accept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | str = "source", path: Column | str = "lang", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The documents that :func:`judge` accepts, with all columns of ``docs`` as they are. A decision
    depends on id, text, host and path alone, so rows are found again by a 128-bit hash of these,
    which is the same however a scan is dealt out."""
    accepted = _judged(docs, labels, id_col, text_col, host, path, sample, threshold).where("accepted").select("k1", "k2").distinct()
    names = free_name(docs.columns, "k1"), free_name(docs.columns, "k2")
    keys = content_keys(F.col(id_col), F.col(text_col), _column(host), _column(path))
    return docs.withColumns(dict(zip(names, keys))).join(accepted.toDF(*names), list(names), "left_semi").select(docs.columns)


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def site_of(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without www.) and path (its first step, within the host) of a URL column;
    null where there is no host."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return host, F.when(host.isNotNull(), F.concat(host, F.lit("/"), F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/*([^/]*)/", 1)))


def shrunk(site: DataFrame) -> DataFrame:
    """(host, path, n, s, host_rate, weight) of each path, of rows (host, path, p): documents, the sum of
    their rates, the host's posterior rate, and the pseudo-count that this prior is worth for the path."""
    paths = cut(site.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = min(max(s / n, 1e-3), 1 - 1e-3) if n else 0.5
    of_hosts = _pseudo_count(hosts.withColumn("rate", F.col("s") / F.col("n")).withColumn("prior", F.lit(mean)), "rate", "prior")
    hosts = hosts.select("host", ((F.col("s") + of_hosts * mean) / (F.col("n") + of_hosts)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    of_paths = _pseudo_count(paths.withColumn("rate", F.col("s") / F.col("n")), "rate", "host_rate")
    return paths.withColumn("weight", F.lit(of_paths))


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host: Column | str, path: Column | str, sample: int, threshold: float) -> DataFrame:
    """doc, k1, k2, evidence, site_rate, score, accepted of every row. Names inside are this function's own, so none can clash."""
    spark = docs.sparkSession
    ship(spark)
    good = ((F.col("quality") >= 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").alias("label"), good).groupBy("label").agg(F.min("good").alias("good"))
    few = known.orderBy(F.xxhash64("label"), "label").limit(sample)
    # of documents that share an id one learns, so that the sample keeps its bound
    learn = docs.select(F.col(text_col).alias("__text"), F.col(id_col).alias("__id")).join(F.broadcast(few), F.col("__id") == F.col("label")).groupBy("label").agg(F.min("__text").alias("__text"), F.min("good").alias("good"))
    fitted = fit(cut(learn.select("__text", "good"), "learning"))
    where = _column(host).cast("string"), _column(path).cast("string")
    k1, k2 = content_keys(F.col(id_col), F.col(text_col), _column(host), _column(path))
    base = docs.select(F.col(text_col).alias("body"), F.col(id_col).alias("doc"), k1.alias("k1"), k2.alias("k2"), where[0].alias("host"), where[1].alias("path"))
    scored = evidence(base, fitted, "body", ["doc", "k1", "k2", "host", "path"]).withColumns({c: F.coalesce(c, F.lit("\0")) for c in ("host", "path")})
    share = known.agg(F.avg(F.col("good").cast("double"))).first()[0]
    share = min(max(0.5 if share is None else share, 0.01), 0.99)
    p = F.coalesce(F.col("good").cast("double"), 1 / (1 + F.exp(-F.greatest(F.least(F.col("llr") + math.log(share / (1 - share)), F.lit(30.0)), F.lit(-30.0)))))
    rates = cut(scored.join(known, F.col("doc") == F.col("label"), "left").select("doc", "k1", "k2", "host", "path", "llr", p.alias("p")), "rates")
    rate = F.greatest(F.least((F.col("s") - F.col("p") + F.col("weight") * F.col("host_rate")) / (F.col("n") - 1 + F.col("weight")), F.lit(0.99)), F.lit(0.01))
    out = rates.join(shrunk(rates), ["host", "path"]).withColumn("site_rate", rate)
    score = 1 / (1 + F.exp(-F.greatest(F.least(F.col("llr") + F.log(F.col("site_rate") / (1 - F.col("site_rate"))), F.lit(30.0)), F.lit(-30.0))))
    return out.select("doc", "k1", "k2", F.col("llr").alias("evidence"), "site_rate", score.alias("score")).withColumn("accepted", F.col("score") >= threshold)
