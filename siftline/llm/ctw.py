"""Language-model scoring by context-tree weighting (operator 8).

Method: a text's UTF-8 bytes and an end mark (0xFF, which UTF-8 never holds) are each decomposed into
eight binary decisions. A tree node is a context of 0 to ``DEPTH`` bytes before the symbol (0xFF
before the beginning) with the decisions made so far; it holds the Krichevsky-Trofimov estimate of
its two counts. Weighting mixes all depths: P(node) = (KT(node) + product of P(longer contexts)) / 2,
and, given the learned counts, a decision's probability is a mixture over the depths of its path with
the weights KT / (2 P). The model is learned from training texts and scores every text as it stands.

Counting: each task counts the (DEPTH + 1)-byte strings of its texts, and they are added up by key.
Tree: nodes of depth 3 and more depend only on strings that agree in the last three context bytes, so
strings are dealt by these. The nodes of depths 0 to 2 (at most 2**24, each of 24 bytes) are summed on
the driver and broadcast. The result is a log-probability for every string that occurs; strings that only
held-out texts hold count 0, which leaves every other node as it is.
Scoring: the ``held`` most frequent strings are broadcast as a hash table; each text's others are joined
with the model by key.

Unigram base: word counts of all training texts. The ``FREQUENT`` most frequent words are broadcast;
the others of each text are joined with the counts by key, so no vocabulary is held whole anywhere.
Words are keyed by 64-bit hashes.

Cases: null text is empty and scores its end alone; without training texts counts are zero (a KT
estimate of 1/2 for each decision); repeated rows and ids are scored apart; a null id is no held-out
one; an empty table gives an empty result; texts are read in runs of about 2 MB (a longer one alone);
extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.textops import Counts, Lookup, slices, words
from siftline.session import cut, partitions, ship

DEPTH, FREQUENT, HELD, FLUSH = 5, 1 << 18, 1 << 20, 2_000_000
STRING, WORD = 0, 1
END = -1  # the key of the end token
HALF = math.log(0.5)
_SMALL = np.array([0.0] + [math.lgamma(i / 2) for i in range(1, 64)])


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive multiples of 1/2."""
    big = np.maximum(x, 16.0)
    inv = 1 / big
    far = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + inv / 12 - inv**3 / 360 + inv**5 / 1260
    return np.where(x < 16, _SMALL[np.minimum(2 * x, 63).astype(np.int64)], far)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lgamma(a + 0.5) + lgamma(b + 0.5) - math.log(math.pi) - lgamma(a + b + 1.0)


def strings(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-byte string of each symbol (text bytes, then the end mark), and where rows begin."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    stream = np.full(len(data) + n * (depth + 1), 255, np.int64)
    row = np.repeat(np.arange(n), size)
    stream[np.arange(len(data)) + row * (depth + 1) + depth] = data
    whole = np.zeros(len(stream), np.int64)
    for j in range(depth + 1):
        whole[j:] |= stream[: len(stream) - j] << 8 * j
    first = offsets[:-1] + np.arange(n) * (depth + 1)
    keep = np.ones(len(stream), bool)
    for j in range(depth):
        keep[first + j] = False
    return whole[keep], offsets[:-1] + np.arange(n)


def count(docs: DataFrame, training: Column, text_col: str, depth: int) -> DataFrame:
    """(kind, key, n): all strings and all training words with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {STRING: Counts(), WORD: Counts()}

        def out():
            for kind, counts in kinds.items():
                keys, n = counts.total()
                for at in range(0, len(keys), 500_000):
                    k = keys[at : at + 500_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[at : at + 500_000])], ["kind", "key", "n"])
                counts.parts = []

        for batch in batches:
            for rows, data, offsets in slices(batch):
                train = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
                string, first = strings(data, offsets, depth)
                own = np.repeat(train, np.diff(np.append(first, len(string))))
                keys, n = np.unique(string[own], return_counts=True)
                kinds[STRING].add(keys, n)
                if not own.all():
                    keys = np.unique(string[~own])
                    kinds[STRING].add(keys, np.zeros(len(keys), np.int64))
                h, row = words(data, offsets)
                keys, n = np.unique(h.view(np.int64)[train[row]], return_counts=True)
                kinds[WORD].add(np.append(keys, END), np.append(n, train.sum()))
                if sum(len(k) for c in kinds.values() for k, _ in c.parts) > FLUSH:
                    for c in kinds.values():
                        c.parts = [c.total()]
                    if sum(len(c.parts[0][0]) for c in kinds.values()) > FLUSH // 2:
                        yield from out()
        yield from out()

    counted = docs.select(F.col(text_col).alias("__text"), training.alias("__train")).mapInArrow(run, "kind int, key bigint, n bigint")
    return cut(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the order that sorts ``keys``, where each begins in it, and each key's place."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], np.diff(keys[order]) != 0])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return keys[order][first], order, first, place


def _mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes, and the weight of their own estimates."""
    both = np.logaddexp(HALF + own, HALF + below)
    return both, np.exp(HALF + own - both)


class Level:
    """The nodes of one depth: keys (context << 8 | decisions made), counts, log weighted P, own weight,
    and for each its node one depth up (``up``, filled in by that depth)."""

    def __init__(self, string: np.ndarray, n: np.ndarray, below: Level | None, depth: int):
        symbol, context = string & 255, string >> 8
        keys = np.concatenate([context << 8 | 1 << k | symbol >> 8 - k for k in range(8)])
        bit = np.concatenate([symbol >> 7 - k & 1 for k in range(8)])
        self.keys, order, first, self.place = _distinct(keys)
        every, bit = np.tile(n, 8)[order], bit[order]
        self.ones = np.add.reduceat(every * bit, first)
        self.zeros = np.add.reduceat(every, first) - self.ones
        own = log_kt(self.zeros, self.ones)
        if below is None:
            self.both, self.weight = own, np.ones(len(own))
        else:
            below.up = np.searchsorted(self.keys, shorter(below.keys, depth))
            self.both, self.weight = _mixed(own, np.bincount(below.up, below.both, len(own)))

    def guess(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)


def shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the nodes of ``depth`` that lie above nodes of depth + 1."""
    return (keys >> 8 & (1 << 8 * depth) - 1) << 8 | keys & 255


def tree(string: np.ndarray, n: np.ndarray, depth: int) -> list[Level]:
    """The levels from ``depth`` up to 3 of distinct strings."""
    levels, n = [], n.astype(np.float64)
    for d in range(depth, 2, -1):
        if levels:
            string, order, first, _ = _distinct(string & (1 << 8 * (d + 1)) - 1)
            n = np.add.reduceat(n[order], first)
        levels.append(Level(string, n, levels[-1] if levels else None, d))
    return levels


def _top(sums: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node of depth 2, in order of its key: the part of P(1) that depths 0 to 2 give, and the
    weight left for longer contexts."""
    order = np.argsort(sums["key"].to_numpy())
    key, zeros, ones, below = (sums[c].to_numpy()[order] for c in ("key", "zeros", "ones", "log_p"))
    levels = []
    for depth in (2, 1, 0):
        if depth < 2:
            levels[-1][-1] = np.searchsorted(np.unique(shorter(key, depth)), shorter(key, depth))
            key, zeros, ones, below = _summed(shorter(key, depth), zeros, ones, levels[-1][3])
        both, weight = _mixed(log_kt(zeros, ones), below)
        levels.append([key, weight, (ones + 0.5) / (zeros + ones + 1), both, None])
    acc, rest = np.zeros(256), np.ones(256)
    for key, weight, guess, _, _ in levels[:1:-1]:
        acc, rest = weight * guess, 1 - weight
    for key, weight, guess, _, up in levels[1::-1]:
        acc, rest = acc[up] + rest[up] * weight * guess, rest[up] * (1 - weight)
    return levels[0][0], acc, rest


def probabilities(string: np.ndarray, n: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """log10 P(symbol | context) of each of distinct strings."""
    levels = tree(string, n, depth)
    up = np.searchsorted(top[0], shorter(levels[-1].keys, 2))
    acc, rest = top[1][up], top[2][up]
    for i in range(len(levels) - 1, -1, -1):
        x = levels[i]
        if i < len(levels) - 1:
            acc, rest = acc[x.up], rest[x.up]
        acc, rest = acc + rest * x.weight * x.guess(), rest * (1 - x.weight)
    one, symbol = acc[levels[0].place].reshape(8, len(string)), string & 255
    return sum(np.log10(np.where(symbol >> 7 - k & 1, one[k], 1 - one[k])) for k in range(8))


def model(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, n, log_p): log10 P(last byte | bytes before it) for every counted string."""
    if not 3 <= depth <= 6:
        raise ValueError("depth is 3 to 6: a string is one 64-bit number")
    spark = counts.sparkSession
    rows = counts.where(F.col("kind") == STRING)
    groups = max(partitions(spark), rows.count() // 100_000)
    dealt = rows.select("key", "n", F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFFFF)), F.lit(groups)).alias("g")).groupBy("g")

    def upper(x: pd.DataFrame) -> pd.DataFrame:
        last = tree(x["key"].to_numpy(), x["n"].to_numpy(), depth)[-1]
        key, zeros, ones, both = _summed(shorter(last.keys, 2), last.zeros, last.ones, last.both)
        return pd.DataFrame({"key": key, "zeros": zeros, "ones": ones, "log_p": both})

    sums = dealt.applyInPandas(upper, "key bigint, zeros double, ones double, log_p double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "log_p")]).toArrow()
    top = spark.sparkContext.broadcast(_top(sums))

    def lower(x: pd.DataFrame) -> pd.DataFrame:
        key, n = x["key"].to_numpy(), x["n"].to_numpy()
        return pd.DataFrame({"key": key, "n": n, "log_p": probabilities(key, n, top.value, depth)})

    return dealt.applyInPandas(lower, "key bigint, n bigint, log_p double")


def _least_count(tokens: DataFrame, most: int) -> int:
    """A count that at most ``most`` words reach, from a histogram in eighths of powers of two."""
    rows = tokens.groupBy(F.floor(8 * F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).orderBy(F.desc("b")).collect()  # at most 512
    held, least = 0, 1 << 62
    for r in rows:
        held += r.words
        if held > most:
            break
        least = r.n
    return least


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, frequent: int = FREQUENT, held: int = HELD) -> DataFrame:
    """id_col, training, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (code length)."""
    spark = docs.sparkSession
    ship(spark)
    counts = count(docs, training, text_col, depth)
    tokens = counts.where((F.col("kind") == WORD) & (F.col("n") > 0)).select("key", "n")
    total, distinct, ends = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("key"), F.coalesce(F.max(F.when(F.col("key") == END, F.col("n"))), F.lit(0))).first()
    below = math.log10(total + distinct + 1)
    common = tokens.where(F.col("n") >= _least_count(tokens, frequent)).toArrow()
    known = spark.sparkContext.broadcast(Lookup(common["key"].to_numpy(), common["n"].to_numpy().astype(np.float64)))
    rates = cut(model(counts, depth), "model")
    seen_rates = rates.where("n > 0")
    most = seen_rates.where(F.col("n") >= _least_count(seen_rates, held)).select("key", "log_p").toArrow()
    table = spark.sparkContext.broadcast(Lookup(most["key"].to_numpy(), most["log_p"].to_numpy()))

    kind = dict(docs.dtypes)[id_col]
    numbered = docs.select(F.col(text_col).alias("__text"), F.col(id_col).alias("__id"), training.alias("train"), F.monotonically_increasing_id().alias("row"))
    # what the last part of a task's rows must hold: a document's own figures, or one rare word or string of it
    stat = pa.struct([("id", pa.string()), ("train", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("log_p", pa.float64()), ("bytes", pa.int64())])
    names = ["row", "kind", "key", "tf", "stat"]

    def rare(row_id, of: int, keys: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((keys, at))
        keys, at = keys[order], at[order]
        if len(keys):
            begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])]))
            times = np.diff(np.append(begin, len(keys))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(row_id[at[begin]]), pa.array(np.full(len(begin), of, np.int32)), pa.array(keys[begin]), pa.array(times), pa.nulls(len(begin), stat)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                string, first = strings(data, offsets, depth)
                found = table.value.get(string, 1.0)  # 1: not among them, as no log-probability is positive
                missing = np.flatnonzero(found > 0)
                found[missing] = 0
                log_p = np.add.reduceat(found, first)
                h, row = words(data, offsets)
                h, n_rows = h.view(np.int64), rows.num_rows
                c = known.value.get(h, -1.0)
                seen = c >= 0
                base = np.bincount(row[seen], np.log10(c[seen] + 1) - below, n_rows) + math.log10(ends + 1) - below
                n_known = np.bincount(row[seen], minlength=n_rows) + (ends > 0)
                n = np.bincount(row, minlength=n_rows) + 1
                row_id = rows.column(3).to_numpy()
                stats = pa.StructArray.from_arrays([rows.column(1).cast(pa.string()), rows.column(2), *map(pa.array, (n, n_known.astype(np.int64), base, log_p, np.diff(offsets)))], fields=list(stat))
                none = pa.array(np.zeros(n_rows, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(row_id), pa.array(np.full(n_rows, -1, np.int32)), pa.array((row_id + 1) * np.int64(-7046029254386353131)), none, stats], names)
                yield from rare(row_id, WORD, h[~seen], row[~seen])
                yield from rare(row_id, STRING, string[missing], np.searchsorted(first, missing, "right") - 1)

    emitted = numbered.mapInArrow(run, "row bigint, kind int, key bigint, tf int, stat struct<id:string,train:boolean,n:bigint,known:bigint,base:double,log_p:double,bytes:bigint>")
    rate = tokens.select(F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("x")).unionByName(rates.select(F.lit(STRING).alias("kind"), "key", F.col("log_p").alias("x")))
    word, tf = F.col("kind") == WORD, F.col("tf")
    by_row = emitted.join(rate, ["kind", "key"], "left").groupBy("row").agg(
        F.max("stat").alias("stat"), F.coalesce(F.sum(F.when(word, tf * (F.log10(F.coalesce("x", F.lit(0.0)) + 1) - F.lit(below)))), F.lit(0.0)).alias("rare"),
        F.coalesce(F.sum(F.when(word & (F.col("x") > 0), tf)), F.lit(0)).alias("rare_known"), F.coalesce(F.sum(F.when(F.col("kind") == STRING, tf * F.col("x"))), F.lit(0.0)).alias("rare_log_p"),
    )
    log_p = F.col("stat.log_p") + F.col("rare_log_p")
    return by_row.select(
        F.col("stat.id").cast(kind).alias(id_col), F.col("stat.train").alias("training"), F.col("stat.n").alias("n_tokens"), (F.col("stat.known") + F.col("rare_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("stat.base") + F.col("rare")).alias("base_score"), log_p.alias("score"), (-log_p / math.log10(2) / (F.col("stat.bytes") + 1)).alias("bits_per_byte"),
    )
