"""Gapped alignment, translation and repeats. Distinct inputs are computed once each: callers join
results back on the strings. Dynamic programs run on Arrow batches in tasks, many pairs at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.seq import col, ratio, revcomp, slice_at
from siftline.session import large, ship

#: The standard genetic code, bases in the order TCAG.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
BASES = "TCAG"


#: A value holds a score and two counts, so that its order decides between equal scores and adding adds all three.
_ONE = 1 << 20
_SCORE = _ONE * _ONE
_NEVER = -(1 << 60)
CELLS = 1 << 17  # cells of an anti-diagonal, over all pairs, that are computed at once


def _batches(a: list[str], b: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Which pairs, their letters in rows (a; b from its end), and both lengths, pairs of like lengths together."""
    order = sorted(range(len(a)), key=lambda k: (len(a[k]), len(b[k])))
    while order:
        take = max(1, CELLS // (len(a[order[-1]]) + 1))
        chunk, order = np.array(order[-take:]), order[:-take]
        n, m = (np.array([len(x[k]) for k in chunk]) for x in (a, b))
        if max(n.max(), m.max()) >= _ONE:
            raise ValueError(f"sequences of {_ONE} letters or more are not aligned")
        left, right = np.full((len(chunk), n.max()), -1, np.int32), np.full((len(chunk), m.max()), -2, np.int32)
        left[np.arange(n.max()) < n[:, None]] = np.frombuffer("".join(a[k] for k in chunk).encode("utf-32-le"), np.int32)
        right[np.arange(m.max()) < m[:, None]] = np.frombuffer("".join(b[k] for k in chunk).encode("utf-32-le"), np.int32)
        yield chunk, left, right[:, ::-1], n, m


def _diagonals(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """For each anti-diagonal i + j = t of the cells with i, j >= 1: t, its places i, whether the letters are
    equal, and whether they are equal bases."""
    n, m = left.shape[1], right.shape[1]
    for t in range(1, n + m + 1):
        lo, hi = max(1, t - m), min(n, t - 1)
        x = left[:, lo - 1 : hi]
        same = x == right[:, m - t + lo : m - t + hi + 1] if hi >= lo else np.zeros((len(left), 0), bool)
        yield t, slice(lo, hi + 1), same, same & np.isin(x, [65, 67, 71, 84])


def global_alignments(a: list[str], b: list[str], match: int = 1, mismatch: int = -1, gap_open: int = -2, gap_extend: int = -1) -> np.ndarray:
    """Rows (score, pairs, identical bases) of the best global alignments with affine gaps, of equal scores the
    one with most pairs, then most identical bases. A gap of n letters costs gap_open + (n - 1) gap_extend.
    All cells of an anti-diagonal of all pairs of a batch take a step at once; two diagonals are kept."""
    out = np.zeros((len(a), 3), np.int64)
    opened, longer = gap_open * _SCORE, gap_extend * _SCORE
    for which, left, right, n, m in _batches(a, b):
        shape = (len(which), left.shape[1] + 1)
        pair, in_b, in_a = (np.full(shape, _NEVER) for _ in range(3))
        pair[:, 0] = 0
        last = np.full(shape, _NEVER)  # the best of each cell, a diagonal earlier
        done = n + m == 0
        for t, at, same, base in _diagonals(left, right):
            best = np.maximum(np.maximum(pair, in_b), in_a)
            now = np.full(shape, _NEVER)
            now[:, at] = last[:, at.start - 1 : at.stop - 1] + np.where(same, match * _SCORE + _ONE, mismatch * _SCORE + _ONE) + base
            down = np.full(shape, _NEVER)
            down[:, 1:] = np.maximum(np.maximum(pair, in_a)[:, :-1] + opened, in_b[:, :-1] + longer)
            in_a = np.maximum(np.maximum(pair, in_b) + opened, in_a + longer)
            pair, in_b, last = now, down, best
            ended = n + m == t
            if ended.any():
                rows = np.flatnonzero(ended)
                value = np.maximum(np.maximum(pair, in_b), in_a)[rows, n[rows]]
                out[which[rows]] = np.stack([value >> 40, (value >> 20) & (_ONE - 1), value & (_ONE - 1)], axis=1)
        out[which[done]] = 0
    return out


def local_alignments(a: list[str], b: list[str], match: int = 1, mismatch: int = 0, gap: int = -1) -> np.ndarray:
    """Rows (score, identical letters, columns) of the best local alignments with linear gaps, of equal scores
    the one with most identical letters, then fewest columns. mismatch and gap are not above 0."""
    if mismatch > 0 or gap > 0:
        raise ValueError("mismatch and gap may not be above 0")
    out = np.zeros((len(a), 3), np.int64)
    for which, left, right, _, _ in _batches(a, b):
        shape = (len(which), left.shape[1] + 1)
        two, one, best = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(len(which), np.int64)
        for _, at, same, _ in _diagonals(left, right):
            now = np.zeros(shape, np.int64)
            if at.stop > at.start:
                before = slice(at.start - 1, at.stop - 1)
                step = np.maximum(one[:, before], one[:, at]) + (gap * _SCORE - 1)
                now[:, at] = np.maximum(np.maximum(two[:, before] + np.where(same, match * _SCORE + _ONE - 1, mismatch * _SCORE - 1), step), 0)
                best = np.maximum(best, now[:, at].max(1))
            two, one = one, now
        columns = -best % _ONE
        out[which] = np.stack([(best + columns) >> 40, ((best + columns) >> 20) & (_ONE - 1), columns], axis=1)
    return out


def _per_pair(pairs: DataFrame, a: str, b: str, names: list[str], f: Callable[[list[str], list[str]], np.ndarray]) -> DataFrame:
    """a, b and long columns ``names`` of every distinct pair without nulls."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = f(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, k]) for k in range(len(names)))], [a, b, *names])

    distinct = pairs.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    return distinct.mapInArrow(run, f"`{a}` string, `{b}` string, " + ", ".join(f"{c} bigint" for c in names))


def aligned_global(pairs: DataFrame, a: str, b: str, **costs: int) -> DataFrame:
    """Of each distinct pair: a, b, score, paired_bp, matches, mismatches, indels, identity (of paired letters, 0
    without any), coverage_shorter and coverage_longer. Identity leaves gaps out, so ask for coverage first. With
    an empty sequence nothing is paired."""
    found = _per_pair(pairs, a, b, ["score", "paired_bp", "matches"], lambda x, y: global_alignments(x, y, **costs))
    n, m = F.length(a).cast("long"), F.length(b).cast("long")
    none = (n == 0) | (m == 0)
    indels = F.when(none, F.lit(0)).otherwise(n + m - 2 * F.col("paired_bp"))
    return found.select(
        a, b, "score", "paired_bp", "matches", (F.col("paired_bp") - F.col("matches")).alias("mismatches"), indels.cast("long").alias("indels"), ratio(F.col("matches"), F.col("paired_bp")).alias("identity"),
        ratio(F.col("paired_bp"), F.least(n, m)).alias("coverage_shorter"), F.when(none, F.lit(0.0)).otherwise(ratio(F.col("paired_bp"), F.greatest(n, m))).alias("coverage_longer"),
    )


def aligned_local(pairs: DataFrame, a: str, b: str, **costs: int) -> DataFrame:
    """Of each distinct pair: a, b, score, matches, columns of its best local alignment."""
    return _per_pair(pairs, a, b, ["score", "matches", "columns"], lambda x, y: local_alignments(x, y, **costs))


def eligible(a: Column, b: Column, paired: Column, coverage_longer: Column, least_bp: int, least_ratio: float) -> Column:
    """Whether a side can speak for a background: known bases only, enough of them paired, and most of the longer."""
    return a.rlike("^[ACGT]+$") & b.rlike("^[ACGT]+$") & (paired >= least_bp) & (coverage_longer >= least_ratio)


def chosen_side(left: Column, right: Column) -> Column:
    """The better by identity, then paired_bp, of those structs that are eligible, the left on ties: its name and
    metrics; ``none`` and null if neither is."""
    key = lambda s: F.struct(s["identity"], s["paired_bp"])
    first = left["eligible"] & (~right["eligible"] | (key(left) >= key(right)))
    side = lambda name, s: F.struct(F.lit(name).alias("side"), s.alias("metrics"))
    return F.when(first, side("left", left)).when(right["eligible"], side("right", right)).otherwise(F.struct(F.lit("none").alias("side"), F.when(F.lit(False), left).alias("metrics")))


def sides(df: DataFrame, left: tuple[str, str], right: tuple[str, str], least_bp: int, least_ratio: float) -> DataFrame:
    """Adds left, right (metrics of the global alignments of each side's two sequences) and chosen."""
    both = df.select(F.col(left[0]).alias("__a"), F.col(left[1]).alias("__b")).unionByName(df.select(F.col(right[0]).alias("__a"), F.col(right[1]).alias("__b")))
    found = aligned_global(both, "__a", "__b")
    ok = eligible(F.col("__a"), F.col("__b"), F.col("paired_bp"), F.col("coverage_longer"), least_bp, least_ratio)
    metrics = F.struct(*[c for c in found.columns if not c.startswith("__")], ok.alias("eligible"))
    found = found.select("__a", "__b", metrics.alias("__m"))
    out = df
    for (a, b), name in ((left, "left"), (right, "right")):
        side = found.toDF(f"__{name}_a", f"__{name}_b", name)
        out = out.join(side, (F.col(a) == F.col(f"__{name}_a")) & (F.col(b) == F.col(f"__{name}_b"))).drop(f"__{name}_a", f"__{name}_b")
    return out.withColumn("chosen", chosen_side(F.col("left"), F.col("right")))


def translate(s: Column | str, frame: int = 0) -> Column:
    """Amino acids of the whole codons from ``frame``; X for codons with other letters."""
    codons = F.map_from_arrays(F.lit([x + y + z for x in BASES for y in BASES for z in BASES]), F.lit(list(AMINO)))
    n = F.floor((F.length(col(s)) - frame) / 3).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.coalesce(F.try_element_at(codons, slice_at(s, i * 3 + frame, 3)), F.lit("X")))
    return F.when(n > 0, F.array_join(made, "")).otherwise("")


#: Amino acids by 25 * first + 5 * second + third letter (in the order of BASES, 4 for others).
_CODON = np.frombuffer("".join(AMINO[16 * x + 4 * y + z] if max(x, y, z) < 4 else "X" for x in range(5) for y in range(5) for z in range(5)).encode(), np.uint8)
_STOP = ord("*")
LETTERS = 1 << 20  # of sequences that are translated at once


def _frame_runs(codes: np.ndarray, size: np.ndarray, frame: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, letters) of the stretches without a stop of rows of base codes, letters being those of all one after another."""
    n = np.maximum((size - frame) // 3, 0)
    top = int(n.max(initial=0))
    part = codes[:, frame : frame + 3 * top].astype(np.uint8)
    amino = np.full((len(codes), top + 1), _STOP, np.uint8)  # behind its end each row has a stop
    amino[:, :top] = np.where(np.arange(top) < n[:, None], _CODON[25 * part[:, ::3] + 5 * part[:, 1::3] + part[:, 2::3]], _STOP)
    row, stop = np.nonzero(amino == _STOP)
    before = np.where(np.r_[-1, row[:-1]] == row, np.r_[-1, stop[:-1]], -1)
    keep = (stop <= n[row]) & (stop - before - 1 >= least)
    row, start, length = row[keep], (before + 1)[keep], (stop - before - 1)[keep]
    ends = np.cumsum(length)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(row * amino.shape[1] + start, length)
    return row, start, length, amino.ravel()[at]


def open_frames(df: DataFrame, keys: list[str], s: str, least: int) -> DataFrame:
    """keys, strand, frame, start (amino acids from the frame's begin), protein: stretches without a stop. Sequences
    are translated in batches, and only long enough stretches become rows."""
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    names = [*keys, "strand", "frame", "start", "protein"]
    letter = np.full(256, 4, np.uint8)
    letter[np.frombuffer(BASES.encode(), np.uint8)] = np.arange(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
            while order:
                take = max(1, LETTERS // (len(texts[order[-1]]) + 1))
                chunk, order = np.array(order[-take:]), order[:-take]
                size = np.array([len(texts[k]) for k in chunk])
                codes = np.full((len(chunk), int(size.max())), 4, np.uint8)
                inside = np.arange(codes.shape[1]) < size[:, None]
                codes[inside] = letter[np.frombuffer("".join(texts[k] for k in chunk).encode("latin-1", "replace"), np.uint8)]
                turned = np.full_like(codes, 4)  # A, C, G, T are 2, 1, 3, 0
                turned[inside] = np.array([2, 3, 0, 1, 4], np.uint8)[codes][:, ::-1][inside[:, ::-1]]
                for strand, side in (("+", codes), ("-", turned)):
                    for frame in range(3):
                        row, start, length, letters = _frame_runs(side, size, frame, least)
                        if len(row):
                            proteins = pa.StringArray.from_buffers(len(row), pa.py_buffer(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.py_buffer(letters.tobytes()))
                            own = [batch.column(k).take(pa.array(chunk[row])) for k in range(len(keys))]
                            yield pa.RecordBatch.from_arrays([*own, pa.array([strand]).take(pa.array(np.zeros(len(row), np.int32))), pa.array(np.full(len(row), frame), pa.int32()), pa.array(start, pa.int32()), proteins], names)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", strand string, frame int, start int, protein string"
    return df.select(*keys, F.coalesce(F.upper(s), F.lit("")).alias("__s")).mapInArrow(run, schema)


def end_repeat(df: DataFrame, keys: list[str], s: str, window: int, seed: int, inverted: bool) -> DataFrame:
    """keys, length, left, right: the longest exact repeat between the first and last ``window``
    letters (the last ones reverse-complemented if inverted). Seeds are joined by equality, and runs of
    seeds on one diagonal are one repeat."""
    head = F.substring(s, 1, window)
    tail = F.substring(F.col(s), -window, window)
    tail = revcomp(tail) if inverted else tail
    words = lambda x, name: df.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.length(x) - seed, F.lit(0))), lambda i: slice_at(x, i, seed))).alias(name, "w")).where(F.length("w") == seed)
    both = words(head, "i").join(large(words(tail, "j")), [*keys, "w"]).withColumn("d", F.col("i") - F.col("j"))
    from pyspark.sql import Window

    run = F.col("i") - F.row_number().over(Window.partitionBy(*keys, "d").orderBy("i"))
    runs = both.withColumn("run", run).groupBy(*keys, "d", "run").agg((F.count(F.lit(1)) + seed - 1).alias("length"), F.min("i").alias("left"), F.min("j").alias("right"))
    return runs.groupBy(*keys).agg(F.max_by(F.struct("length", "left", "right"), F.struct("length", -F.col("left"), -F.col("right"))).alias("r")).select(*keys, "r.*")


def project_interval(lo: Column, hi: Column, source_lo: Column, source_hi: Column, strand: Column, status: Column, occupied: Column) -> Column:
    """struct(status, lo, hi): an interval of a fragment in the coordinates of its source; anything
    doubtful is a status without coordinates."""
    a = F.when(strand == "-", source_hi - hi).otherwise(source_lo + lo)
    b = F.when(strand == "-", source_hi - lo).otherwise(source_lo + hi)
    bad = (
        F.when(lo.isNull() | hi.isNull(), "no_interval").when(hi <= lo, "empty_interval").when(status == "missing", "source_missing").when(status == "ambiguous", "source_ambiguous")
        .when(status == "partial_N", "source_partial").when(~strand.isin("+", "-"), "strand_unknown").when((a < 0) | (b > occupied), "out_of_range")
    )
    return F.when(bad.isNotNull(), F.struct(bad.alias("status"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))).otherwise(F.struct(F.lit("projected").alias("status"), a.cast("int").alias("lo"), b.cast("int").alias("hi")))
