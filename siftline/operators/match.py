"""Windowed matches between two sequences of a site, in both orientations. Positions on the flank are
always in the forward frame. N never matches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.functions import seq
from siftline.functions.arrays import reasons
from siftline.session import ship


def retention_floor(length: int) -> int:
    return math.ceil(0.6 * length)


_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
WORDS = 1 << 15  # 64-bit words of a bit vector over the sites that are counted at once


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of each text in a row, 4 for what is no letter and behind the end; and the lengths."""
    size = np.array([len(t) for t in texts])
    codes = np.full((len(texts), int(size.max(initial=0))), 4, np.uint8)
    codes[np.arange(codes.shape[1]) < size[:, None]] = _CODE[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)]
    return codes, size


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words, the first flag in the lowest bit."""
    wide = np.zeros((len(flags), -(-flags.shape[1] // 64) * 64), bool)
    wide[:, : flags.shape[1]] = flags
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def _lower(x: np.ndarray, by: int) -> np.ndarray:
    """Bit vectors shifted ``by`` places towards the first."""
    words, bits = divmod(by, 64)
    out = np.zeros_like(x)
    if words < x.shape[-1]:
        out[..., : x.shape[-1] - words] = x[..., words:] >> np.uint64(bits)
        if bits:
            out[..., : x.shape[-1] - words - 1] |= x[..., words + 1 :] << np.uint64(64 - bits)
    return out


def _count(planes: np.ndarray, x: np.ndarray, up: bool) -> None:
    """Adds the bits of x to counters that lie as bit planes (or takes them off)."""
    for p in planes:
        carry = (p if up else ~p) & x
        p ^= x
        x = carry


def window_counts(a: np.ndarray, b: np.ndarray, length: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, i, j, m): windows at i of a and j of b (rows of letter codes) with m >= least equal letters.

    Bit-parallel: a site's flank is four bit vectors, one for each letter, and the counts of all its windows
    against one window of nc are bit planes. Going down by one letter, counts move one place along their
    diagonal, gain the matches of the letter that comes in and lose those of the letter that goes out: a few
    word operations for 64 windows, over all sites of a batch at once."""
    if length > min(a.shape[1], b.shape[1]) or least > length:
        return
    letters = np.stack([_bits(b == c) for c in range(4)] + [np.zeros((len(b), -(-b.shape[1] // 64)), np.uint64)], axis=1)
    rows = np.arange(len(a))
    planes = np.zeros((length.bit_length(), *letters.shape[::2]), np.uint64)
    for i in range(a.shape[1] - 1, -1, -1):
        if i + length < a.shape[1]:
            _count(planes, _lower(letters[rows, a[:, i + length]], length - 1), False)
        planes = _lower(planes, 1)
        _count(planes, letters[rows, a[:, i]], True)
        if i + length > a.shape[1]:
            continue
        enough = np.full(planes.shape[1:], ~np.uint64(0))
        for k, p in enumerate(planes):
            enough = (p & enough) if least >> k & 1 else (p | enough)
        some = np.flatnonzero(enough.any(1))
        if len(some):
            at, j = np.nonzero(np.unpackbits(enough[some].view(np.uint8), axis=1, bitorder="little")[:, : b.shape[1] - length + 1])
            at = some[at]
            m = np.zeros(len(at), np.int32)
            for k, p in enumerate(planes):
                m |= ((p[at, j >> 6] >> (j & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int32) << k
            yield at, np.full(len(at), i), j, m


def window_matches(sites: DataFrame, keys: list[str], nc: str, flank: str, lengths: list[int], least=retention_floor, orients: tuple[str, ...] = ("fwd", "rc"), with_n: bool = False) -> DataFrame:
    """keys, orient, L, i, f, m: all window pairs with at least ``least(L)`` matches; windows of nc that
    hold N are left out, unless ``with_n``. Sites are counted in batches (see window_counts), and only hits become rows."""
    ship(sites.sparkSession)
    floors = {n: least(n) for n in lengths}
    kinds = dict(sites.dtypes)
    names = [*keys, "orient", "L", "i", "f", "m"]

    def found(codes, size, other, other_size, orient, length):
        whole = np.cumsum(np.pad(codes == 4, ((0, 0), (1, 0))), axis=1)
        for row, i, j, m in window_counts(codes, other, length, max(0, floors[length])):
            ok = (i + length <= size[row]) & (j + length <= other_size[row])
            row, i, j, m = row[ok], i[ok], j[ok], m[ok]
            if not with_n:
                ok = whole[row, i + length] == whole[row, i]
                row, i, j, m = row[ok], i[ok], j[ok], m[ok]
            yield row, i, j if orient == "fwd" else other_size[row] - j - length, m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, columns)
            left, right = (batch.column(columns.index(c)).to_pylist() for c in (nc, flank))
            order = sorted((k for k in range(len(left)) if left[k] is not None and right[k] is not None), key=lambda k: (len(right[k]), len(left[k])))
            while order:
                take = max(1, WORDS // max(1, -(-len(right[order[-1]]) // 64)))
                chunk, order = order[-take:], order[:-take]
                (a, a_size), (b, b_size) = _padded([left[k] for k in chunk]), _padded([right[k] for k in chunk])
                turned = np.full_like(b, 4)
                inside = np.arange(b.shape[1]) < b_size[:, None]
                turned[inside] = np.where(b < 4, 3 - b, b)[:, ::-1][inside[:, ::-1]]
                for orient, side in ((o, {"fwd": b, "rc": turned}[o]) for o in orients):
                    for length in floors:
                        for row, i, f, m in found(a, a_size, side, b_size, orient, length):
                            if len(row):
                                n, at = len(row), pa.array(np.array(chunk)[row])
                                own = [batch.column(columns.index(c)).take(at) for c in keys]
                                yield pa.RecordBatch.from_arrays([*own, pa.array([orient]).take(pa.array(np.zeros(n, np.int32))), *(pa.array(x, pa.int32()) for x in (np.full(n, length), i, f, m))], names)

    columns = list(dict.fromkeys([*keys, nc, flank]))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", orient string, L int, i int, f int, m int"
    return sites.select(*columns).mapInArrow(run, schema)


def match_table(hits: DataFrame, keys: list[str], exclude: list[int]) -> DataFrame:
    """Per window position the most matches, and its first flank position, for each width of flank that
    is left out next to the junction: keys, orient, L, i, excl, m, f (m 0 and f -1 where nothing is left)."""
    kinds = dict(hits.dtypes)
    at = 2**32 - 1
    packed = F.col("m").cast("long") * 2**32 + (at - F.col("f"))  # one number, so that rows are hashed, not sorted
    best = [F.max(F.when(F.col("f") >= e, packed)) for e in dict.fromkeys(exclude)]
    each = F.array(*[F.struct(F.lit(e).alias("excl"), b.alias("b")) for e, b in zip(dict.fromkeys(exclude), best)])
    wide = hits.groupBy(*keys, "orient", "L", "i").agg(each.alias("e")).select(*keys, "orient", "L", "i", F.explode("e").alias("e")).select(*keys, "orient", "L", "i", "e.*")
    m, f = F.shiftright("b", 32), at - F.col("b").bitwiseAND(F.lit(at))
    return wide.select(*keys, "orient", "L", "i", "excl", F.coalesce(m.cast(kinds["m"]), F.lit(0)).alias("m"), F.coalesce(f.cast(kinds["f"]), F.lit(-1)).alias("f"))


def admit(table: DataFrame, site: list[str], rule: str, threshold: float, e: Column | None = None) -> DataFrame:
    """m: matches >= threshold; e: expectation < threshold; top: the threshold rows of least expectation
    of a site and orientation (ties by position)."""
    if rule == "m":
        return table.where(F.col("m") >= threshold)
    if rule == "e":
        return table.where(e < threshold)
    order = Window.partitionBy(*site, "orient").orderBy(e, "i")
    return table.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= threshold).drop("__n")


def pooled(counts: DataFrame, by: list[str], pos: str, s: str) -> DataFrame:
    """The larger of the orientations at each position, and which (fwd on ties)."""
    return counts.groupBy(*by, pos).agg(F.max(s).alias(s), F.max_by("orient", F.struct(F.col(s), F.col("orient") == "fwd")).alias("orient"))


def adequacy(sites: DataFrame, bag: str, nc: str, flank: str, least_nc: int, least_flank: int) -> DataFrame:
    """drop_reason of each site (null: adequate) and k_valid, the adequate sites of its bag, fixed before any filtering."""
    reason = F.when(F.col(nc).isNull() | (F.length(nc) < least_nc), "nc_short").when(F.col(flank).isNull() | (F.length(flank) < least_flank), "flank_short")
    return sites.withColumn("drop_reason", reason).withColumn("k_valid", F.count_if(F.col("drop_reason").isNull()).over(Window.partitionBy(bag)))


def motif_reasons(s: Column | str, run: int = 6, period: float = 0.8, at: float = 0.85, bits: float = 1.2) -> Column:
    """Why a motif is of low complexity: names of the tests that fail, none for a good one."""
    return reasons(
        homopolymer=seq.longest_run(s) >= run, **{f"period{p}": seq.periodicity(s, p) >= period for p in (1, 2, 3, 4)},
        at_frac=seq.at_fraction(s) >= at, entropy=seq.base_entropy(s) < bits,
    )


TESTS = ["homopolymer", "period1", "period2", "period3", "period4", "at_frac", "entropy"]
LETTERS = 1 << 22  # of motifs that are tested at once


def motif_flags(words: list[str | None], run: int = 6, period: float = 0.8, at: float = 0.85, bits: float = 1.2) -> np.ndarray:
    """:func:`motif_reasons` of many motifs: bit k is set where TESTS[k] fails. A null one has no letters."""
    out = np.full(len(words), (0 < bits) << TESTS.index("entropy"), np.int32)
    order = sorted((k for k in range(len(words)) if words[k] is not None), key=lambda k: len(words[k]))
    while order:
        take = max(1, LETTERS // (len(words[order[-1]]) + 1))
        chunk, order = order[-take:], order[:-take]
        n = np.array([len(words[k]) for k in chunk])
        inside = np.arange(n.max()) < n[:, None]
        x = np.zeros(inside.shape, np.int32)
        x[inside] = np.frombuffer("".join(words[k] for k in chunk).encode("utf-32-le", "surrogatepass"), np.int32)
        part = lambda a, b: np.divide(a, b, out=np.zeros(len(n)), where=b > 0)
        longest = now = (n > 0).astype(np.int64)
        for k in range(1, x.shape[1]):
            now = np.where(inside[:, k] & (x[:, k] == x[:, k - 1]), now + 1, 1)
            longest = np.maximum(longest, np.where(inside[:, k], now, 0))
        failed = [longest >= run]
        for p in (1, 2, 3, 4):
            same = ((x[:, p:] == x[:, : max(0, x.shape[1] - p)]) & inside[:, p:]).sum(1)
            failed.append(part(same, np.maximum(n - p, 0)) >= period)
        counts = [(inside & (x == ord(c))).sum(1) for c in "ACGT"]
        total = sum(counts)
        failed.append(part(counts[0] + counts[3], total) >= at)
        entropy = np.zeros(len(n))
        for c in counts:
            share = part(c, total)
            entropy -= share * np.log(share, out=np.zeros(len(n)), where=share > 0) / np.log(2)
        failed.append(entropy < bits)
        out[chunk] = sum(f.astype(np.int32) << k for k, f in enumerate(failed))
    return out


def gate(hits: DataFrame, guide: str, target: str, **limits) -> tuple[DataFrame, DataFrame]:
    """Hits whose guide and target both pass; and (side, reason, n) of what fails. Motifs are tested many at a time."""
    ship(hits.sparkSession)

    def tested(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield pd.Series(motif_flags([w if isinstance(w, str) else None for w in words], **limits))

    flags = F.pandas_udf(tested, "int")
    marked = hits.withColumns({"__g": flags(guide), "__t": flags(target)})
    passed = marked.where((F.col("__g") == 0) & (F.col("__t") == 0)).drop("__g", "__t")
    counts = [F.count_if(F.col(c).bitwiseAND(1 << k) != 0) for c in ("__g", "__t") for k in range(len(TESTS))]
    names = [(side, test) for side in ("guide", "target") for test in TESTS]
    total = marked.agg(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(test).alias("reason"), c.alias("n")) for (side, test), c in zip(names, counts)]).alias("r"))
    return passed, total.select(F.explode("r").alias("r")).select("r.*").where("n > 0")


def orientation(x: Column | str) -> Column:
    low = F.lower(F.coalesce(seq.col(x), F.lit("fwd")))
    return F.when(low.isin("forward", "fwd", "+"), "fwd").when(low.isin("reverse_complement", "reverse", "rc", "-"), "rc").otherwise(low)


def side_of_boundary(pos: Column, length: Column, boundary: Column) -> Column:
    """INSIDE, OUTSIDE or CROSSES of [pos, pos + length) and a boundary; n/a for pos < 0."""
    return F.when(pos < 0, "n/a").when(pos >= boundary, "INSIDE").when(pos + length <= boundary, "OUTSIDE").otherwise("CROSSES")


def rank_regime(rank: Column) -> Column:
    return F.when(rank.isNull() | (rank < 1), "not_in_pool").when(rank <= 4, "1-4").when(rank <= 20, "5-20").when(rank <= 50, "21-50").otherwise("51+")


def edge_class(start: Column, end: Column, n: Column, margin: int) -> Column:
    return F.when(start <= margin, "5p_edge").when(end >= n - margin, "3p_edge").otherwise("middle")
