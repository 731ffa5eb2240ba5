"""Sequence functions as column expressions (they stay in the JVM, unless said otherwise). Positions are zero-based and
half-open; N, or any letter but ACGT, never matches. Null in gives null out unless said otherwise."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

SPACER = 13
#: How ambiguity letters are folded.
IUPAC = ("RYSWKMBDHVN", "ACGAGACAAAA")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slice_at(s: Column | str, start: Column | int, length: Column | int) -> Column:
    """The one place where zero-based positions become one-based."""
    as_int = lambda v: F.lit(v) if isinstance(v, int) else v.cast("int")
    return F.substring(col(s), as_int(start) + 1, as_int(length))


def chars(s: Column | str) -> Column:
    return F.filter(F.split(col(s), ""), lambda c: c != "")


def starts(s: Column | str, k: int) -> Column:
    """Positions of windows of k letters; an empty array for shorter strings."""
    n = F.length(col(s)) - k
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def revcomp(s: Column | str) -> Column:
    return F.reverse(F.translate(col(s), "ACGTacgt", "TGCAtgca"))


def canonical_strand(s: Column | str) -> Column:
    return F.least(col(s), revcomp(s))


def fold_iupac(s: Column | str) -> Column:
    return F.translate(F.upper(col(s)), *IUPAC)


def encode(s: Column | str) -> Column:
    """A 0, C 1, G 2, T 3, anything else 4, either case."""
    return F.transform(chars(F.upper(col(s))), lambda c: F.coalesce(F.nullif(F.array_position(F.lit(["A", "C", "G", "T"]), c), F.lit(0)) - 1, F.lit(4)).cast("int"))


def one_hot(s: Column | str) -> Column:
    return F.transform(encode(s), lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (c == k).cast("float")))


def fusion(a: Column | str, b: Column | str) -> Column:
    """Sign of the code difference of aligned letters, 0 where either is N."""
    return F.zip_with(encode(a), encode(b), lambda x, y: F.when((x == 4) | (y == 4), 0).otherwise(F.signum((x - y).cast("double")).cast("int")))


def count_of(s: Column | str, letters: str) -> Column:
    return F.length(col(s)) - F.length(F.translate(col(s), letters, ""))


def longest_run(s: Column | str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(col(s), F.lit(r"(?s)((.)\2*)"), F.lit(1)), F.length)), F.lit(0))


def periodicity(s: Column | str, p: int) -> Column:
    """Share of letters equal to the one p before; 0 for strings of p letters or fewer."""
    same = F.regexp_count(col(s), F.lit(f"(?s)(.)(?=.{{{p - 1}}}\\1)"))
    return ratio(same.cast("double"), F.greatest(F.length(col(s)) - p, F.lit(0)))


def at_fraction(s: Column | str) -> Column:
    return ratio(count_of(s, "AT").cast("double"), count_of(s, "ACGT"))


def gc_percent(s: Column | str) -> Column:
    return ratio(100.0 * count_of(s, "GC"), F.length(col(s)))


def entropy_of(counts: Column) -> Column:
    """Bits, of an array of counts; array and total are worked out once, not for every entry."""
    bits = lambda c: let(F.aggregate(c, F.lit(0.0), lambda t, x: t + x), lambda total: F.aggregate(c, F.lit(0.0), lambda t, x: t - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0)))
    return let(counts, bits)


def base_entropy(s: Column | str) -> Column:
    return entropy_of(F.array(*[count_of(s, c).cast("double") for c in "ACGT"]))


def kmers(s: Column | str, k: int) -> Column:
    """All windows of k letters in order. One pass: the pattern looks ahead k letters and steps by one."""
    return F.regexp_extract_all(col(s), F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))


def blocks(s: Column | str, size: int, k: int) -> Column:
    """The text from every ``size``-th letter on, ``size`` + k - 1 letters long: the blocks' windows of k
    letters are those of the text, each once. For long texts, whose windows should not stand in one row."""
    return F.regexp_extract_all(col(s), F.lit(f"(?s)(?=(.{{1,{size + k - 1}}})).{{1,{size}}}"), F.lit(1))


def kmer_counts(s: Column | str, k: int, alphabet: str = "ACGT") -> Column:
    """Counts of all len(alphabet)**k k-mers in alphabetical order; others are skipped."""
    words = [""]
    for _ in range(k):
        words = [w + c for w in words for c in alphabet]
    return F.array(*[F.regexp_count(col(s), F.lit(f"(?=\\Q{w}\\E)")) for w in words])


def dinucleotide_entropy(s: Column | str) -> Column:
    return F.when(F.length(col(s)) < 2, 0.0).otherwise(entropy_of(F.transform(kmer_counts(s, 2), lambda x: x.cast("double"))))


def complexity(s: Column | str) -> Column:
    n = F.length(col(s))
    return base_entropy(s) / 2 * F.least(dinucleotide_entropy(s) / 2.5, F.lit(1.0)) * F.greatest(F.lit(0.0), 1 - ratio(longest_run(s).cast("double"), n))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Null for strings of different lengths."""
    return F.when(F.length(col(a)) == F.length(col(b)), F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda t, x: t + x))


def _pairs(a: Column | str, b: Column | str, test) -> Column:
    n = F.least(F.length(col(a)), F.length(col(b)))
    return F.aggregate(F.zip_with(chars(F.substring(col(a), F.lit(1), n)), chars(F.substring(col(b), F.lit(1), n)), lambda x, y: test(x, y).cast("int")), F.lit(0), lambda t, x: t + x)


def strict_match(x: Column, y: Column) -> Column:
    return (x == y) & x.isin("A", "C", "G", "T")


def wobble_match(x: Column, y: Column) -> Column:
    return strict_match(x, y) | ((x == "G") & (y == "T")) | ((x == "T") & (y == "G"))


def matches(a: Column | str, b: Column | str, wobble: bool = False) -> Column:
    return _pairs(a, b, wobble_match if wobble else strict_match)


def trimmed_identity(a: Column | str, b: Column | str) -> Column:
    n = F.least(F.length(col(a)), F.length(col(b)))
    return ratio(_pairs(a, b, lambda x, y: x == y).cast("double"), n)


def offset_identity(a: Column | str, b: Column | str, most: int = 5, least: int = 10) -> Column:
    """struct(identity, near, offset, n): the best shift of b within +-most with at least ``least`` letters; of equal
    ones the nearest to 0, then the greater. Leaves the JVM: letters of many rows are compared at once."""
    shifts = sorted(range(-most, most + 1), key=lambda o: (abs(o), -o))
    kinds = pa.struct([("identity", pa.float64()), ("near", pa.int32()), ("offset", pa.int32()), ("n", pa.int32())])
    cells = 1 << 22  # letters of each side that are compared at once

    def padded(texts: list[str], behind: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(t) for t in texts])
        out = np.full((len(texts), int(size.max())), behind, np.int32)
        out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
        return out, size

    def best(x: pa.Array, y: pa.Array) -> pa.Array:
        left, right = x.to_pylist(), y.to_pylist()
        none = np.array([u is None or v is None for u, v in zip(left, right)], bool)
        identity, offset, n = np.full(len(left), -1.0), np.zeros(len(left), np.int32), np.zeros(len(left), np.int32)
        order = sorted(np.flatnonzero(~none).tolist(), key=lambda k: max(len(left[k]), len(right[k])))
        while order:
            take = max(1, cells // (max(len(left[order[-1]]), len(right[order[-1]])) + 1))
            chunk, order = np.array(order[-take:]), order[:-take]
            (u, u_size), (v, v_size) = padded([left[k] for k in chunk], -1), padded([right[k] for k in chunk], -2)
            for o in shifts:
                p, q = max(o, 0), max(-o, 0)
                width = max(0, min(u.shape[1] - p, v.shape[1] - q))
                length = np.maximum(np.minimum(u_size - p, v_size - q), 0)
                same = (u[:, p : p + width] == v[:, q : q + width]).sum(1)
                share = np.divide(same, length, out=np.zeros(len(chunk)), where=length > 0)
                better = (length >= least) & (share > identity[chunk])
                rows = chunk[better]
                identity[rows], offset[rows], n[rows] = share[better], o, length[better]
        parts = [pa.array(c, t.type) for c, t in zip((identity, -np.abs(offset), offset, n), kinds)]
        return pa.StructArray.from_arrays(parts, fields=list(kinds), mask=pa.array(identity < 0))

    # given its type and hints by hand: annotations of a nested function are text here
    best.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(best, "identity double, near int, offset int, n int")(col(a), col(b))


def find_all(s: Column | str, part: Column | str) -> Column:
    """All starts, overlapping ones too; none for an empty part. One pass: at each letter the pattern
    looks for the part, and gives an empty string where it is not."""
    quoted = F.concat(F.lit("(?s)(?=(\\Q"), F.replace(col(part), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)?)."))
    at = F.transform(F.regexp_extract_all(col(s), quoted, F.lit(1)), lambda x, i: F.when(x != "", i))
    return F.when(F.length(col(part)) > 0, F.array_compact(at)).when(col(s).isNotNull() & col(part).isNotNull(), F.array().cast("array<int>"))


def both_strand_hits(s: Column | str, part: Column | str) -> Column:
    """array<struct(strand, start)> on either strand; a palindrome is found on both."""
    hit = lambda p, strand: F.transform(find_all(s, p), lambda i: F.struct(F.lit(strand).alias("strand"), i.alias("start")))
    return F.concat(hit(part, "+"), hit(revcomp(part), "-"))


def fragment_status(s: Column | str, part: Column | str) -> Column:
    n = F.size(both_strand_hits(s, part))
    return F.when(col(part).contains("N"), "partial_N").when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("missing")


def join_regions(regions: Column | str, spacer: int = SPACER) -> Column:
    return F.array_join(col(regions), "N" * spacer)


def region_at(regions: Column | str, pos: Column, spacer: int = SPACER) -> Column:
    """struct(region, offset, in_spacer) of a position in joined regions; null beyond them."""
    ends = F.aggregate(F.transform(col(regions), F.length), F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.when(F.size(acc) == 0, n).otherwise(F.element_at(acc, -1) + spacer + n))))
    i = F.size(F.filter(ends, lambda e: e + spacer <= pos))
    begin = F.get(ends, i) - F.length(F.get(col(regions), i))
    return F.when(i < F.size(col(regions)), F.struct(i.alias("region"), (pos - begin).alias("offset"), (pos >= F.get(ends, i)).alias("in_spacer")))


def straddles_spacer(window: Column | str) -> Column:
    return col(window).contains("N")


def rc_position(j: Column, length: int, flank_length: Column) -> Column:
    """Where a window found at j of the reverse complement begins on the forward strand."""
    return flank_length - j - length


def masked_bounds(n: Column, pos: Column, length: Column | int, margin: int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.struct(F.greatest(F.lit(0), pos - margin).alias("lo"), F.least(n, pos + length + margin).alias("hi"))


def side_chunks(a: Column | str, a_bounds: Column, b: Column | str, b_bounds: Column, side: str) -> Column:
    """struct(a, b): what lies beside the masked parts, cut to the common length next to the mask."""
    if side == "left":
        n = F.least(a_bounds["lo"], b_bounds["lo"])
        return F.struct(slice_at(a, a_bounds["lo"] - n, n).alias("a"), slice_at(b, b_bounds["lo"] - n, n).alias("b"))
    n = F.least(F.length(col(a)) - a_bounds["hi"], F.length(col(b)) - b_bounds["hi"])
    return F.struct(slice_at(a, a_bounds["hi"], n).alias("a"), slice_at(b, b_bounds["hi"], n).alias("b"))


def let(value: Column, f) -> Column:
    """f(value), the value being computed once however often f names it (in lambdas too)."""
    return F.get(F.transform(F.array(value), f), 0)


def boundaries(occupied: Column | str, empty: Column | str) -> Column:
    """struct(mismatches, intervals): the deletions of occupied that leave empty with fewest mismatches.
    A deletion's mismatches are those before it and those after it, from running counts."""
    upto = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def counts(t: Column) -> Column:
        n, size = F.size(t["e"]), F.size(t["o"]) - F.size(t["e"])
        return F.struct(n.alias("n"), size.alias("size"), upto(F.slice(t["o"], 1, n), t["e"]).alias("head"), upto(F.slice(t["o"], size + 1, n), t["e"]).alias("tail"))

    def tried(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), c["n"]), lambda i: F.struct((F.get(c["head"], i) + F.element_at(c["tail"], -1) - F.get(c["tail"], i)).alias("mismatches"), i.alias("lo"), (i + c["size"]).alias("hi")))

    def best(all_: Column) -> Column:
        return let(F.struct(F.array_min(F.transform(all_, lambda t: t["mismatches"])).alias("least"), all_.alias("all")), lambda s: F.struct(s["least"].alias("mismatches"), F.transform(F.filter(s["all"], lambda t: t["mismatches"] == s["least"]), lambda t: F.struct(t["lo"].alias("lo"), t["hi"].alias("hi"))).alias("intervals")))

    found = let(F.struct(chars(occupied).alias("o"), chars(empty).alias("e")), lambda t: let(counts(t), lambda c: let(tried(c), best)))
    return F.when(F.length(col(occupied)) >= F.length(col(empty)), found)


def window_hits(nc: Column | str, flank: Column | str, length: int, least: int) -> Column:
    """array<struct(i, j, m)>: pairs of windows with m >= least matches, found before anything is exploded.
    Along each diagonal a window's matches are the difference of two running counts."""

    def diagonal(t: Column, o: Column) -> Column:
        i, j = F.greatest(-o, F.lit(0)), F.greatest(o, F.lit(0))
        n = F.least(F.size(t["a"]) - i, F.size(t["b"]) - j)
        same = F.zip_with(F.slice(t["a"], i + 1, n), F.slice(t["b"], j + 1, n), lambda x, y: ((x == y) & (x < 4)).cast("int"))
        upto = F.aggregate(same, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        m = lambda u, s: F.get(u, s + length) - F.get(u, s)
        return let(upto, lambda u: F.filter(F.transform(F.sequence(F.lit(0), n - length), lambda s: F.struct((i + s).alias("i"), (j + s).alias("j"), m(u, s).alias("m"))), lambda h: h["m"] >= least))

    def hits(t: Column) -> Column:
        every = F.transform(F.sequence(length - F.size(t["a"]), F.size(t["b"]) - length), lambda o: diagonal(t, o))
        long_enough = (F.size(t["a"]) >= length) & (F.size(t["b"]) >= length)
        return F.when(long_enough, F.array_sort(F.flatten(every))).otherwise(F.array().cast("array<struct<i:int,j:int,m:int>>"))

    return let(F.struct(encode(nc).alias("a"), encode(flank).alias("b")), hits)


def seed_repeat(s: Column | str, half: int, least: int, most: int) -> Column:
    """struct(k, gap, word): the longest word that the last ``half`` letters of the first half and the
    first ``half`` of the second share, of equal lengths the nearest pair."""
    mid = F.floor(F.length(col(s)) / 2).cast("int")
    left, right = F.substring(col(s), F.greatest(mid - half, F.lit(0)) + 1, F.least(mid, F.lit(half))), F.substring(col(s), mid + 1, F.lit(half))

    def longest(h: Column) -> Column:
        word = lambda i, k: F.substring(h["left"], i + 1, k)
        hit = lambda i, j, k: F.struct(k.alias("k"), (i - j).alias("near"), (F.length(h["left"]) - i - k + j).alias("gap"), word(i, k).alias("word"))
        at = lambda i, k: let(F.position(word(i, k), h["right"]) - 1, lambda j: F.when((j >= 0) & (k > 0), hit(i, j, k)))
        return F.array_max(F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(half)), lambda i: i + k <= F.length(h["left"])), lambda i: at(i, k)))))

    return let(F.struct(left.alias("left"), right.alias("right")), longest)


def hash_uniform(*parts: Column | str, salt: str = "") -> Column:
    """In [0, 1), from the first 32 bits of md5 of the parts joined by ::, so any engine can repeat it."""
    text = F.concat_ws("::", F.lit(salt), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def content_key(*parts: Column | str) -> Column:
    """sha256 of the parts as JSON, in the order given."""
    return F.sha2(F.to_json(F.struct(*[col(p) for p in parts])), 256)


def wrap_fasta(s: Column | str, width: int = 60) -> Column:
    return F.regexp_replace(col(s), f"(.{{{width}}})(?=.)", "$1\n")


def vector_dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a norm is 0."""
    norm = F.sqrt(vector_dot(a, a)) * F.sqrt(vector_dot(b, b))
    return ratio(vector_dot(a, b), norm)
