"""Queries of sequence, alignment and array operators. Sequences are letters of md5 digests of part
numbers, so that another engine can make them too; every third pair shares a stretch."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import arrays, seq
from siftline.operators import align, match, nulls, topk
from siftline.registry import query, table
from siftline.session import cut, tasks_for

HEX = ("0123456789abcdef", "ACGTACGTACGTACGT")
_MD = "translate(md5('{0}' || p_partkey), '0123456789abcdef', 'ACGTACGTACGTACGT')"
#: k, a (64 letters with some N), b (64 letters; 20 of them a's in every third row), as SQL
PAIRS = f"""
    x AS (SELECT p_partkey AS k, {_MD.format("a")} || {_MD.format("b")} AS a0, {_MD.format("c")} || {_MD.format("d")} AS b0 FROM part),
    s AS (SELECT k, replace(a0, 'AAA', 'ANA') AS a, CASE WHEN k % 3 = 0 THEN substr(b0, 1, CAST(k % 40 AS BIGINT)) || substr(a0, 11, 20) || substr(b0, CAST(k % 40 + 21 AS BIGINT)) ELSE b0 END AS b FROM x)"""


def pairs(spark, sf_dir):
    """Written once: rows are dealt to tasks before anything is made of them, and no filter further on is
    worked out in the scan's one task. A scan packs what is written by bytes, so rows are dealt again, so
    many to a task: what is made of a row is a hundred times as large, and a task's share must not grow."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(k)
    n = tasks_for(part)
    md = lambda c: F.translate(F.md5(F.concat(F.lit(c), k.cast("string"))), *HEX)
    x = part.repartition(n, k).select(k.alias("k"), F.concat(md("a"), md("b")).alias("a0"), F.concat(md("c"), md("d")).alias("b0"))
    at = (F.col("k") % 40).cast("int")
    planted = F.concat(F.substring(F.col("b0"), F.lit(1), at), F.substring("a0", 11, 20), F.substring(F.col("b0"), at + 21, F.lit(64)))
    return cut(x.select("k", F.replace("a0", F.lit("AAA"), F.lit("ANA")).alias("a"), F.when(F.col("k") % 3 == 0, planted).otherwise(F.col("b0")).alias("b")), "pairs").repartition(n, "k")


def joined(a) -> F.Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


@query(f"""WITH {PAIRS}, c AS (SELECT k, regexp_replace(translate(a, 'ACGT', '0123'), '[^0-3]', '4', 'g') AS codes FROM s)
    SELECT k, codes, replace(replace(replace(replace(replace(translate(codes, '01234', 'ABCDE'), 'A', '1000'), 'B', '0100'), 'C', '0010'), 'D', '0001'), 'E', '0000') AS hot FROM c""")
def seq_codes(spark, sf_dir):
    hot = F.flatten(F.transform(seq.one_hot("a"), lambda r: F.transform(r, lambda v: v.cast("int").cast("string"))))
    return pairs(spark, sf_dir).select("k", F.array_join(F.transform(seq.encode("a"), lambda c: c.cast("string")), "").alias("codes"), F.array_join(hot, "").alias("hot"))


@query(f"""WITH {PAIRS}
    SELECT k, array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN substr(a, i, 1) = 'N' OR substr(b, i, 1) = 'N' THEN 0 ELSE CAST(sign(strpos('ACGT', substr(a, i, 1)) - strpos('ACGT', substr(b, i, 1))) AS INTEGER) END), ',') AS fusion,
           CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN substr(a, i, 1) <> substr(b, i, 1) THEN 1 ELSE 0 END)) AS BIGINT) AS hamming,
           CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN substr(a, i, 1) = substr(b, i, 1) AND substr(a, i, 1) <> 'N' THEN 1 ELSE 0 END)) AS BIGINT) AS strict,
           CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (substr(a, i, 1) = substr(b, i, 1) AND substr(a, i, 1) <> 'N') OR (substr(a, i, 1) || substr(b, i, 1)) IN ('GT', 'TG') THEN 1 ELSE 0 END)) AS BIGINT) AS wobble
    FROM s""")
def seq_pair_counts(spark, sf_dir):
    return pairs(spark, sf_dir).select("k", joined(seq.fusion("a", "b")).alias("fusion"), seq.hamming("a", "b").cast("long").alias("hamming"), seq.matches("a", "b").cast("long").alias("strict"), seq.matches("a", "b", True).cast("long").alias("wobble"))


@query(f"""WITH {PAIRS},
    w AS (SELECT k, substr(b, i, 2) AS w, count(*) AS c FROM s, unnest(range(1, 64)) AS t(i) GROUP BY 1, 2),
    d AS (SELECT k, -sum(c / 63.0 * log2(c / 63.0)) AS h2 FROM w GROUP BY 1),
    o AS (SELECT k, substr(b, i, 1) AS w, count(*) AS c FROM s, unnest(range(1, 65)) AS t(i) GROUP BY 1, 2),
    h AS (SELECT k, -sum(c / 64.0 * log2(c / 64.0)) AS h1 FROM o GROUP BY 1),
    l AS (SELECT k, i - row_number() OVER (PARTITION BY k, substr(b, i, 1) ORDER BY i) AS g, substr(b, i, 1) AS c FROM s, unnest(range(1, 65)) AS t(i)),
    r AS (SELECT k, max(n) AS run FROM (SELECT k, c, g, count(*) AS n FROM l GROUP BY 1, 2, 3) GROUP BY 1)
    SELECT k, round(h2, 6) AS pair_entropy, round(h1 / 2 * least(h2 / 2.5, 1) * greatest(0, 1 - run / 64.0), 6) AS complexity FROM d JOIN h USING (k) JOIN r USING (k)""")
def seq_complexity(spark, sf_dir):
    return pairs(spark, sf_dir).select("k", F.round(seq.dinucleotide_entropy("b"), 6).alias("pair_entropy"), F.round(seq.complexity("b"), 6).alias("complexity"))


@query(f"""WITH {PAIRS},
    t AS (SELECT k, o, substr(a, greatest(o, 0) + 1) AS x, substr(b, greatest(-o, 0) + 1) AS y FROM s, unnest(range(-5, 6)) AS t(o)),
    n AS (SELECT k, o, x, y, least(length(x), length(y)) AS n FROM t),
    i AS (SELECT k, o, n, list_sum(list_transform(range(1, CAST(n + 1 AS BIGINT)), lambda j: CASE WHEN substr(x, j, 1) = substr(y, j, 1) THEN 1 ELSE 0 END)) / n AS identity FROM n WHERE n >= 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY identity DESC, abs(o), o DESC) AS p FROM i)
    SELECT k, round(identity, 9) AS identity, CAST(o AS INTEGER) AS "offset", CAST(n AS INTEGER) AS n FROM r WHERE p = 1""")
def seq_offset_identity(spark, sf_dir):
    return pairs(spark, sf_dir).select("k", seq.offset_identity("a", "b").alias("r")).select("k", F.round("r.identity", 9).alias("identity"), "r.offset", "r.n")


@query(f"""WITH {PAIRS}, p AS (SELECT k, b, substr(b, CAST(k % 50 + 1 AS BIGINT), 4) AS w, reverse(translate(substr(b, CAST(k % 50 + 1 AS BIGINT), 4), 'ACGT', 'TGCA')) AS v FROM s),
    h AS (SELECT k, list_filter(range(0, 61), lambda i: substr(b, i + 1, 4) = w) AS f, list_filter(range(0, 61), lambda i: substr(b, i + 1, 4) = v) AS r FROM p)
    SELECT k, array_to_string(f, ',') AS fwd, array_to_string(r, ',') AS rc, CASE WHEN len(f) + len(r) = 1 THEN 'unique' WHEN len(f) + len(r) > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM h""")
def seq_fragment_status(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("w", seq.slice_at("b", F.col("k") % 50, 4)).withColumn("hits", seq.both_strand_hits("b", "w"))
    of = lambda s: joined(F.transform(F.filter("hits", lambda h: h["strand"] == s), lambda h: h["start"]))
    return p.select("k", of("+").alias("fwd"), of("-").alias("rc"), seq.fragment_status("b", "w").alias("status"))


@query(f"""WITH {PAIRS}, r AS (SELECT k, [substr(a, 1, 20), substr(a, 21, 15), substr(a, 36, 10)] AS r, k % 90 AS p FROM s)
    SELECT k, array_to_string(r, repeat('N', 13)) AS whole, CASE WHEN p < 33 THEN 0 WHEN p < 61 THEN 1 WHEN p < 84 THEN 2 END AS region,
           CAST(CASE WHEN p < 33 THEN p WHEN p < 61 THEN p - 33 WHEN p < 84 THEN p - 61 END AS INTEGER) AS "offset", CASE WHEN p < 84 THEN (p >= 20 AND p < 33) OR (p >= 48 AND p < 61) OR p >= 71 END AS in_spacer FROM r""")
def seq_regions(spark, sf_dir):
    r = pairs(spark, sf_dir).select("k", F.array(F.substring("a", 1, 20), F.substring("a", 21, 15), F.substring("a", 36, 10)).alias("r"))
    return r.select("k", seq.join_regions("r").alias("whole"), seq.region_at("r", (F.col("k") % 90).cast("int")).alias("p")).select("k", "whole", "p.region", "p.offset", "p.in_spacer")


@query(f"""WITH {PAIRS}, e AS (SELECT k, b, substr(b, 1, CAST(k % 44 AS BIGINT)) || substr(b, CAST(k % 44 + 21 AS BIGINT)) AS e FROM s),
    t AS (SELECT k, i, list_sum(list_transform(range(1, 45), lambda j: CASE WHEN substr(substr(b, 1, i) || substr(b, i + 21), j, 1) <> substr(e, j, 1) THEN 1 ELSE 0 END)) AS m FROM e, unnest(range(0, 45)) AS t(i)),
    l AS (SELECT k, i, m, min(m) OVER (PARTITION BY k) AS least FROM t)
    SELECT k, CAST(least AS INTEGER) AS mismatches, string_agg(i || '-' || (i + 20), ',' ORDER BY i) AS intervals FROM l WHERE m = least GROUP BY 1, 2""")
def seq_boundaries(spark, sf_dir):
    at = (F.col("k") % 44).cast("int")
    e = pairs(spark, sf_dir).withColumn("e", F.concat(F.substring(F.col("b"), F.lit(1), at), F.substring(F.col("b"), at + 21, F.lit(64))))
    return e.select("k", seq.boundaries("b", "e").alias("r")).select("k", F.col("r.mismatches").cast("int").alias("mismatches"), F.array_join(F.transform("r.intervals", lambda t: F.concat_ws("-", t["lo"].cast("string"), t["hi"].cast("string"))), ",").alias("intervals"))


@query(f"""WITH {PAIRS}, w AS (SELECT k, i, j, list_sum(list_transform(range(1, 9), lambda o: CASE WHEN substr(a, i + o, 1) = substr(b, j + o, 1) AND substr(a, i + o, 1) <> 'N' THEN 1 ELSE 0 END)) AS m FROM s, unnest(range(0, 25)) AS t(i), unnest(range(0, 25)) AS u(j))
    SELECT k, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(m AS INTEGER) AS m FROM w WHERE m >= 7""")
def seq_window_hits(spark, sf_dir):
    p = pairs(spark, sf_dir).select("k", F.substring("a", 1, 32).alias("a"), F.substring("b", 1, 32).alias("b"))
    return match.window_matches(p, ["k"], "a", "b", [8], lambda n: n - 1, ("fwd",), with_n=True).select("k", "i", F.col("f").alias("j"), "m")


@query(f"""WITH {PAIRS}, h AS (SELECT k, substr(b, 17, 16) AS l, substr(b, 33, 16) AS r FROM s),
    t AS (SELECT k, n, i, l, list_min(list_filter(range(0, 17 - n), lambda j: substr(r, j + 1, n) = substr(l, i + 1, n))) AS j FROM h, unnest(range(3, 7)) AS t(n), unnest(range(0, 17)) AS u(i) WHERE i + n <= 16),
    o AS (SELECT k, n, 16 - i - n + j AS gap, substr(l, i + 1, n) AS word, row_number() OVER (PARTITION BY k ORDER BY n DESC, i - j DESC, 16 - i - n + j DESC, substr(l, i + 1, n) DESC) AS p FROM t WHERE j IS NOT NULL)
    SELECT k, CAST(n AS INTEGER) AS n, CAST(gap AS INTEGER) AS gap, word FROM o WHERE p = 1""")
def seq_seed_repeat(spark, sf_dir):
    r = pairs(spark, sf_dir).select("k", seq.seed_repeat("b", 16, 3, 6).alias("r")).where("r is not null")
    return r.select("k", F.col("r.k").alias("n"), "r.gap", "r.word")


_GAPS = "greatest(0, CAST(k % 50 AS BIGINT) - 5) AS a_lo, least(64, CAST(k % 50 AS BIGINT) + 16) AS a_hi, greatest(0, CAST(k % 47 AS BIGINT) - 5) AS b_lo, least(64, CAST(k % 47 AS BIGINT) + 16) AS b_hi"


@query(f"""WITH {PAIRS}, m AS (SELECT k, a, b, {_GAPS} FROM s)
    SELECT k, substr(a, a_lo - least(a_lo, b_lo) + 1, least(a_lo, b_lo)) AS left_a, substr(b, b_lo - least(a_lo, b_lo) + 1, least(a_lo, b_lo)) AS left_b,
           substr(a, a_hi + 1, least(64 - a_hi, 64 - b_hi)) AS right_a, substr(b, b_hi + 1, least(64 - a_hi, 64 - b_hi)) AS right_b FROM m""")
def seq_side_chunks(spark, sf_dir):
    bounds = lambda c, n: seq.masked_bounds(F.length(c), (F.col("k") % n).cast("int"), 11, 5)
    p = pairs(spark, sf_dir).withColumns({s: seq.side_chunks("a", bounds("a", 50), "b", bounds("b", 47), s) for s in ("left", "right")})
    return p.select("k", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("left", "right") for c in "ab"])


_CODONS = "substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(16 * (strpos('TCAG', substr(t, 3 * i + 1, 1)) - 1) + 4 * (strpos('TCAG', substr(t, 3 * i + 2, 1)) - 1) + strpos('TCAG', substr(t, 3 * i + 3, 1)) AS BIGINT), 1)"


@query(f"""WITH {PAIRS}, f AS (SELECT k, '+' AS strand, f, substr(b, f + 1) AS t FROM s, unnest(range(0, 3)) AS t(f) UNION ALL SELECT k, '-', f, substr(reverse(translate(b, 'ACGT', 'TGCA')), f + 1) FROM s, unnest(range(0, 3)) AS t(f)),
    a AS (SELECT k, strand, f, string_agg({_CODONS}, '' ORDER BY i) AS aa FROM f, unnest(range(0, 21)) AS t(i) WHERE 3 * i + 3 <= length(t) GROUP BY 1, 2, 3),
    o AS (SELECT k, strand, f, unnest(string_split(aa, '*')) AS protein, generate_subscripts(string_split(aa, '*'), 1) AS n, string_split(aa, '*') AS all_ FROM a)
    SELECT k, strand, CAST(f AS INTEGER) AS frame, CAST(coalesce(list_sum(list_transform(all_[1:n - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS start, protein FROM o WHERE length(protein) >= 8""")
def align_open_frames(spark, sf_dir):
    return align.open_frames(pairs(spark, sf_dir), ["k"], "b", 8)


@query(f"""WITH {PAIRS}, h AS (SELECT k, substr(a, 1, 30) AS x, reverse(translate(right(b, 30), 'ACGT', 'TGCA')) AS y FROM s),
    m AS (SELECT k, i, j, i - j AS d FROM h, unnest(range(0, 26)) AS t(i), unnest(range(0, 26)) AS u(j) WHERE substr(x, i + 1, 5) = substr(y, j + 1, 5)),
    g AS (SELECT k, d, i, j, i - row_number() OVER (PARTITION BY k, d ORDER BY i) AS run FROM m),
    r AS (SELECT k, d, run, count(*) + 4 AS length, min(i) AS l, min(j) AS r FROM g GROUP BY 1, 2, 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length DESC, l, r) AS p FROM r)
    SELECT k, length, CAST(l AS INTEGER) AS "left", CAST(r AS INTEGER) AS "right" FROM o WHERE p = 1""")
def align_end_repeat(spark, sf_dir):
    return align.end_repeat(pairs(spark, sf_dir).withColumn("s", F.concat("a", "b")), ["k"], "s", 30, 5, True)


@query("""
    WITH i AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS lo, CAST(l_quantity + l_linenumber - 2 AS INTEGER) AS hi, CAST(l_partkey % 100 AS INTEGER) AS s_lo, CAST(l_partkey % 100 + 60 AS INTEGER) AS s_hi,
                      CASE l_returnflag WHEN 'A' THEN '+' WHEN 'N' THEN '-' ELSE '?' END AS strand, CASE WHEN l_linenumber = 6 THEN 'missing' WHEN l_linenumber = 7 THEN 'ambiguous' WHEN l_linenumber = 5 THEN 'partial_N' ELSE 'unique' END AS st FROM lineitem),
    p AS (SELECT *, CASE WHEN strand = '-' THEN s_hi - hi ELSE s_lo + lo END AS a, CASE WHEN strand = '-' THEN s_hi - lo ELSE s_lo + hi END AS b FROM i),
    q AS (SELECT *, CASE WHEN hi <= lo THEN 'empty_interval' WHEN st = 'missing' THEN 'source_missing' WHEN st = 'ambiguous' THEN 'source_ambiguous' WHEN st = 'partial_N' THEN 'source_partial' WHEN strand = '?' THEN 'strand_unknown' WHEN a < 0 OR b > 130 THEN 'out_of_range' END AS bad FROM p)
    SELECT k, n, coalesce(bad, 'projected') AS status, CASE WHEN bad IS NULL THEN a END AS lo, CASE WHEN bad IS NULL THEN b END AS hi FROM q""")
def align_project_interval(spark, sf_dir):
    c, n = F.col, F.col("l_linenumber")
    lo, at = c("l_quantity").cast("int"), (c("l_partkey") % 100).cast("int")
    strand = F.when(c("l_returnflag") == "A", "+").when(c("l_returnflag") == "N", "-").otherwise("?")
    status = F.when(n == 6, "missing").when(n == 7, "ambiguous").when(n == 5, "partial_N").otherwise("unique")
    p = align.project_interval(lo, (c("l_quantity") + n - 2).cast("int"), at, at + 60, strand, status, F.lit(130))
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("k"), n.alias("n"), p.alias("p")).select("k", "n", "p.status", "p.lo", "p.hi")


_ALIGN_GLOBAL = """
    r AS (SELECT k, x, y, 0 AS i, CAST(j AS INTEGER) AS j, CASE WHEN j = 0 THEN 0 ELSE -(1::BIGINT << 60) END AS p, -(1::BIGINT << 60) AS d, CASE WHEN j > 0 THEN (-1 - j) * (1::BIGINT << 40) ELSE -(1::BIGINT << 60) END AS g
          FROM u, unnest(range(0, length(y) + 1)) AS t(j)
          UNION ALL SELECT k, x, y, i, j, p, d, coalesce(max(greatest(p, d) + j * (1::BIGINT << 40)) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + (-1 - j) * (1::BIGINT << 40), -(1::BIGINT << 60)) AS g
          FROM (SELECT k, x, y, i + 1 AS i, j, coalesce(lag(greatest(p, d, g)) OVER (PARTITION BY k ORDER BY j)
                       + CASE WHEN substr(x, i + 1, 1) = substr(y, j, 1) THEN (1::BIGINT << 40) ELSE -(1::BIGINT << 40) END + (1 << 20) + CASE WHEN substr(x, i + 1, 1) = substr(y, j, 1) AND contains('ACGT', substr(y, j, 1)) THEN 1 ELSE 0 END, -(1::BIGINT << 60)) AS p,
                       greatest(greatest(p, g) - 2 * (1::BIGINT << 40), d - (1::BIGINT << 40)) AS d FROM r WHERE i < length(x))),
    v AS (SELECT k, x, y, greatest(p, d, g) AS v FROM r WHERE i = length(x) AND j = length(y)),
    m AS (SELECT k, x, y, v >> 40 AS score, (v >> 20) & 1048575 AS paired_bp, v & 1048575 AS matches FROM v)"""


@query(f"""WITH RECURSIVE {PAIRS}, u AS (SELECT k, a AS x, substr(b, 1, CAST(30 + k % 35 AS BIGINT)) AS y FROM s), {_ALIGN_GLOBAL}
    SELECT k, score, paired_bp, matches, paired_bp - matches AS mismatches, length(x) + length(y) - 2 * paired_bp AS indels, round(matches / greatest(paired_bp, 1), 9) AS identity,
           round(paired_bp / least(length(x), length(y)), 9) AS coverage_shorter, round(paired_bp / greatest(length(x), length(y)), 9) AS coverage_longer FROM m""")
def align_global(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("y", F.substring(F.col("b"), F.lit(1), (30 + F.col("k") % 35).cast("int")))
    found = align.aligned_global(p, "a", "y")
    whole = ["score", "paired_bp", "matches", "mismatches", "indels"]
    return p.join(found, ["a", "y"]).select("k", *whole, *[F.round(c, 9).alias(c) for c in ("identity", "coverage_shorter", "coverage_longer")])


@query(f"""WITH RECURSIVE {PAIRS},
    r AS (SELECT k, a, b, 0 AS i, CAST(j AS INTEGER) AS j, 0::BIGINT AS h FROM s, unnest(range(0, 65)) AS t(j)
          UNION ALL SELECT k, a, b, i, j, greatest(p, max(p + j * ((1::BIGINT << 40) + 1)) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - j * ((1::BIGINT << 40) + 1)) AS h
          FROM (SELECT k, a, b, i + 1 AS i, j, CASE WHEN j = 0 THEN 0 ELSE greatest(0, lag(h) OVER (PARTITION BY k ORDER BY j) + CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN (1::BIGINT << 40) + (1 << 20) ELSE 0 END - 1, h - (1::BIGINT << 40) - 1) END AS p FROM r WHERE i < 64)),
    v AS (SELECT k, max(h) AS h FROM r GROUP BY k), c AS (SELECT k, h, (1048576 - h % 1048576) % 1048576 AS columns FROM v)
    SELECT k, (h + columns) >> 40 AS score, ((h + columns) >> 20) & 1048575 AS matches, columns FROM c""")
def align_local(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.join(align.aligned_local(p, "a", "b"), ["a", "b"]).select("k", "score", "matches", "columns")


@query(f"""WITH RECURSIVE {PAIRS},
    w AS (SELECT k, replace(substr(a, 1, 20), 'N', CASE WHEN k % 2 = 0 THEN 'C' ELSE 'N' END) AS la, substr(b, CAST(k % 9 + 1 AS BIGINT), 18) AS lb, substr(b, 40, CAST(k % 25 AS BIGINT)) AS ra, substr(b, 41, 20) AS rb FROM s),
    u AS (SELECT 2 * k AS k, la AS x, lb AS y FROM w UNION ALL SELECT 2 * k + 1, ra, rb FROM w), {_ALIGN_GLOBAL},
    e AS (SELECT k, paired_bp, matches / greatest(paired_bp, 1) AS identity, regexp_full_match(x || y, '[ACGT]+') AND x <> '' AND paired_bp >= 10 AND paired_bp / greatest(length(x), length(y)) >= 0.5 AS ok FROM m),
    c AS (SELECT w.k, l.ok AS lo, r.ok AS ro, l.identity AS li, r.identity AS ri, l.paired_bp AS lp, r.paired_bp AS rp, l.ok AND (NOT r.ok OR (l.identity, l.paired_bp) >= (r.identity, r.paired_bp)) AS first FROM w JOIN e l ON l.k = 2 * w.k JOIN e r ON r.k = 2 * w.k + 1)
    SELECT k, lo AS left_ok, ro AS right_ok, CASE WHEN first THEN 'left' WHEN ro THEN 'right' ELSE 'none' END AS side, round(CASE WHEN first THEN li WHEN ro THEN ri END, 9) AS identity, CASE WHEN first THEN lp WHEN ro THEN rp END AS paired_bp FROM c""")
def align_side(spark, sf_dir):
    """Both sides of a pair against each other, and the one that speaks for the background."""
    c, at = F.col, lambda s, start, n: F.substring(F.col(s), start if isinstance(start, F.Column) else F.lit(start), n if isinstance(n, F.Column) else F.lit(n))
    known = F.when(c("k") % 2 == 0, F.replace(at("a", 1, 20), F.lit("N"), F.lit("C"))).otherwise(at("a", 1, 20))
    w = pairs(spark, sf_dir).select("k", known.alias("la"), at("b", (c("k") % 9 + 1).cast("int"), 18).alias("lb"), at("b", 40, (c("k") % 25).cast("int")).alias("ra"), at("b", 41, 20).alias("rb"))
    found = align.sides(w, ("la", "lb"), ("ra", "rb"), 10, 0.5)
    return found.select("k", c("left.eligible").alias("left_ok"), c("right.eligible").alias("right_ok"), "chosen.side", F.round("chosen.metrics.identity", 9).alias("identity"), "chosen.metrics.paired_bp")


def _windows(a: str, b: str, n: str, m: str, last: str, held: str = "x") -> str:
    """SQL of the hits of two texts, in windows that begin at n places of one and m of the other, the last of them ``last``."""
    return f"""WITH {PAIRS},
    f AS (SELECT k, 'fwd' AS orient, {a} AS x, {b} AS y FROM s UNION ALL SELECT k, 'rc', {a}, reverse(translate({b}, 'ACGT', 'TGCA')) FROM s),
    w AS (SELECT k, orient, i, j, {held}, list_sum(list_transform(range(1, 10), lambda o: CASE WHEN substr(x, i + o, 1) = substr(y, j + o, 1) AND substr(x, i + o, 1) <> 'N' THEN 1 ELSE 0 END)) AS m FROM f, unnest(range(0, {n})) AS t(i), unnest(range(0, {m})) AS u(j)),
    h AS (SELECT k, orient, CAST(i AS INTEGER) AS i, CAST(CASE WHEN orient = 'fwd' THEN j ELSE {last} - j END AS INTEGER) AS f, CAST(m AS INTEGER) AS m FROM w WHERE m >= 7 AND NOT contains(substr(x, i + 1, 9), 'N'))"""


_WINDOWS = _windows("substr(a, 1, 40)", "substr(b, 1, 40)", "32", "32", "31")


def whole_hits(spark, sf_dir):
    return match.window_matches(pairs(spark, sf_dir), ["k"], "a", "b", [9], lambda n: 7)


def window_hits(spark, sf_dir):
    """The hits of the first 40 letters, which is what the SQL of match_windows, match_admission and match_pooled takes."""
    p = pairs(spark, sf_dir).select("k", F.substring("a", 1, 40).alias("a"), F.substring("b", 1, 40).alias("b"))
    return match.window_matches(p, ["k"], "a", "b", [9], lambda n: 7)


@query(_WINDOWS + " SELECT k, orient, i, f, m FROM h")
def match_windows(spark, sf_dir):
    return window_hits(spark, sf_dir).drop("L")


_BEST = """, e AS (SELECT k, orient, i, excl, max(m) FILTER (f >= excl) AS m FROM h, unnest([0, 10, 20]) AS t(excl) GROUP BY 1, 2, 3, 4),
    t AS (SELECT e.k, e.orient, e.i, e.excl, coalesce(e.m, 0) AS m, coalesce(min(h.f), -1) AS f FROM e LEFT JOIN h ON h.k = e.k AND h.orient = e.orient AND h.i = e.i AND h.m = e.m AND h.f >= e.excl GROUP BY 1, 2, 3, 4, e.m)"""
_TABLE = _WINDOWS + _BEST


def best_table(hits):
    return match.match_table(hits, ["k"], [0, 10, 20])


@query(_windows("a", "b", "length(x) - 8", "length(y) - 8", "length(y) - 9", "x, y") + _BEST + " SELECT k, orient, i, CAST(excl AS INTEGER) AS excl, m, f FROM t")
def match_best(spark, sf_dir):
    """Of the whole texts."""
    return best_table(whole_hits(spark, sf_dir)).drop("L")


@query(_TABLE + """, a AS (SELECT 'm' AS rule, * FROM t WHERE m >= 8 UNION ALL SELECT 'e', * FROM t WHERE pow(0.25, m) * (40 - excl) < 0.0005
    UNION ALL SELECT 'top', k, orient, i, excl, m, f FROM (SELECT *, row_number() OVER (PARTITION BY k, orient ORDER BY pow(0.25, m), i) AS n FROM t WHERE excl = 0) WHERE n <= 2)
    SELECT rule, k, orient, i, CAST(excl AS INTEGER) AS excl, m, f FROM a""")
def match_admission(spark, sf_dir):
    """The three rules by which positions are admitted."""
    t = best_table(window_hits(spark, sf_dir)).drop("L")
    e = F.pow(F.lit(0.25), F.col("m"))
    parts = {"m": match.admit(t, ["k"], "m", 8), "e": match.admit(t, ["k"], "e", 0.0005, e * (40 - F.col("excl"))), "top": match.admit(t.where("excl = 0"), ["k"], "top", 2, e)}
    a, b, c = [df.withColumn("rule", F.lit(name)) for name, df in parts.items()]
    return a.unionByName(b).unionByName(c)


@query(_WINDOWS + """, g AS (SELECT k, orient, i, count(*) AS s FROM h GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY s DESC, orient = 'fwd' DESC) AS n FROM g)
    SELECT k, i, s, orient FROM o WHERE n = 1""")
def match_pooled(spark, sf_dir):
    counts = window_hits(spark, sf_dir).groupBy("k", "orient", "i").agg(F.count(F.lit(1)).alias("s"))
    return match.pooled(counts, ["k"], "i", "s")


@query(f"""WITH {PAIRS}, w AS (SELECT k, substr(b, CAST(k % 50 + 1 AS BIGINT), 11) AS w, substr(a, CAST(k % 50 + 1 AS BIGINT), 11) AS v FROM s),
    u AS (SELECT k, 'guide' AS side, w FROM w UNION ALL SELECT k, 'target', v FROM w),
    l AS (SELECT k, side, w, substr(w, i, 1) AS c, i - row_number() OVER (PARTITION BY k, side, substr(w, i, 1) ORDER BY i) AS g FROM u, unnest(range(1, 12)) AS t(i)),
    r AS (SELECT k, side, max(n) AS run FROM (SELECT k, side, c, g, count(*) AS n FROM l GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
    q AS (SELECT k, side, count(*) FILTER (c = 'A' OR c = 'T') AS weak, count(*) FILTER (c <> 'N') AS n FROM l GROUP BY 1, 2),
    e AS (SELECT k, side, -sum(c / t * log2(c / t)) AS h FROM (SELECT k, side, c AS x, count(*) AS c, sum(count(*)) OVER (PARTITION BY k, side) AS t FROM l WHERE c <> 'N' GROUP BY 1, 2, 3) GROUP BY 1, 2),
    p AS (SELECT k, side, list_transform([1, 2, 3, 4], lambda d: list_sum(list_transform(range(1, 12 - d), lambda i: CASE WHEN substr(w, i, 1) = substr(w, i + d, 1) THEN 1 ELSE 0 END)) / (11.0 - d)) AS p FROM u),
    z AS (SELECT r.k, r.side, unnest(list_filter([CASE WHEN run >= 4 THEN 'homopolymer' END, CASE WHEN p.p[1] >= 0.6 THEN 'period1' END, CASE WHEN p.p[2] >= 0.6 THEN 'period2' END, CASE WHEN p.p[3] >= 0.6 THEN 'period3' END, CASE WHEN p.p[4] >= 0.6 THEN 'period4' END,
          CASE WHEN weak / n >= 0.8 THEN 'at_frac' END, CASE WHEN h < 1.5 THEN 'entropy' END], lambda x: x IS NOT NULL)) AS reason FROM r JOIN q USING (k, side) JOIN e USING (k, side) JOIN p USING (k, side))
    SELECT side, reason, count(*) AS n FROM z GROUP BY 1, 2""")
def match_gate_reasons(spark, sf_dir):
    """Which complexity tests guides and targets fail, and how often."""
    w = pairs(spark, sf_dir).select("k", seq.slice_at("b", F.col("k") % 50, 11).alias("guide"), seq.slice_at("a", F.col("k") % 50, 11).alias("target"))
    return match.gate(w, "guide", "target", run=4, period=0.6, at=0.8, bits=1.5)[1]


@query("""
    WITH p AS (SELECT c_custkey AS k, [c_custkey % 7, c_custkey % 5, c_custkey % 3, c_custkey % 2] AS m, [1.5, 2.5, NULL, c_acctbal] AS a FROM customer)
    SELECT k, array_to_string(list_transform(range(0, 7), lambda t: coalesce(CAST(list_position(m, t) - 1 AS VARCHAR), '-')), ',') AS inverse,
           array_to_string(list_transform([3, 0, -1, 9, 2], lambda i: CAST(CASE WHEN i < 0 OR i > 3 THEN 0 ELSE coalesce(a[i + 1], 0) END AS DECIMAL(20, 2))), ',') AS projected,
           array_to_string(list_transform([1, 2, 3, 4, 5, 6], lambda i: CASE WHEN i <= 4 THEN m[i] ELSE 9 END), ',') AS fitted FROM p""")
def array_projection(spark, sf_dir):
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("k"), F.array(k % 7, k % 5, k % 3, k % 2).alias("m"), F.array(F.lit(1.5), F.lit(2.5), F.lit(None).cast("double"), F.col("c_acctbal")).alias("a"))
    inverse = F.array_join(F.transform(arrays.invert("m", 7), lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
    moved = arrays.project("a", F.array(*map(F.lit, (3, 0, -1, 9, 2))), F.lit(0.0))
    return p.select("k", inverse.alias("inverse"), F.array_join(F.transform(moved, lambda x: x.cast("decimal(20,2)").cast("string")), ",").alias("projected"), joined(arrays.fit_length("m", 6, F.lit(9).cast("long"))).alias("fitted"))


@query(f"""WITH {PAIRS}, p AS (SELECT k, b, CAST(k % 40 AS BIGINT) AS lo, 11 AS n, 1 + CAST(floor((CAST(('0x' || substr(md5('0::' || k), 1, 8)) AS BIGINT) / 4294967296.0) * 63) AS BIGINT) AS turn FROM s)
    SELECT k, substr(b, 1, lo) || reverse(translate(substr(b, lo + 1, n), 'ACGT', 'TGCA')) || substr(b, lo + n + 1) AS orientation, substr(b, turn + 1) || substr(b, 1, turn) AS position, substr(b, 1, lo) || reverse(substr(b, lo + 1, n)) || substr(b, lo + n + 1) AS target FROM p""")
def null_counterfactuals(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumns({"lo": (F.col("k") % 40).cast("int"), "n": F.lit(11)})
    made = [nulls.counterfactual(p, "k", kind, "a", "b", "lo", "n").select("k", F.col("b").alias(kind)) for kind in ("orientation", "position", "target")]
    return made[0].join(made[1], "k").join(made[2], "k")


@query(f"""WITH {PAIRS}, p AS (SELECT k, a, b, CASE WHEN k % 5 = 0 THEN a || 'A' ELSE a END AS a2, CASE WHEN k % 7 = 0 THEN reverse(b) WHEN k % 11 = 0 THEN substr(b, 2) ELSE b END AS b2 FROM s)
    SELECT k, unnest(list_filter([CASE WHEN a <> a2 THEN 'changed:a' END, CASE WHEN length(b) <> length(b2) THEN 'length:b' END], lambda x: x IS NOT NULL)) AS problem FROM p""")
def null_broken_invariants(spark, sf_dir):
    p, k = pairs(spark, sf_dir), F.col("k")
    changed = p.select("k", F.when(k % 5 == 0, F.concat("a", F.lit("A"))).otherwise(F.col("a")).alias("a"), F.when(k % 7 == 0, F.reverse("b")).when(k % 11 == 0, F.substring("b", 2, 64)).otherwise(F.col("b")).alias("b"))
    return nulls.broken_invariants(p, changed, "k", ["a"], ["b"])


@query("""
    WITH RECURSIVE g AS (SELECT DISTINCT CAST(p_size % 6 + 6 AS INTEGER) AS length, CAST(p_partkey % 4 AS INTEGER) AS n_mm FROM part),
    r AS (SELECT length, n_mm, []::INTEGER[] AS positions FROM g UNION ALL SELECT length, n_mm, list_append(positions, CAST(p AS INTEGER)) FROM r, unnest(range(0, 12)) AS t(p) WHERE len(positions) < n_mm AND p < length AND p > coalesce(list_max(positions), -1))
    SELECT length, n_mm, CAST(row_number() OVER (PARTITION BY length, n_mm ORDER BY positions) - 1 AS INTEGER) AS class, array_to_string(positions, ',') AS positions FROM r WHERE len(positions) = n_mm""")
def null_mismatch_classes(spark, sf_dir):
    """All places of mismatches for the lengths and numbers that parts give."""
    words = table(spark, sf_dir, "part").select((F.col("p_size") % 6 + 6).alias("length"), (F.col("p_partkey") % 4).alias("n_mm"))
    return nulls.mismatch_classes(words, "length", "n_mm").select("length", "n_mm", "class", joined(F.col("positions")).alias("positions"))


@query("""
    WITH r AS (SELECT CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS BIGINT) AS m, avg(l_discount) AS rate FROM lineitem GROUP BY 1, 2),
    o AS (SELECT n, m, row_number() OVER (PARTITION BY n ORDER BY rate < 0.048, abs(ln(rate / 0.05)), m) AS p FROM r) SELECT n, m FROM o WHERE p = 1""")
def null_target_matches(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("long").alias("m")).agg(F.avg("l_discount").alias("rate"))
    return nulls.target_matches(r, "n", "m", "rate", 0.05, 0.048)


@query(f"""WITH {PAIRS}, w AS (SELECT k % 20 AS g, k, CAST(i AS INTEGER) AS start, substr(a, CAST(i + 1 AS BIGINT), 12) AS word FROM s, unnest(range(0, 53)) AS t(i)),
    v AS (SELECT *, -ln(1 - CAST(('0x' || substr(md5('3::' || k || '::' || start), 1, 8)) AS BIGINT) / 4294967296.0) / (1 + length(regexp_replace(word, '[^GC]', '', 'g'))) AS x FROM w WHERE NOT contains(word, 'N')),
    o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x, k, start) AS n FROM v) SELECT g, k, start, word FROM o WHERE n <= 25""")
def sample_windows(spark, sf_dir):
    """25 windows without N of each group of sequences, those with more G and C more likely."""
    weight = 1 + F.length(F.regexp_replace("word", "[^GC]", ""))
    return topk.sample_windows(pairs(spark, sf_dir).withColumn("g", F.col("k") % 20), ["g"], ["k"], "a", 12, 25, 3, weight=weight)


@query(f"""WITH {PAIRS}, r AS (SELECT k, reverse(translate(a, 'ACGT', 'TGCA')) AS t FROM s)
    SELECT k, CAST(j AS INTEGER) AS j, CAST(55 - j AS INTEGER) AS f, substr(t, CAST(j + 1 AS BIGINT), 9) AS word FROM r, unnest(range(0, 56)) AS u(j) WHERE NOT contains(substr(t, CAST(j + 1 AS BIGINT), 9), 'N')""")
def seq_reverse_windows(spark, sf_dir):
    """Windows of the other strand that meet no spacer, with where they begin on the forward strand."""
    t = pairs(spark, sf_dir).select("k", seq.revcomp("a").alias("t"))
    w = t.select("k", "t", F.explode(seq.starts("t", 9)).alias("j")).withColumn("word", seq.slice_at("t", F.col("j"), 9))
    return w.where(~seq.straddles_spacer("word")).select("k", "j", seq.rc_position(F.col("j"), 9, F.length("t")).alias("f"), "word")
