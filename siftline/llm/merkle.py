"""Merkle manifest of a dataset, with proofs (operator 13).

Method: leaves are dealt by range of (group, order), and every part's count of each group's rows gives, with
the counts of the parts before, each leaf's place in its group. A task builds all complete aligned subtrees
of its part: runs of 16 nodes whose places it holds, level upon level. Only ragged nodes, those of runs that
reach over the edge of a part (at most 15 on either side of it a level), are shuffled, by coordinate (group,
level, run), and finish the upper levels; a group of any size therefore spreads over all parts. The groups'
roots are then leaves of one more such tree. For the proofs a part gets the runs it holds a share of only
(two a level at most), builds its own subtrees once more, and folds every leaf with its siblings.

A node is the SHA-256 of its children's digests as hex text, one after the other; a lone node is passed on.

Cases: null fields count as ``-``; the null group and null ids come first; rows equal in group and id go by
leaf, equal rows take places of their own; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.session import cut, numbered, partitions, ship

WIDTH = 16
PART = 1 << 15  # leaves that a task holds at once


class Tree(NamedTuple):
    parts: DataFrame  # the leaves, dealt: part, at (their order), group, digest, and what else they carry
    segments: DataFrame  # part, group, own (its leaves there), lo (leaves of the group before), n (all its leaves)
    runs: DataFrame  # group, level, run, digests: runs that no part holds whole
    tops: DataFrame  # group, root


def digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def local_levels(leaves: list[str], lo: int, n: int) -> list[tuple[int, list[str], int, int, int]]:
    """Level by level what a part knows of a tree of n leaves, of which it holds those from ``lo`` on:
    (place of its first node, its nodes, first and last complete run (or none: 0, -1), nodes of the level)."""
    out = []
    while leaves:
        hi = lo + len(leaves)
        first = -(-lo // WIDTH)
        last = (n - 1) // WIDTH if hi == n else hi // WIDTH - 1
        if n == 1:
            first, last = 0, -1
        out.append((lo, leaves, first, last, n))
        if last < first:
            break
        leaves = [digest(leaves[max(0, r * WIDTH - lo) : (r + 1) * WIDTH - lo]) for r in range(first, last + 1)]
        lo, n = first, -(-n // WIDTH)
    return out


def ragged(levels: list[tuple[int, list[str], int, int, int]]) -> list[tuple[int, int, str, bool]]:
    """(level, place, digest, whether it is the root) of nodes that no complete run holds."""
    found = []
    for level, (lo, nodes, first, last, n) in enumerate(levels):
        inside = range(first * WIDTH, (last + 1) * WIDTH)
        found += [(level, lo + k, d, n == 1) for k, d in enumerate(nodes) if lo + k not in inside]
    return found


def _dealt(leaves: DataFrame, order: list[str]) -> DataFrame:
    rows, row = numbered(leaves, "leaves")
    n = max(partitions(leaves.sparkSession), rows.count() // PART + 1)
    order = ["group", *order, "digest", row]
    return cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).drop(row), "parts")


def _segments(parts: DataFrame) -> DataFrame:
    own = Window.partitionBy("group")
    counts = parts.groupBy("part", "group").agg(F.count(F.lit(1)).alias("own"))
    lo = F.coalesce(F.sum("own").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut(counts.select("part", "group", "own", lo.alias("lo"), F.sum("own").over(own).alias("n")), "segments")


def tree(leaves: DataFrame, order: list[str]) -> Tree:
    """The trees of ``leaves``: group (string), digest, and the columns that order them in their group."""
    ship(leaves.sparkSession)
    parts = _dealt(leaves, order)
    segments = _segments(parts)
    shape = segments.drop("own")

    def build(rows: pd.DataFrame, shape: pd.DataFrame) -> pd.DataFrame:
        out = []
        for group, lo, n, own in _own_groups(rows, shape):
            out += [(group, *x) for x in ragged(local_levels(own["digest"].tolist(), lo, n))]
        return pd.DataFrame(out, columns=["group", "level", "place", "digest", "top"])

    loose = parts.select("part", "at", "group", "digest").groupBy("part").cogroup(shape.groupBy("part")).applyInPandas(build, "group string, level int, place bigint, digest string, top boolean")
    loose = cut(loose, "ragged")
    tops, runs = [loose.where("top").select("group", F.col("digest").alias("root"))], []
    size = shape.select("group", "n").distinct()
    loose = loose.where("not top").drop("top")
    height, n = 0, size.agg(F.max("n")).first()[0] or 0
    while n > 1:
        height, n = height + 1, -(-n // WIDTH)
    up = None
    for level in range(height):
        nodes = loose.where(F.col("level") == level).drop("level")
        nodes = nodes if up is None else nodes.unionByName(up)
        run = nodes.groupBy("group", F.floor(F.col("place") / WIDTH).alias("run")).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("nodes"))  # 16 at most
        run = cut(run.select("group", F.lit(level).alias("level"), "run", F.col("nodes.digest").alias("digests")), "runs")
        runs.append(run)
        # a level's only node is the root
        made = run.select("group", F.col("run").alias("place"), F.sha2(F.array_join("digests", ""), 256).alias("digest"))
        alone = F.col("n") <= WIDTH ** (level + 1)
        made = made.join(size.withColumnRenamed("group", "g"), F.col("group").eqNullSafe(F.col("g"))).withColumn("top", alone).drop("g", "n")
        tops.append(made.where("top").select("group", F.col("digest").alias("root")))
        up = made.where("not top").drop("top")
    none = parts.sparkSession.createDataFrame([], "group string, level int, run bigint, digests array<string>")
    for x in runs:
        none = none.unionByName(x)
    root = tops[0]
    for x in tops[1:]:
        root = root.unionByName(x)
    return Tree(parts, segments, none, cut(root, "tops"))


def _named(group) -> str | None:
    return group if isinstance(group, str) else None


def _own_groups(rows: pd.DataFrame, shape: pd.DataFrame) -> Iterator[tuple[str | None, int, int, pd.DataFrame]]:
    """(group, lo, n, its rows in order) of the rows of a part."""
    if len(rows):
        held = {_named(k): x for k, x in rows.sort_values("at").groupby("group", dropna=False, sort=False)}
        for group, lo, n in zip(map(_named, shape["group"]), shape["lo"], shape["n"]):
            yield group, int(lo), int(n), held[group]


def paths(found: Tree, keep: list[str], take: Callable[..., tuple], schema: str, upper: DataFrame | None = None) -> DataFrame:
    """``take(row, top, siblings, before, after)`` of every leaf, in ``schema``: row holds ``keep``, top is its
    group's root, siblings the text of all siblings on its way up, before and after what stands on either side
    of it in its run, level by level. ``upper`` (group, top, siblings, before, after) goes on beyond the root."""
    runs_at = lambda place: F.expr(f"transform(sequence(0, 15), l -> struct(l as level, cast(floor({place} / power(16, l + 1)) as bigint) as run))")
    ends = found.segments.select("part", "group", "n", F.explode(F.array_union(runs_at("lo"), runs_at("(lo + own - 1)"))).alias("c"))
    wanted = ends.where("n > power(16, c.level)").select("part", F.col("group").alias("g"), F.col("c.level").alias("l"), F.col("c.run").alias("r"))
    given = wanted.join(found.runs, F.col("group").eqNullSafe(F.col("g")) & (F.col("level") == F.col("l")) & (F.col("run") == F.col("r"))).select("part", "group", "level", "run", "digests")
    shape = found.segments.select("part", "group", "lo", "n")
    if upper is None:
        shape = shape.withColumns({"top": F.lit(None).cast("string"), "siblings": F.lit(""), "before": F.array().cast("array<string>"), "after": F.array().cast("array<string>")})
    else:
        shape = shape.join(upper.withColumnRenamed("group", "g"), F.col("group").eqNullSafe(F.col("g"))).drop("g")
    side = shape.unionByName(given, allowMissingColumns=True)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        out = []
        at_run = side["level"].notna()
        given = {(_named(g), int(level), int(r)): list(d) for g, level, r, d in side.loc[at_run, ["group", "level", "run", "digests"]].itertuples(index=False)}
        shape = side[~at_run]
        above = {_named(g): (t, s, list(b), list(a)) for g, t, s, b, a in shape[["group", "top", "siblings", "before", "after"]].itertuples(index=False)}
        for group, lo, n, own in _own_groups(rows, shape):
            levels = local_levels(own["digest"].tolist(), lo, n)
            top, beyond, before, after = above[group]
            height = 0
            while n > WIDTH**height:
                height += 1

            def nodes_of(level: int, r: int) -> list[str]:
                if level < len(levels):
                    at, nodes, first, last, _ = levels[level]
                    if first <= r <= last:
                        return nodes[max(0, r * WIDTH - at) : (r + 1) * WIDTH - at]
                return given[(group, level, r)]

            def sides(level: int, r: int, j: int) -> tuple[str, str]:
                nodes = nodes_of(level, r)
                return "".join(nodes[:j]), "".join(nodes[j + 1 :])

            last = None
            for k, row in enumerate(own[keep].itertuples(index=False, name=None)):
                r, j = divmod(lo + k, WIDTH)
                if r != last:  # leaves of one run share the way from there on
                    last, way = r, [sides(level, r // WIDTH**level, r // WIDTH ** (level - 1) % WIDTH) for level in range(1, height)]
                mine = [sides(0, r, j), *way] if height else []
                out.append(take(row, top, "".join(x for s in mine for x in s) + beyond, [x for x, _ in mine] + before, [x for _, x in mine] + after))
        return pd.DataFrame(out, columns=names)

    return found.parts.select("part", "at", "group", "digest", *[c for c in keep if c != "digest"]).groupBy("part").cogroup(side.groupBy("part")).applyInPandas(run, schema)


def fold(leaf: str, before: list[str], after: list[str]) -> str:
    for b, a in zip(before, after):
        leaf = sha256((b + leaf + a).encode()).hexdigest()
    return leaf


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def manifest(docs: DataFrame, tampered: Column, fields: list[str] = FIELDS, group: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, leaf, subroot, root, proof_sha256, folded_root, verified: the proofs of all documents. Where
    ``tampered`` holds, the text's A-Z are lower-cased before the leaf is folded again."""
    leaf = F.sha2(F.concat(*[field(F.col(c)) for c in fields]), 256)
    other = F.sha2(F.concat(*[field(F.translate(F.col(c), UPPER, LOWER) if c == text_col else F.col(c)) for c in fields]), 256)
    # ids pass as text, since pandas has no whole numbers beside nulls
    leaves = docs.select(F.col(group).cast("string").alias("group"), F.col(id_col).alias("key"), F.col(id_col).cast("string").alias("id"), leaf.alias("digest"), F.when(tampered, other).alias("other"))
    own = tree(leaves, ["key"])
    # the groups' roots are the leaves of one more tree
    over = tree(own.tops.select(F.lit("").alias("group"), F.col("group").alias("id"), F.col("root").alias("digest")), ["id"])
    upper = paths(over, ["id", "digest"], lambda row, top, *way: (*row, *way), "group string, top string, siblings string, before array<string>, after array<string>")
    root = over.tops.select("root").first()
    root = F.lit(root.root if root else None).cast("string")

    def take(row, top, siblings, before, after):
        i, leaf, other = row
        return i, leaf, top, sha256(siblings.encode()).hexdigest(), fold(_named(other) or leaf, before, after)

    found = paths(own, ["id", "digest", "other"], take, "id string, leaf string, subroot string, proof_sha256 string, folded_root string", cut(upper, "upper"))
    kind = dict(docs.dtypes)[id_col]
    return found.select(F.col("id").cast(kind).alias(id_col), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
