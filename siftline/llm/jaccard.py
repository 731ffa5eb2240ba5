"""Exact Jaccard join of documents on word shingles (operator 5).

Method: a metric-space join under the Jaccard distance 1 - |x & y| / |x | y|.

1. Texts with equal shingle sets are one point (a node, named by a 64-bit hash of its set).
2. First regions. Nearly all pairs of texts are at a distance near 1 of each other, so that no
   choice of document pivots separates a whole corpus: with the bound e = 0.1 every window d(x, q)
   <= d(x, home) + 2 e would hold every text. The first pivots are therefore taken where distances
   differ: the universe of shingles itself (the distance to it depends on the set's size alone), which
   gives shells of sizes with a window for sets just above a shell's edge, and, within a shell, the
   projections of sets on k parts of the universe, each distinct projection being a pivot with the
   texts at distance 0 from it as its region. A linked pair differs in at most D elements, so with
   k = D + 1 + E parts at least 1 + E of its projections are at distance 0: the pair meets in a region.
   (So each set leaves out its E smallest projections, in an order that sets share: of 1 + E equal
   ones at most E go on either side, and those are the same. E grows with the expected empty parts.)
   Texts that share a common line meet by chance, the more the larger the corpus, so sets do not move for a
   meeting alone: a sketch (a byte for each of 2 D + 8 parts of the universe) differs in no more parts than
   the sets in elements. Of what met a region's pivot, only what sketches connect goes on, to its least name.
3. A region's pivot is its point of least name; only (point, pivot) pairs go on. Where the points that such
   pairs connect are few (``leaf`` points and ``mass`` hashes), they are one cell and each set is copied once.
   Where they are many, since chance meetings chain, the cells are the pivots' own: a pivot and what it met.
   All of a region lies in its pivot's cell, so each linked pair lies in a cell, and no chain makes one larger.
4. A cell that is still larger is divided by document pivots: points go to the Voronoi region of their nearest
   pivot and, as boundary points, to every other whose distance is within 2 e of that; there, what lies within
   2 e of the pivot is parted from what lies beyond e. So each linked pair lies together in one part. Pivots
   have been compared with all and leave; parts whose points are all linked already are done. Points at a
   distance near 1 of each other, which pivots cannot divide, are dealt by the elements that are rarest in
   their cell: linked sets share one of the first few. This recurs. Smaller cells go to one task each, which
   divides them in the same ways in memory and verifies with the sets themselves.
5. Verified links (a spanning set of each cell's, not all pairs) give the components.

Shuffled: about 0.2 hashes for each shingle at 0.9, 0.5 at 0.8, and the sets of the texts that met others.
Broadcast: a bit table of fixed size (at most 8 MB) that holds which sets are wanted; once it is full
(from some 10 million wanted sets on) the sets of all texts are shuffled and the join alone decides.

Cases: null, empty and blank texts have an empty set and stay alone; fewer words than the shingle
size make one shingle of the whole sequence; repeated rows are one point; null ids are allowed, and
the least non-null id of a component is its id; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.llm.textops import U, mix, shingle_sets, slices
from siftline.operators.linkage import components
from siftline.session import cut, large, partitions, ship

NUM, DEN = 90, 100  # linked when DEN * |x & y| >= NUM * |x | y|
SHELL = 1.3
PART, PART_MASS = 1024, 1 << 19  # points and hashes that are compared with pivots at once
LEAF, MASS = 4096, 1 << 22  # points and hashes (32 MB) of a cell that one task joins
DIVIDES = 0.6  # a division is worth while if its regions' pairs are at most this part of the cell's
PIVOTS = 8
BITS = 26
PAIRS, MET, MET_MASS = 64, 1 << 16, 1 << 25  # points that are compared all at once; points and bytes of sketches one by one


class Shells:
    """Size shells, and for each the most different elements and the number of smallest parts left out."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(int(edges[-1] * SHELL) + 1)
        self.edges = np.array(edges)
        self.differ = [self.most_different(e - 1) for e in edges[1:]]
        self.spare = [min(d, 2) + int(2 * d * np.exp(-e / d)) if d else 0 for d, e in zip(self.differ, edges)]

    def most_different(self, least: int) -> int:
        """Most elements in which a set of ``least`` elements and a linked one no smaller differ:
        I >= num / den * T with I + T = a + b and T - I = D gives D <= (a + b) (den - num) / (den + num)."""
        other = least * self.den // self.num
        return (least + other) * (self.den - self.num) // (self.den + self.num)

    def sketch(self, j: int) -> int:
        """Parts of the sketches of a shell: a linked pair's are equal in more than half of them."""
        return 2 * self.differ[j] + 8

    def of(self, n: int) -> list[int]:
        """The shell of a set's own size, and lower ones that hold sizes it may link with."""
        own = int(np.searchsorted(self.edges, n, "right")) - 1
        out = [own]
        while out[-1] > 0 and (self.edges[out[-1]] - 1) * self.den >= self.num * n:
            out.append(out[-1] - 1)
        return [j for j in out if self.differ[j]]


def regions_of(s: np.ndarray, shells: Shells) -> np.ndarray:
    """Names of the first regions of a set."""
    out, spread = [], mix(s)
    low, high = (spread & U(0xFFFFFFFF)).astype(np.float64), (spread >> U(32)).astype(np.float64)
    place = s >> U(32)
    for j in shells.of(len(s)):
        k = shells.differ[j] + 1 + shells.spare[j]
        part = ((place * U(k)) >> U(32)).astype(np.int64)
        count = np.bincount(part, minlength=k)
        sums = np.bincount(part, low, k).astype(U) + mix(np.bincount(part, high, k).astype(U))
        name = mix(sums ^ mix(np.arange(k, dtype=U) + U((j + 1) << 40)))
        out.append(name[np.lexsort((name, count))[shells.spare[j] :]])
    return np.concatenate(out) if out else np.zeros(0, U)


def sketch_of(s: np.ndarray, shells: Shells) -> bytes:
    """Its sketches for its shells, one after the other: for each part of the universe the sum of its elements' bytes."""
    out, place, low = [], s >> U(32), (mix(s) & U(255)).astype(np.float64)
    for j in shells.of(len(s)):
        k = shells.sketch(j)
        out.append((np.bincount(((place * U(k)) >> U(32)).astype(np.int64), low, k).astype(np.int64) & 255).astype(np.uint8).tobytes())
    return b"".join(out)


def connected(cell: np.ndarray, node: np.ndarray, sizes: np.ndarray, sketches: list[bytes], shells: Shells) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) of what is connected, within a cell (equal numbers, in a run), by sketches that are as near as those of linked sets."""
    label = np.arange(len(cell))
    rows: dict[int, list[tuple[int, int]]] = {}
    for r, n in enumerate(sizes.tolist()):
        at = 0
        for j in shells.of(n):
            rows.setdefault(j, []).append((r, at))
            at += shells.sketch(j)

    def near(m: np.ndarray, i: np.ndarray | int, k: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k), bool)
        for a in range(0, len(k), step := max(1, (1 << 22) // m.shape[1])):
            x, y = i if isinstance(i, int) else i[a : a + step], k[a : a + step]
            out[a : a + step] = (m[x] != m[y]).sum(1) * (shells.den + shells.num) <= (of[x] + of[y]) * (shells.den - shells.num)
        return out

    for j, held in rows.items():
        own, at, q = np.array([r for r, _ in held]), [b for _, b in held], shells.sketch(j)
        m = np.frombuffer(b"".join(sketches[r][b : b + q] for r, b in zip(own.tolist(), at)), np.uint8).reshape(len(own), q)
        edge = np.flatnonzero(np.concatenate([[True], cell[own][1:] != cell[own][:-1], [True]]))
        count = np.diff(edge)
        few = np.repeat(count <= PAIRS, count)
        later = np.where(few, np.repeat(edge[1:], count) - np.arange(len(own)) - 1, 0)
        i = np.repeat(np.arange(len(own)), later)
        k = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        met = near(m, i, k, sizes[own])
        i, k = own[i[met]], own[k[met]]
        while (label[i] != label[k]).any():  # labels are rows of the same cell, and lead to lesser ones
            low = np.minimum(label[i], label[k])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[k], low)
            label = label[label]
        label = _ends(label)
        for a, b in zip(edge[:-1][count > PAIRS].tolist(), edge[1:][count > PAIRS].tolist()):
            whole = slice(*np.searchsorted(cell, cell[own[a]] + np.array([0, 1])))
            for x in range(a, b - 1):
                others = np.arange(x + 1, b)
                others = others[label[own[others]] != label[own[x]]]
                for y in others[near(m, x, others, sizes[own])]:
                    one, other = label[own[x]], label[own[y]]
                    label[whole][label[whole] == max(one, other)] = min(one, other)
    least = np.full(len(cell), np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    return node, least[label]


def _ends(label: np.ndarray) -> np.ndarray:
    while (label != label[label]).any():
        label = label[label]
    return label


def _name(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def join_cell(sets: list[np.ndarray], num: int = NUM, den: int = DEN, leaf: int = 32) -> list[tuple[int, int]]:
    """Links (i, j) between sets of one cell that connect whatever all linked pairs would."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    dense = dense.astype(np.int32)
    own = np.split(dense, np.cumsum(sizes)[:-1])
    flags = np.zeros(int(dense.max()) + 1, bool)
    near = (den - num) / den
    label, links = np.arange(n), []

    def against(i: int, flat: np.ndarray, starts: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of set i to the sets ``others`` (whose elements are ``flat``), and which are linked with it."""
        flags[own[i]] = True
        common = np.add.reduceat(flags[flat], starts, dtype=np.int64)
        flags[own[i]] = False
        union = sizes[others] + sizes[i] - common
        return 1 - common / union, den * common >= num * union

    def unite(i: int, linked: np.ndarray) -> None:
        for j in linked:
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)
                links.append((int(i), int(j)))

    def laid_out(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([own[j] for j in cell]), np.concatenate([[0], np.cumsum(sizes[cell])[:-1]])

    def each_with_later(cell: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> None:
        for k in range(len(cell) - 1):
            later = cell[k + 1 :]
            open_ = label[later] != label[cell[k]]
            if not open_.any():
                continue
            if open_.sum() < 0.3 * len(later):
                some = later[open_]
                _, linked = against(cell[k], *laid_out(some), some)
                unite(cell[k], some[linked])
            else:
                _, linked = against(cell[k], flat[starts[k + 1] :], starts[k + 1 :] - starts[k + 1], later)
                unite(cell[k], later[linked & open_])

    def by_rare_elements(cell: np.ndarray, flat: np.ndarray) -> None:
        """Two linked sets of a elements or more share one of the a - ceil(num a / den) + 1 that are rarest in the cell."""
        own_row = np.repeat(np.arange(len(cell)), sizes[cell])
        often = np.bincount(flat)
        order = np.lexsort((flat, often[flat], own_row))
        first = np.cumsum(sizes[cell]) - sizes[cell]
        place = np.arange(len(flat)) - np.repeat(first, sizes[cell])
        early = place < np.repeat(sizes[cell] - -(-num * sizes[cell] // den) + 1, sizes[cell])
        element, row = flat[order][early], own_row[order][early]
        by = np.argsort(element, kind="stable")
        element, row = element[by], cell[row[by]]
        edge = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1], [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a > 1:
                group = row[a:b]
                for k in range(len(group) - 1):
                    open_ = group[k + 1 :][label[group[k + 1 :]] != label[group[k]]]
                    if len(open_):
                        _, linked = against(group[k], *laid_out(open_), open_)
                        unite(group[k], open_[linked])

    todo = [np.arange(n)]
    while todo:
        cell = todo.pop()
        if len(cell) < 2 or (label[cell] == label[cell[0]]).all():
            continue
        flat, starts = laid_out(cell)
        if len(cell) <= leaf:
            each_with_later(cell, flat, starts)
            continue
        chosen = np.linspace(0, len(cell) - 1, PIVOTS).astype(int)
        far = np.empty((PIVOTS, len(cell)))
        for p, k in enumerate(chosen):
            far[p], linked = against(cell[k], flat, starts, cell)
            unite(cell[k], cell[linked])
        within = far <= far.min(0) + 2 * near + 1e-9
        held = [within[p] for p in np.unique(far.argmin(0))]
        if sum(int(x.sum()) ** 2 for x in held) > DIVIDES * len(cell) ** 2:
            by_rare_elements(cell, flat)
        else:
            todo += [cell[x] for x in held]
    return links


def _points(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """id, node, n and sketch of every document."""
    shells = Shells(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                sets = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([rows.column(1), pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch_of(s, shells) if len(s) else b"" for s in sets], pa.binary())], [id_col, "node", "n", "sketch"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(text_col).alias("__text"), id_col).mapInArrow(run, f"`{id_col}` {kind}, node bigint, n bigint, sketch binary")


def _meets(docs: DataFrame, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """(node, pivot) of every point that is in a first region, and not its pivot. A task names equal sets once."""
    shells = Shells(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in slices(batch):
                node, regions = [], []
                for s in shingle_sets(data, offsets, size):
                    k = _name(s)
                    if k not in seen and len(s):
                        if len(seen) >= 1_000_000:
                            seen.clear()
                        seen.add(k)
                        node.append(k)
                        regions.append(regions_of(s, shells).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(regions, pa.list_(pa.int64()))], ["node", "regions"])

    rows = docs.select(F.col(text_col).alias("__text")).mapInArrow(run, "node bigint, regions array<bigint>").select("node", F.explode("regions").alias("region"))
    return rows.withColumn("pivot", F.min("node").over(Window.partitionBy("region"))).where("node > pivot").select("node", "pivot").distinct()


def _near_meets(meets: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """``meets`` (node, pivot) without those of chance: of the points that met a pivot, each that sketches connect with
    others, with the least of them. Points of a pivot that has more of them than a task compares go on as they are."""
    shells = Shells(num, den)
    sketches = points.where("n > 0").select("node", "n", "sketch").dropDuplicates(["node"])
    held = meets.unionByName(meets.select(F.col("pivot").alias("node"), "pivot").distinct())
    met = cut(held.join(large(sketches), "node"), "met")
    sizes = met.groupBy("pivot").agg(F.count(F.lit(1)).alias("points"), F.sum(F.length("sketch")).alias("mass"))
    many = cut(sizes.where((F.col("points") > MET) | (F.col("mass") > MET_MASS)).select("pivot"), "many")
    rows, mass = met.agg(F.count(F.lit(1)), F.sum(F.length("sketch"))).first()
    groups = max(partitions(meets.sparkSession), rows // 8192, (mass or 0) >> 22)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pivot", "n", "node"])
        cell = np.cumsum(np.concatenate([[0], np.diff(group["pivot"].to_numpy()) != 0]))
        node, least = connected(cell, group["node"].to_numpy(), group["n"].to_numpy(), group["sketch"].tolist(), shells)
        return pd.DataFrame({"node": node, "pivot": least})[node != least].drop_duplicates()

    few, kept = met, None
    if not many.isEmpty():
        few, kept = met.join(large(many), "pivot", "left_anti"), meets.join(large(many), "pivot", "left_semi").select("node", "pivot")
    near = few.withColumn("g", F.pmod(F.xxhash64("pivot"), F.lit(groups))).groupBy("g").applyInPandas(run, "node bigint, pivot bigint")
    return (near if kept is None else near.unionByName(kept)).distinct()


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, size: int) -> DataFrame:
    """node and set (bytes of its sorted hashes) of the texts whose node is in ``wanted`` (node and what else it carries)."""
    prefix = F.shiftrightunsigned("node", 64 - BITS)
    rows = wanted.groupBy(F.shiftright(prefix, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(node, {64 - BITS}) & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), U)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(U)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = held.value, set()
        for batch in batches:
            for _, data, offsets in slices(batch):
                node, out = [], []
                for s in shingle_sets(data, offsets, size):
                    k = _name(s)
                    p = (k & 0xFFFFFFFFFFFFFFFF) >> (64 - BITS)
                    if len(s) and int(bits[p >> 6]) >> (p & 63) & 1 and k not in seen:
                        if len(seen) >= 1_000_000:
                            seen.clear()
                        seen.add(k)
                        node.append(k)
                        out.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.binary())], ["node", "set"])

    found = docs.select(F.col(text_col).alias("__text")).mapInArrow(run, "node bigint, set binary")
    return found.join(wanted, "node").dropDuplicates(["node"])


def _weighed(members: DataFrame) -> DataFrame:
    """cell, size (points) and mass (hashes) of cells."""
    return members.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("set") / 8).cast("long").alias("mass"))


def _parts(leaf: int, mass: int) -> Column:
    """In how many parts a cell fits the bounds of a task."""
    return F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(leaf)), F.ceil(F.col("mass") / F.lit(mass)))


def _divide(large: DataFrame, turn: int, num: int, den: int, leaf: int, mass: int) -> DataFrame:
    """Members (cell, part, node) of large cells in parts around their cells' pivots, and links (part null) to
    pivots. Pivots are of different labels (what is linked already has one), as far as there are several, and
    in no part. A task compares a small share of a cell with its pivots; sets stay where they are."""
    leaf, mass = min(leaf, PART), min(mass, PART_MASS)
    slot, draw = F.pmod(F.xxhash64("label", F.lit(turn)), F.lit(PIVOTS)), F.xxhash64("node", F.lit(turn))
    pivots = large.groupBy("cell", slot.alias("p")).agg(F.min_by(F.struct("node", "set"), F.struct(draw, "node")).alias("pivot"), F.max("size").alias("size"), F.max("mass").alias("mass"))
    pivots = pivots.groupBy("cell").agg(F.collect_list("pivot.node").alias("nodes"), F.collect_list("pivot.set").alias("sets"), F.max("size").alias("size"), F.max("mass").alias("mass"))
    pivots = pivots.select("cell", "nodes", "sets", F.explode(F.sequence(F.lit(0).cast("long"), _parts(leaf, mass) - 1)).alias("c"))
    pivots = pivots.toDF(*pivots.columns)  # both sides come from one table
    near = (den - num) / den

    def run(own: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own):
            nodes, sets = own["node"].to_numpy(), [np.frombuffer(x, U) for x in own["set"]]
            flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
            starts = np.cumsum(sizes) - sizes
            chosen, far, cell = pivots["nodes"].iloc[0], [], own["cell"].iloc[0]
            for pivot, x in zip(chosen, pivots["sets"].iloc[0]):
                t = np.frombuffer(x, U)
                at = np.minimum(np.searchsorted(t, flat), len(t) - 1)
                common = np.add.reduceat(t[at] == flat, starts, dtype=np.int64)
                union = sizes + len(t) - common
                far.append(1 - common / union)
                out += [(cell, None, nodes[i], pivot) for i in np.flatnonzero((den * common >= num * union) & (nodes != pivot))]
            far = np.stack(far)
            within = (far <= far.min(0) + 2 * near + 1e-9) & ~np.isin(nodes, chosen)
            for part, held in ((0, within & (far <= 2 * near + 1e-9)), (1, within & (far >= near - 1e-9))):
                out += [(cell, 2 * int(p) + part, nodes[i], None) for p, i in zip(*np.nonzero(held))]
        return pd.DataFrame(out, columns=["cell", "part", "node", "link"]).astype({"part": "Int64", "link": "Int64"})

    rows = large.select("cell", F.pmod(F.xxhash64("node"), _parts(leaf, mass)).alias("c"), "node", "set")
    return rows.groupBy("cell", "c").cogroup(pivots.groupBy("cell", "c")).applyInPandas(run, "cell bigint, part bigint, node bigint, link bigint")


def _by_rare_elements(whole: DataFrame, num: int, den: int) -> DataFrame:
    """Members (cell, node) of cells that pivots do not divide in the cells of second pivots: with its elements
    in order of how often they are in the cell, a set shares one of its first n - num n / den + 1 with each
    linked one; the sets with one such element are a region, and regions of one least node are a cell."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(2)]
            edge = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], ["cell", "node", "elements"])

    rows = whole.select("cell", "node", "set").mapInArrow(elements, "cell bigint, node bigint, elements array<bigint>").select("cell", "node", F.explode("elements").alias("element"))
    often = rows.groupBy("cell", "element").agg(F.count(F.lit(1)).alias("often"))
    first = F.size("all") - F.ceil(F.size("all") * F.lit(num) / F.lit(den)).cast("int") + 1
    ranked = rows.join(often, ["cell", "element"]).groupBy("cell", "node").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("all"))
    early = ranked.select("cell", "node", F.explode(F.slice("all", F.lit(1), first)).alias("e")).where("e.often > 1")
    meets = early.withColumn("pivot", F.min("node").over(Window.partitionBy("cell", "e.element"))).where("node > pivot").select("cell", "node", "pivot").distinct()
    meets = cut(meets, "rare")
    return meets.unionByName(meets.select("cell", F.col("pivot").alias("node"), "pivot").distinct()).select("cell", F.xxhash64("cell", "pivot").alias("sub"), "node")


def _in_blocks(whole: DataFrame, leaf: int, mass: int) -> DataFrame:
    """Members of cells in cells that each hold two blocks: every pair meets in one. The exact way that is left
    for more than ``leaf`` unlinked sets that neither pivots nor their rarest elements part."""
    blocks = whole.withColumn("blocks", _parts(max(1, leaf // 2), max(1, mass // 2)))
    blocks = blocks.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return blocks.select(F.xxhash64("cell", F.least("b", "c"), F.greatest("b", "c")).alias("cell"), "node", "set")


def _small(cells: DataFrame, num: int, den: int, groups: int) -> DataFrame:
    """Verified links (a, b) of cells that each fit a task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, cell in group.sort_values(["cell", "node"]).groupby("cell", sort=False):
            if len(cell) > 1:
                nodes = cell["node"].to_numpy()
                found += [(nodes[i], nodes[j]) for i, j in join_cell([np.frombuffer(x, U) for x in cell["set"]], num, den)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return cells.select("cell", "node", "set").withColumn("g", F.pmod(F.xxhash64("cell"), F.lit(groups))).groupBy("g").applyInPandas(run, "a bigint, b bigint")


def _links(members: DataFrame, leaf: int, mass: int, num: int, den: int, turns: int = 8) -> DataFrame:
    """Verified links (a, b) of members (cell, node, set)."""
    at, labels, links, total, hashes = members, None, [], 0, 0
    small, fits = [], (F.col("size") <= leaf) & (F.col("mass") <= mass)
    for turn in range(turns + 1):
        sizes = cut(_weighed(at), "sizes")
        points, most, weight, heaviest = sizes.agg(F.sum("size"), F.max("size"), F.sum("mass"), F.max("mass")).first()
        total, hashes = total + (points or 0), hashes + (weight or 0)
        if not points or (most <= leaf and heaviest <= mass):
            small.append(at.select("cell", "node", "set"))
            break
        small.append(at.join(sizes.where(fits & (F.col("size") > 1)), "cell").select("cell", "node", "set"))
        large = at.join(sizes.where(~fits & (F.col("size") > 1)), "cell")
        if turn == turns:
            small.append(_in_blocks(large, leaf, mass))
            break
        large = large.withColumn("label", F.col("node")) if labels is None else large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        divided = cut(_divide(large, turn, num, den, leaf, mass), "parts")
        links.append(divided.where("link is not null").select(F.col("node").alias("a"), F.col("link").alias("b")))
        labels = links[0]
        for x in links[1:]:
            labels = labels.unionByName(x)
        labels = cut(components(labels).select("node", F.col("root").alias("label")), "labels")
        parts = divided.where("part is not null").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        parts = parts.groupBy("cell", "part").agg(F.count(F.lit(1)).cast("double").alias("held"), F.min("label").alias("one"), F.max("label").alias("other")).where("one != other")
        pairs = parts.groupBy("cell").agg(F.sum(F.col("held") * F.col("held")).alias("pairs"))
        worth = cut(sizes.where(~fits).join(pairs, "cell", "left").select("cell", (F.coalesce("pairs", F.lit(0)) <= DIVIDES * F.pow("size", F.lit(2))).alias("worth")), "worth")
        sets = large.select("cell", "node", "set")
        dealt = divided.where("part is not null").join(parts.select("cell", "part"), ["cell", "part"]).join(worth.where("worth"), "cell")
        next_ = dealt.join(sets, ["cell", "node"]).select(F.xxhash64("cell", "part").alias("cell"), "node", "set")
        if not worth.where("not worth").isEmpty():
            whole = sets.join(worth.where("not worth"), "cell").select("cell", "node", "set")
            next_ = next_.unionByName(_by_rare_elements(whole, num, den).join(whole, ["cell", "node"]).select(F.col("sub").alias("cell"), "node", "set"))
        at = cut(next_, "regions")
    cells = small[0]
    for x in small[1:]:
        cells = cells.unionByName(x)
    # cells are dealt to groups of a few hundred points and a few MB each, far below what a task can hold
    out = _small(cells, num, den, max(partitions(members.sparkSession), total // 512, hashes // (1 << 19)))
    for x in links:
        out = out.unionByName(x)
    return out


def _cells(docs: DataFrame, meets: DataFrame, text_col: str, size: int, leaf: int, mass: int) -> DataFrame:
    """Members (cell, node, set), written: components of ``meets`` (node, pivot) that fit a task, pivots with what they met for the others."""
    linked = cut(components(meets, "node", "pivot").select("node", F.col("root").alias("cell")), "region-cells")
    sets = cut(_sets(docs, linked, text_col, size), "members")
    sizes = cut(_weighed(sets), "sizes")
    fits = (F.col("size") <= leaf) & (F.col("mass") <= mass)
    if sizes.where(~fits).isEmpty():
        return sets.select("cell", "node", "set")
    wide = sets.join(sizes.where(~fits).select("cell"), "cell").select("node", "set")
    own = meets.select("node", F.col("pivot").alias("cell")).unionByName(meets.select(F.col("pivot").alias("node"), F.col("pivot").alias("cell")).distinct())
    return cut(sets.join(sizes.where(fits).select("cell"), "cell").select("cell", "node", "set").unionByName(own.join(wide, "node").select(F.xxhash64("cell", F.lit("pivot")).alias("cell"), "node", "set")), "cells")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = NUM, den: int = DEN, leaf: int = LEAF, mass: int = MASS) -> DataFrame:
    """id_col, n_shingles, node (equal for equal sets), component_id: the least id reachable by links."""
    ship(docs.sparkSession)
    points = cut(_points(docs, id_col, text_col, size, num, den), "points")
    meets = cut(_near_meets(cut(_meets(docs, text_col, size, num, den), "meets"), points, num, den), "near")
    members = _cells(docs, meets, text_col, size, leaf, mass)
    roots = components(_links(members, leaf, mass, num, den))
    nodes = points.where("n > 0").groupBy("node").agg(F.min(id_col).alias("own")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("own").alias("component_id"))
    named = nodes.where("node != root").select("node", "root").join(least, "root").select("node", "component_id")
    alone = least.select(F.col("root").alias("node"), "component_id")
    by_node = named.unionByName(alone)
    out = points.select(id_col, "node", F.col("n").alias("n_shingles")).join(by_node, "node", "left")
    return out.select(id_col, "n_shingles", "node", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))
