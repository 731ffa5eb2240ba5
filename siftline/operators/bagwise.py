"""Ranked clusters of bags that are small enough for a task: what ``plans.scorer.score_clusters`` makes with joins of
near rows, step by step (see ``positions``, ``linkage`` and ``windows`` for the rules), but for some thousand bags at
once in arrays, without moving a row. Bags beyond the limits are named, not worked out: joins do those."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

HITS, SITES, LETTERS = 1024, 62, 1 << 20  # of a small bag: hits, sites, letters of its pairs of sites
ROWS = 1 << 15  # hits that are worked out at once
BLOCK = 1 << 21  # pairs that are held at once
PADDED = 1 << 23  # letters of sites and their pairs that are held at once
ORIENTS = ["fwd", "rc"]
SCHEMA = "bag_id string, key string, cluster_id long, median double, mad double, n_support long, support_frac double, pos_min long, pos_max long, mean_m double, min_m int, n_best long, mean_ties double, sites array<int>, orient string, L int, i int, mean_frac double, n_groups long, passes boolean, reason string, id string, anchor string, rank_support int, rank_groups int, rank_spread int"
INPUT = "bag_id string, site_ord int, valid long, orient int, L int, i int, f int, m int, flank string"


@dataclass(frozen=True)
class Rules:
    offset: float
    min_frac: float
    margin: int
    identity: float
    least_groups: int
    jaccard: float
    nc_offset: float
    rounds: int = 20
    overlap: float = 0.8  # of the sites of clusters of one window


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.ones(n + 1, bool)
    if n:
        new[1:n] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new) if n else np.zeros(1, np.int64)


def _number(edge: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(edge) - 1), np.diff(edge))


def _pairs(edge: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), a before b, of the rows of each run, some at a time."""
    later = np.repeat(edge[1:], np.diff(edge)) - np.arange(edge[-1]) - 1
    upto = np.concatenate([[0], np.cumsum(later)])
    at = 0
    while at < len(later):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK, "right")) - 1)
        n = later[at:end]
        a = np.repeat(np.arange(at, end), n)
        if len(a):
            yield a, a + 1 + np.arange(len(a)) - np.repeat(upto[at:end] - upto[at], n)
        at = end


def _gone(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``positions.outranked``: who goes if a row goes for a better one that stays (a is better than b)."""
    gone = np.zeros(n, bool)
    while len(a):
        worse = np.zeros(n, bool)
        worse[b] = True
        gone[b[~worse[a]]] = True
        left = ~gone[a] & ~gone[b]
        a, b = a[left], b[left]
    return gone


def _place(edge: np.ndarray) -> np.ndarray:
    return np.arange(edge[-1]) - np.repeat(edge[:-1], np.diff(edge))


def _middle(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Medians of runs that are sorted."""
    n = np.diff(edge)
    return (x[edge[:-1] + (n - 1) // 2] + x[edge[:-1] + n // 2]) / 2


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
    while (label != label[label]).any():
        label = label[label]
    return label


def score(bags: list[str], sites: dict[str, np.ndarray], flanks: list[str], hits: dict[str, np.ndarray], rules: Rules) -> pa.RecordBatch | None:
    """Rows of SCHEMA. sites: bag (a number), site (in order in a bag); hits: bag, site, valid, orient, L, i, f, m."""
    h = hits
    site = np.searchsorted(_code(sites["bag"], sites["site"]), _code(h["bag"], h["site"]))  # its row in sites
    order = np.lexsort((h["f"], site, h["i"], h["L"], h["orient"], h["bag"]))
    h, site = {k: v[order] for k, v in h.items()}, site[order]
    edge = _runs(h["bag"], h["orient"], h["L"], h["i"])
    group, pos, m = _number(edge), h["f"].astype(np.int64), h["m"].astype(np.int64)
    # the best hits of a site at a window of nc
    own = _runs(group, site)
    of = _number(own)
    ties = np.add.reduceat((m == np.maximum.reduceat(m, own[:-1])[of]).astype(np.int64), own[:-1])[of]
    first = np.zeros(len(m), bool)
    first[np.lexsort((pos, -m, of))[own[:-1]]] = True
    # the centres for which a hit is its site's nearest
    offset = rules.offset
    lo, hi = pos - float(offset), pos + float(offset)
    k = np.flatnonzero(of[1:] == of[:-1])
    half = (pos[k] + pos[k + 1]) / 2
    lo[k + 1] = np.maximum(lo[k + 1], np.where(m[k + 1] > m[k], half, half + 0.25))
    hi[k] = np.minimum(hi[k], np.where(m[k] >= m[k + 1], half, half - 0.25))
    need = np.maximum(1, np.ceil(np.round(h["valid"] * rules.min_frac, 9))).astype(np.int64)
    keep = lo <= hi
    keep &= (np.bincount(group[keep], minlength=len(edge) - 1) >= need[edge[:-1]])[group]
    if not keep.any():
        return None
    by = np.flatnonzero(keep)
    by = by[np.lexsort((pos[by], group[by]))]
    bag, orient, L, i, site, pos, m, lo, hi, need, ties, first, valid = (x[by] for x in (h["bag"], h["orient"], h["L"], h["i"], site, pos, m, lo, hi, need, ties, first, h["valid"]))
    edge = _runs(group[by])
    group, size, begin = _number(edge), np.diff(edge), edge[:-1]
    need = need[begin]
    least, span = int(pos.min()), 2 * int(pos.max() - pos.min()) + 1

    def supporters(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centre, row) of the supporters of each centre, rows in the order of places."""
        out = []
        upto = np.concatenate([[0], np.cumsum(size[g])])
        a = 0
        while a < len(g):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + BLOCK, "right")) - 1)
            c = np.repeat(np.arange(a, b), size[g[a:b]])
            r = np.repeat(begin[g[a:b]] - (upto[a:b] - upto[a]), size[g[a:b]]) + np.arange(len(c))
            held = (lo[r] <= at[c]) & (at[c] <= hi[r])
            out.append((c[held], r[held]))
            a = b
        return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))

    at = np.concatenate([np.ceil(lo), np.floor(hi) + 1])
    g = np.concatenate([group, group])
    inside = at <= np.maximum.reduceat(pos, begin)[g]
    g, at = g[inside], np.maximum(at[inside], np.minimum.reduceat(pos, begin)[g[inside]])
    code = np.unique(g * span + (2 * (at - least)).astype(np.int64))
    seen, stay = None, [np.zeros(0, np.int64)]
    for _ in range(rules.rounds + 1):
        g, at = code // span, code % span / 2 + least
        c, r = supporters(g, at)
        n = np.bincount(c, minlength=len(g))
        enough = n >= np.maximum(1, need[g])
        held = enough[c]
        c, r = c[held], r[held]
        runs = _runs(c)
        centre = c[runs[:-1]]
        to = _middle(pos[r], runs) if len(c) else np.zeros(0)
        if seen is None:
            seen = np.zeros(0, np.int64)
        else:
            stay.append(code[centre[to == at[centre]]])
            seen = np.union1d(seen, code)
        code = np.unique(g[centre] * span + (2 * (to - least)).astype(np.int64))
        code = code[~np.isin(code, seen, assume_unique=True)]
        if not len(code):
            break
    code = np.unique(np.concatenate(stay))
    if not len(code):
        return None
    # what is known of a cluster
    g, at = code // span, code % span / 2 + least
    c, r = supporters(g, at)
    runs = _runs(c)
    start, n = runs[:-1], np.diff(runs)
    away = np.abs(pos[r] - at[c])
    mad = _middle(away[np.lexsort((away, c))], runs)
    by_site = r[np.lexsort((site[r], c))]
    local = site - np.searchsorted(sites["bag"], bag)  # a site's number in its bag
    mask = np.bitwise_or.reduceat(np.uint64(1) << local[r].astype(np.uint64), start)
    lead = r[start]
    mean_m = np.add.reduceat(m[r], start) / n
    x = {
        "group": g, "bag": bag[lead], "orient": orient[lead], "L": L[lead], "i": i[lead], "median": at, "mad": mad, "n": n, "support": n / np.maximum.reduceat(valid[r], start), "pos_min": pos[lead], "pos_max": pos[r[runs[1:] - 1]],
        "mean_m": mean_m, "min_m": np.minimum.reduceat(m[r], start), "n_best": np.add.reduceat(first[r].astype(np.int64), start), "mean_ties": np.add.reduceat(ties[r], start) / n, "mask": mask, "start": start,
    }

    def alike(a: np.ndarray, b: np.ndarray, jaccard: float) -> np.ndarray:
        both = np.bitwise_count(x["mask"][a] & x["mask"][b]).astype(np.int64)
        return both >= jaccard * (x["n"][a] + x["n"][b] - both)

    def conflicts(edge: np.ndarray, near, jaccard: float) -> tuple[np.ndarray, np.ndarray]:
        out = [(np.zeros(0, np.int64),) * 2]
        for a, b in _pairs(edge):
            close = near(a, b)
            a, b = a[close], b[close]
            close = alike(a, b, jaccard)
            out.append((a[close], b[close]))
        return np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])

    def take(rows: np.ndarray) -> None:
        for k in x:
            x[k] = x[k][rows]

    # of clusters of one window with nearly the same sites the best stays
    take(np.lexsort((x["median"], x["mad"], -x["mean_m"], -x["n"], x["group"])))
    a, b = conflicts(_runs(x["group"]), lambda a, b: np.abs(x["median"][a] - x["median"][b]) <= offset, rules.overlap)
    take(np.flatnonzero(~_gone(len(x["n"]), a, b)))
    take(np.lexsort((x["median"], x["mad"], -x["n"], x["group"])))
    number = _place(_runs(x["group"]))
    count = len(number)
    # groups of sites whose letters beside the match are the same
    member = np.repeat(x["start"], x["n"]) + _place(np.concatenate([[0], np.cumsum(x["n"])]))
    own = local[by_site[member]]
    equal, index, letters = _equal_letters(sites, flanks)
    linked = [(np.zeros(0, np.int64),) * 2]
    cluster = np.repeat(np.arange(count), x["n"])
    within = np.concatenate([[0], np.cumsum(x["n"])])
    where = np.floor(x["median"]).astype(np.int64)
    for a, b in _pairs(within):
        e = cluster[a]
        p = index(x["bag"][e], own[a], own[b])
        shorter = letters[p]
        low, high = np.maximum(0, where[e] - rules.margin), where[e] + x["L"][e] + rules.margin
        left, right = np.minimum(low, shorter), np.maximum(0, shorter - high)
        share = lambda k, n: np.divide(k, n, out=np.zeros(len(n)), where=n > 0)
        high = np.minimum(high, shorter)
        same = np.maximum(share(equal[p, left], left), share(equal[p, shorter] - equal[p, high], right)) > rules.identity
        linked.append((a[same], b[same]))
    root = _roots(len(cluster), *(np.concatenate([p[k] for p in linked]) for k in (0, 1)))
    n_groups = np.bincount(cluster[root == np.arange(len(root))], minlength=count)
    # one motif seen at other lengths or a few letters on
    key = [f"{ORIENTS[o]}|{n}|{p}" for o, n, p in zip(x["orient"].tolist(), x["L"].tolist(), x["i"].tolist())]
    name = [f"{k}#{c}" for k, c in zip(key, number.tolist())]
    rank = np.empty(count, np.int64)
    rank[np.argsort(np.array(name), kind="stable")] = np.arange(count)
    frac = x["mean_m"] / x["L"]
    rows = np.lexsort((rank, x["mad"], -x["L"], -frac, x["orient"], x["bag"]))
    y = {c: x[c][rows] for c in ("bag", "orient", "i", "median")}
    near = lambda a, b: (np.abs(y["i"][a] - y["i"][b]) <= rules.nc_offset) & (np.abs(y["median"][a] - y["median"][b]) <= offset)
    held, x["mask"], x["n"] = (x["mask"], x["n"]), x["mask"][rows], x["n"][rows]
    a, b = conflicts(_runs(y["bag"], y["orient"]), near, rules.jaccard)
    x["mask"], x["n"] = held
    gone = _gone(count, a, b)
    to = np.arange(count)
    led = ~gone[a] & gone[b]
    to[gone] = count
    np.minimum.at(to, b[led], a[led])
    anchor = np.empty(count, np.int64)
    anchor[rows] = rows[to]
    passes = n_groups >= rules.least_groups

    def ranks(*keys: np.ndarray) -> pa.Array:
        by = np.lexsort((rank, *reversed(keys), passes, x["bag"]))
        out = np.empty(count, np.int32)
        out[by] = _place(_runs(x["bag"][by], passes[by])) + 1
        return pa.array(out, pa.int32(), mask=~passes)

    names = np.array(name, object)
    columns = [
        pa.array([bags[k] for k in x["bag"].tolist()], pa.string()), pa.array(key, pa.string()), pa.array(number, pa.int64()), pa.array(x["median"]), pa.array(x["mad"]), pa.array(x["n"], pa.int64()), pa.array(x["support"]), pa.array(x["pos_min"], pa.int64()), pa.array(x["pos_max"], pa.int64()),
        pa.array(x["mean_m"]), pa.array(x["min_m"], pa.int32()), pa.array(x["n_best"], pa.int64()), pa.array(x["mean_ties"]), pa.ListArray.from_arrays(pa.array(within, pa.int32()), pa.array(sites["site"][site[by_site[member]]], pa.int32())), pa.array([ORIENTS[o] for o in x["orient"].tolist()], pa.string()),
        pa.array(x["L"], pa.int32()), pa.array(x["i"], pa.int32()), pa.array(frac), pa.array(n_groups, pa.int64()), pa.array(passes), pa.array(np.full(count, "insufficient_bg_groups", object), pa.string(), mask=passes), pa.array(name, pa.string()), pa.array(names[anchor], pa.string()),
        ranks(-x["n"], x["mad"]), ranks(-n_groups, -x["n"]), ranks(x["mad"], -x["n"]),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def _code(bag: np.ndarray, site: np.ndarray) -> np.ndarray:
    return (bag.astype(np.int64) << 32) + (site.astype(np.int64) + (1 << 31))


def _equal_letters(sites: dict[str, np.ndarray], flanks: list[str]):
    """For each pair of sites of a bag in how many of the first letters they are equal, the row of a pair, and the shorter one's length."""
    edge = _runs(sites["bag"])
    length = np.array([len(f) for f in flanks])
    text = np.zeros((len(flanks), int(length.max(initial=0))), np.uint32)
    text[np.arange(text.shape[1]) < length[:, None]] = np.frombuffer("".join(flanks).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.diff(edge)
    offset = np.zeros(int(sites["bag"].max(initial=0)) + 2, np.int64)
    size = np.zeros_like(offset)
    offset[sites["bag"][edge[:-1]]] = np.cumsum(n * (n - 1) // 2) - n * (n - 1) // 2
    size[sites["bag"][edge[:-1]]] = n
    pairs = list(_pairs(edge))
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    shorter = np.minimum(length[a], length[b])
    equal = np.zeros((len(a), text.shape[1] + 1), np.int32)
    np.cumsum((text[a] == text[b]) & (np.arange(text.shape[1]) < shorter[:, None]), axis=1, out=equal[:, 1:])
    return equal, lambda bag, s, t: offset[bag] + s * size[bag] - s * (s + 1) // 2 + t - s - 1, shorter


def scored(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA of rows of INPUT, which come sorted by bag_id, those of a bag together: sites with a flank, and hits
    without. A bag beyond the limits, or with sites that are not told apart, is one row of its name alone."""
    names = [c.split()[0] for c in INPUT.split(", ")]
    kept, held, beyond, odd = [], 0, None, []

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        number = table.column("bag_id").combine_chunks().dictionary_encode()
        bags, bag = number.dictionary.to_pylist(), number.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        is_site = table.column("f").is_null().to_numpy(zero_copy_only=False)
        value = lambda c: table.column(c).fill_null(-1).to_numpy().astype(np.int64)
        col = {c: value(c) for c in names[1:-1]}
        some = table.filter(pa.array(is_site)).column("flank").to_pylist()
        s_bag, s_site = bag[is_site], col["site_ord"][is_site]
        order = np.lexsort((s_site, s_bag))
        s_bag, s_site, some = s_bag[order], s_site[order], [some[k] or "" for k in order]
        longest = np.zeros(len(bags), np.int64)
        np.maximum.at(longest, s_bag, [len(t) for t in some])
        n_sites, n_hits = np.bincount(s_bag, minlength=len(bags)), np.bincount(bag[~is_site], minlength=len(bags))
        bad = (n_hits > HITS) | (n_sites > SITES) | (n_sites**2 * longest > LETTERS)
        bad[s_bag[1:][(s_bag[1:] == s_bag[:-1]) & (s_site[1:] == s_site[:-1])]] = True
        bad[bag[table.column("site_ord").is_null().to_numpy(zero_copy_only=False)]] = True
        odd.extend(bags[k] for k in np.flatnonzero(bad))
        # bags whose longest flanks are of about one length are worked out together, since letters are padded
        kind, cost = np.frexp(longest)[1], (n_sites * (n_sites + 1) // 2) * longest
        order = np.argsort(kind, kind="stable")
        share = np.empty(len(bags), np.int64)
        share[order] = np.cumsum(cost[order]) // PADDED
        for part in np.unique(np.where(bad, -1, kind.astype(np.int64) << 32 | share)).tolist():
            now = ~bad & ((kind.astype(np.int64) << 32 | share) == part)
            good, mine = now[s_bag], ~is_site & now[bag]
            if mine.any():
                hits = {c: v[mine] for c, v in zip(("bag", "site", "valid", "orient", "L", "i", "f", "m"), (bag, *(col[c] for c in names[1:-1])))}
                found = score(bags, {"bag": s_bag[good], "site": s_site[good]}, [t for t, g in zip(some, good) if g], hits, rules)
                if found is not None:
                    yield found

    for batch in batches:
        batch = pa.RecordBatch.from_arrays(batch.columns, names)
        if beyond is not None:  # the rest of a bag that is not worked out
            batch = batch.filter(pc.not_equal(batch.column(0), beyond))
        if not batch.num_rows:
            continue
        kept.append(batch)
        held += batch.num_rows
        if held >= ROWS:
            table = pa.Table.from_batches(kept).combine_chunks()
            bag = table.column(0).combine_chunks()
            ends = np.flatnonzero(pc.not_equal(bag[1:], bag[:-1]).to_numpy(zero_copy_only=False))
            end = int(ends[-1]) + 1 if len(ends) else 0  # where the last bag, which may go on, begins
            if end:
                yield from flush(table.slice(0, end))
            kept, held = table.slice(end).to_batches(), table.num_rows - end
            if held > 2 * ROWS:
                beyond, kept, held = bag[-1], [], 0
                odd.append(beyond.as_py())
    if kept:
        yield from flush(pa.Table.from_batches(kept))
    if odd:
        none = pa.nulls(len(odd))
        fields = [c.split() for c in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
        yield pa.RecordBatch.from_arrays([pa.array(odd, pa.string()), *(none.cast(kinds[k]) for _, k in fields[1:])], [c for c, _ in fields])
