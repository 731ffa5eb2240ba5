"""Conversation trie, shards and Merkle manifest against plain loops, with odd rows in every input."""

import collections
import functools
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siftline.llm import merkle, queries, sharding, trie

DIR = "/root/testdata/sf0.001"
LONG = "Ab é漢😀 " * 400_000  # over 4 MB


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- operator 11


def nodes_by_loops(turns):
    """The nodes of ``turns`` (conv_id, turn, role, text), whose order within a turn is given."""
    original = collections.defaultdict(list)
    for c, _, role, text in sorted((t for t in turns if t[0] is not None), key=lambda t: (t[1] is not None, t[1] or 0)):
        original[c].append((role or "", text or ""))
    members = collections.defaultdict(list)
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(original.get(c - c % 100, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path) == d))
    out = {}
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    for k, m in members.items():
        c = min(m)[0]
        up = min(members[k[:-1]])[0] if k else None
        out[(c, len(k))] = (up, len(m), children[k], leaves[k], saved[k], sha(",".join(str(x) for x, end in sorted(m) if end)))
    return out


def found_nodes(spark, turns):
    rows = [(*t, "x", 1) for t in turns]
    draw = random.Random(0)
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, owner string, depth long").repartition(5)
    got = trie.nodes(df).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    return {(r.conv_id, r.depth): tuple(r)[2:] for r in got}


def test_trie_by_loops(spark):
    draw = random.Random(4)
    say = ["", None, "yes", "no, not that", "é漢😀", "why"]
    turns = [(c, t, draw.choice(["user", None, "assistant", ""]), draw.choice(say)) for c in range(330) if c % 7 for t in draw.sample(range(9), draw.randrange(1, 6))]
    turns += [(500, t, "user", f"turn {t}") for t in range(300)]  # one very long
    turns += [(501 + k, t, "user", f"turn {t}") for k in range(9) for t in range(5 + 9 * k)]  # snapshots of it
    turns += [(c, None if t == 0 else t, "user", "same") for c in range(10_000, 22_000, 200) for t in range(3)]  # many blocks of equal ones
    turns += [(600, 0, "u", "only"), (640, 0, "u", "only"), (None, 0, "user", "no conversation")]
    turns += [(700, 1, "u", "twice"), (700, 1, "u", "twice")]
    assert found_nodes(spark, turns) == nodes_by_loops(turns)


def test_trie_of_few(spark):
    assert found_nodes(spark, []) == {}
    assert found_nodes(spark, [(None, 1, "u", "x")]) == {}
    for c in (1, 7, 100, -3):  # alone; a turnless one has only the root
        assert found_nodes(spark, [(c, 1, "u", "x")]) == nodes_by_loops([(c, 1, "u", "x")])
    turns = [(5, None, None, None), (5, 1, "u", LONG), (6, 1, "u", LONG)]
    assert found_nodes(spark, turns) == nodes_by_loops(turns)


def test_peeling_runs_until_the_root(spark):
    """A branch that hangs on one that hangs on another, and so on."""
    chain = spark.createDataFrame([(k, k - 1 if k else None, 1 if k else None, 10 + k) for k in range(6)], "owner long, up long, at long, saved long")
    assert {r.owner: (r.leaves, r.saved) for r in trie.peel(chain).collect()} == {k: (6 - k, sum(10 + j for j in range(k, 6))) for k in range(6)}


def test_running_values_go_on_over_ranges(spark):
    rows = [(k % 3 if k % 5 else 0, k, k * k) for k in range(500)]
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(3)
    got = trie.running(df, "g", ["k"], {"s": F.col("v")}, {"x": F.col("v")}).collect()
    want, s, x = {}, collections.Counter(), collections.Counter()
    for g, k, v in sorted(rows):
        s[g] += v
        x[g] ^= v
        want[g, k] = s[g], x[g]
    assert {(r.g, r.k): (r.s, r.x) for r in got} == want


# --- operator 12


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, size string, place long").repartition(4)


def shards_by_loops(rows, n):
    order = sorted(((i is not None, i or 0), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), i) for i, t, *_ in rows)
    total, before, out, slots = sum(x[1] for x in order), 0, [], collections.Counter()
    for _, size, crc, i in order:
        shard = min((2 * before + size) * n // (2 * total), n - 1)
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


@pytest.mark.parametrize("n", [1, 7, 40])
def test_shards_by_loops(spark, n):
    draw = random.Random(n)
    rows = [(i, draw.choice([None, "", "é漢😀", "word " * draw.randrange(200)]), "s", "l", 1) for i in range(300)]
    rows += [(None, "no id", "s", "l", 1), (None, None, None, None, None), (3, "twice", "s", "l", 1), (3, "twice", "s", "l", 1)] + [(1000, "hot", "s", "l", 1)] * 200
    got = sharding.shards(documents(spark, rows), n).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(shards_by_loops(rows, n))
    held = collections.Counter()
    for r in got:
        held[r.shard] += r.size
    assert max(held.values()) - min(held.values()) <= 2 * max(r.size for r in got) and len(held) == n


def test_shards_of_few(spark, tmp_path):
    assert sharding.shards(documents(spark, []).limit(0)).count() == 0
    assert [tuple(r) for r in sharding.shards(documents(spark, [(5, None, None, None, None)])).collect()] == shards_by_loops([(5, None)], 40)
    rows = [(1, LONG, "s", "l", 1), (2, "b", "s", "l", 1), (3, "c", "s", "l", 1)]
    assert sorted(map(tuple, sharding.shards(documents(spark, rows)).collect())) == sorted(shards_by_loops(rows, 40))
    with pytest.raises(ValueError):
        sharding.shards(documents(spark, rows), 0)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    sharding.write_shards(docs, sharding.shards(docs, 5), str(tmp_path / "out"), n=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard").exceptAll(docs).count() == 0 and back.count() == docs.count() and back.select("shard").distinct().count() == 5


# --- operator 13


def manifest_by_loops(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def levels(nodes):
        """All levels, up to the one of one node."""
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def way(made, i):
        """(before, after) of node i on each level below the top."""
        out = []
        for nodes in made[:-1]:
            r = i // 16 * 16
            out.append(("".join(nodes[r:i]), "".join(nodes[i + 1 : r + 16])))
            i //= 16
        return out

    leaf = lambda i, t, s, lang, n: sha("".join(map(field, (i, s, lang, n, t))))
    low = str.maketrans(merkle.UPPER, merkle.LOWER)
    groups = collections.defaultdict(list)
    for i, t, s, lang, n in rows:
        other = leaf(i, t.translate(low), s, lang, n) if t is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else None
        groups[s].append(((i is not None, i or 0), leaf(i, t, s, lang, n), i, other))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: levels([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in names}
    top = levels([made[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for j, (_, own, i, other) in enumerate(sorted(groups[s], key=lambda x: x[:2])):
            steps = way(made[s], j) + way(top, k)
            folded = functools.reduce(lambda h, x: sha(x[0] + h + x[1]), steps, other or own)
            out.append((i, own, made[s][-1][0], top[-1][0], sha("".join(b + a for b, a in steps)), folded, folded == top[-1][0]))
    return out


def manifest(spark, rows):
    return collections.Counter(map(tuple, merkle.manifest(documents(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()))


def test_manifest_by_loops(spark):
    draw = random.Random(9)
    rows = [(i, draw.choice([None, "", "No Caps", "all lower", "É漢😀"]), draw.choice(["a", "b", "é", None, ""] + ["hot"] * 5), draw.choice([None, "en"]), draw.choice([None, 5])) for i in range(700)]
    rows += [(None, "No Id", "a", "en", 1), (None, "Other", "a", "en", 1), (2**60 + 1, "Large", "a", "en", 1)] + [(7, "Twice", "b", None, 2)] * 40 + [(k, "One", f"site{k}", "en", 3) for k in range(60)]
    assert manifest(spark, rows) == collections.Counter(manifest_by_loops(rows))


def test_manifest_of_few(spark):
    assert not manifest(spark, [])
    for n in (1, 2, 16, 17, 256, 257):
        rows = [(k, "Text", "one", "en", 4) for k in range(n)]
        assert manifest(spark, rows) == collections.Counter(manifest_by_loops(rows))
    rows = [(4, LONG, None, "en", 1), (5, LONG, None, "en", 1)]
    assert manifest(spark, rows) == collections.Counter(manifest_by_loops(rows))


def test_parts_and_ragged_nodes_make_the_whole_tree():
    """However leaves are cut into parts, what parts hold whole and what they give away are all nodes once."""
    draw = random.Random(2)
    for n in (1, 15, 16, 17, 255, 256, 300, 4100):
        leaves = [sha(str(k)) for k in range(n)]
        whole = [leaves]
        while len(whole[-1]) > 1:
            whole.append([merkle.digest(whole[-1][i : i + 16]) for i in range(0, len(whole[-1]), 16)])
        edges = sorted({0, n, *draw.choices(range(n + 1), k=5)})
        given = collections.defaultdict(dict)
        for lo, hi in zip(edges, edges[1:]):
            levels = merkle.local_levels(leaves[lo:hi], lo, n)
            for level, (at, nodes, *_) in enumerate(levels):
                assert whole[level][at : at + len(nodes)] == nodes
            for level, place, d, top in merkle.ragged(levels):
                assert place not in given[level] and whole[level][place] == d and top == (len(whole[level]) == 1)
                given[level][place] = d
            assert sum(len(v) for v in given.values()) <= 30 * len(whole) * (len(edges) - 1)


def test_queries_return_what_is_asked(spark):
    kinds = {
        "op11_trie": [("conv_id", "bigint"), ("depth", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"), ("n_children", "bigint"), ("n_leaves", "bigint"), ("saved_tokens", "bigint"), ("ends_sha256", "string")],
        "op12_sharding": [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")],
        "op13_merkle": [("doc_id", "bigint"), *[(c, "string") for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", "boolean")],
    }
    for name, want in kinds.items():
        assert queries.QUERIES[name](spark, DIR).dtypes == want
