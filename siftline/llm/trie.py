"""Prefix trie of conversations (operator 11).

Method: leaf-peeling message passing. Every node of the trie (a distinct sequence of first turns) is a
row, found by a rolling 128-bit hash of the turns up to it. Along each path the node belongs to the
longest conversation through it (the least id of equally long ones): the nodes of one such owner are a
branch, a run that ends at a childless node. A branch holds a counter of the branches that still hang on
it. Those whose counter is 0 are complete: they send their totals to the branch they hang on, which counts
them off, round after round, until only the root's branch finishes. Runs are peeled as one since a
conversation of n turns would else take n rounds; a branch hangs only on one that is at least as long
below that place, so rounds grow with the root of the number of turns at most (a handful as a rule).
What a node's own subtree holds then are sums from its branch's end upwards.

Texts are read once and not shuffled: a turn is its place, two hashes and a length. Running values (places
of turns, rolling hashes, sums along branches) are taken over ranges of rows, with the totals of the ranges
before added, so a conversation may hold any part of all rows; a node that very many conversations share is
a grouped count with partial sums. Ids of equal conversations are joined in blocks of 4096 possible ids;
only a node with several blocks is hashed by one task, block after block, as SHA-256 demands.

Cases: turns without a conversation id are left out; turns of equal place (nulls first) go by role, then by
the hash of their text, and repeated rows are turns of their own; null roles and texts are empty; extra
columns are left out; without any conversation there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.session import cut, partitions, ship

HUNDRED, MOST_SHARED = 100, 5
BLOCK = 12  # bits of an id within a block
KEY = ["depth", "p1", "p2"]


def running(df: DataFrame, by: str, order: list[str], sums: dict[str, Column] = {}, xors: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """Adds running sums and xors within ``by`` (never null), up to and with the row, for groups of any
    size: rows are dealt by range, and a range's first group starts from what the ranges before hold of it."""
    spark = df.sparkSession
    dealt = cut(df.withColumns(sums | xors).repartitionByRange(max(partitions(spark), 2), by, *order).withColumn("part", F.spark_partition_id()), "ranges")
    kinds = [(c, F.sum) for c in sums] + [(c, F.bit_xor) for c in xors]
    totals = dealt.groupBy(by, "part").agg(*[f(c).alias(c) for c, f in kinds])
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range at most: only its first group has come up before
    start = totals.select(by, "part", *[f(c).over(before).alias(f"__{c}") for c, f in kinds]).where(F.col(f"__{kinds[0][0]}").isNotNull())
    own = Window.partitionBy(by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.withColumns({c: f(c).over(own) for c, f in kinds}).join(F.broadcast(start), [by, "part"], "left")
    held = {c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in sums} | {c: F.col(c).bitwiseXOR(F.coalesce(f"__{c}", F.lit(0))) for c in xors}
    return rows.withColumns(held).drop("part", *[f"__{c}" for c, _ in kinds])


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, idx (from 1), h1, h2 (of role and text), chars of every turn."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    hashes = F.xxhash64(text), F.xxhash64(F.lit(11), role, text)
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), hashes[0].alias("h1"), hashes[1].alias("h2"), F.length(text).cast("long").alias("chars"))
    return running(rows, "conv", ["turn", "role", "h1", "h2"], {"idx": F.lit(1).cast("long")}).drop("turn", "role")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, total) and their turns (conv, depth, h1, h2, chars, total) once each begins
    with as many turns of its hundred's first conversation as its id decides."""
    shared = F.crc32(F.col("conv").cast("string")) % (MOST_SHARED + 1)
    heads = rows.where((F.col("conv") % HUNDRED == 0) & (F.col("idx") <= MOST_SHARED)).groupBy(F.col("conv").alias("first")).agg(F.sort_array(F.collect_list(F.struct("idx", "h1", "h2", "chars"))).alias("head"))
    convs = rows.groupBy("conv").agg(F.max("idx").alias("n")).withColumns({"shared": shared, "first": F.col("conv") - F.col("conv") % HUNDRED}).join(heads, "first", "left")
    taken = F.least("shared", F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    convs = cut(convs.withColumn("taken", taken).select("conv", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))).alias("total"), "head"), "conversations")
    own = rows.withColumn("shared", shared).where("idx > shared").join(convs.select("conv", "taken", "total"), "conv")
    own = own.select("conv", (F.col("idx") - F.col("shared") + F.col("taken")).alias("depth"), "h1", "h2", "chars", "total")
    begun = convs.where("taken > 0").select("conv", "total", F.explode(F.slice("head", F.lit(1), F.col("taken").cast("int"))).alias("t"))
    return convs.select("conv", "total"), own.unionByName(begun.select("conv", F.col("t.idx").alias("depth"), "t.h1", "t.h2", "t.chars", "total"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """KEY and ends_sha256: the hash of the ids (conv) of the conversations that end at a node."""
    ship(ends.sparkSession)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = cut(ends.groupBy(*KEY, F.shiftright("conv", BLOCK).alias("block")).agg(ids.alias("ids")), "ends")
    number = blocks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("blocks"), F.max("ids").alias("ids"))
    one = number.where("blocks = 1").select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    several = blocks.join(number.where("blocks > 1").select(*KEY), KEY, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in at), pa.array([digest.hexdigest()])], [*KEY, "ends_sha256"])

        for batch in batches:
            for *key, ids in zip(*(batch.column(k) for k in range(4))):
                key = [x.as_py() for x in key]
                if key != at:
                    if at:
                        yield made()
                    at, digest = key, hashlib.sha256(ids.as_py().encode())
                else:
                    digest.update(b"," + ids.as_py().encode())
        if at:
            yield made()

    dealt = several.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")
    return one.unionByName(dealt.mapInArrow(run, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string"))


def peel(branches: DataFrame) -> DataFrame:
    """Branches (owner, up: the branch it hangs on, at: the depth there, saved) with the totals of all that
    hangs on them: leaves, saved."""
    waits = branches.where("up is not null").groupBy(F.col("up").alias("owner")).agg(F.count(F.lit(1)).alias("remaining"))
    state = branches.join(waits, "owner", "left").select("owner", "up", "at", F.coalesce("remaining", F.lit(0)).alias("remaining"), F.lit(1).cast("long").alias("leaves"), "saved")
    done = []
    while True:
        state = cut(state, "branches")
        complete, waiting = state.where("remaining = 0"), state.where("remaining > 0")
        done.append(complete.drop("remaining"))
        if waiting.isEmpty():
            break
        sent = complete.groupBy(F.col("up").alias("owner")).agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        state = waiting.join(sent, "owner", "left").select("owner", "up", "at", (F.col("remaining") - F.coalesce("n", F.lit(0))).alias("remaining"), plus("leaves", "l"), plus("saved", "s"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def nodes(turns: DataFrame, **columns: str) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    convs, rows = rebuilt(ordered(turns, **columns))
    step = {"x1": F.xxhash64("depth", "h1", "h2"), "x2": F.xxhash64("h2", "depth", "h1", F.lit(5))}
    rows = cut(running(rows.withColumns(step), "conv", ["depth"], xors={"p1": F.col("x1"), "p2": F.col("x2")}), "prefixes")

    longest = F.min(F.struct((-F.col("total")).alias("short"), F.col("conv").alias("owner"))).alias("longest")
    made = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), longest, F.max("chars").alias("chars"), F.max(F.col("p1").bitwiseXOR(F.col("x1"))).alias("q1"), F.max(F.col("p2").bitwiseXOR(F.col("x2"))).alias("q2"))
    made = made.select(*KEY, "n_convs", "conv_id", "longest.owner", "chars", "q1", "q2")
    top = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv_id"), longest).first()
    root = [(0, 0, 0, top.n, top.conv_id, top.longest.owner, 0, None, None)] if top.n else []
    made = cut(made.unionByName(spark.createDataFrame(root, made.schema)), "nodes")

    zero = [F.lit(0).cast("long").alias(k) for k in KEY]
    ends = rows.where("depth = total").select(*KEY, "conv").unionByName(convs.where("total = 0").select(*zero, "conv"))
    children = made.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    made = made.join(children, KEY, "left").join(ends_digests(ends), KEY, "left")
    parents = made.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("up")).where("depth > 1")
    first = {"parent_conv_id": F.when(F.col("depth") == 1, F.lit(top.conv_id)).cast("long"), "up": F.when(F.col("depth") == 1, F.lit(top.longest.owner if top.n else None)).cast("long")}
    made = made.where("depth > 1").join(parents, ["depth", "q1", "q2"]).unionByName(made.where("depth <= 1").withColumns(first))
    own = (F.col("n_convs") - 1) * F.col("chars")
    made = cut(made.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "owner", "up", own.alias("own"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "nodes")

    entry = F.max(F.when(F.col("up") != F.col("owner"), F.struct("up", (F.col("depth") - 1).alias("at")))).alias("entry")
    hung = peel(made.groupBy("owner").agg(entry, F.sum("own").alias("saved")).select("owner", "entry.up", "entry.at", "saved"))
    got = hung.where("up is not null").groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    parts = made.join(got, ["owner", "depth"], "left").withColumn("height", -F.col("depth"))
    parts = parts.select("owner", "height", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "own", "ends_sha256", "l", "s")
    sums = {"n_leaves": F.coalesce("l", F.lit(0)) + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("own") + F.coalesce("s", F.lit(0))}
    return running(parts, "owner", ["height"], sums).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
