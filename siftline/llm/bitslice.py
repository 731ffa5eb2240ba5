"""Exact top-k inner products with a bit-sliced index (operator 10).

Method: every attribute of a block of rows is quantised to its leading bits, and each bit of each
attribute is a bitmap over the rows. A query's score is the sum of its weighted attribute slices,
added with full adders on whole bitmaps (a negative weight takes the complement slices). The k-th
largest sum is found from the most significant slice downward; rows whose sums could still reach it,
given what the quantisation left out, are the boundary rows and are scored exactly.

The index is built and written once: a row per block (of about ``block`` rows) with its ids, slices
and values in as few bytes as hold them. Queries are packed in groups of about ``group`` of the same
form. A task handles one block for one group, so both are bounded, and passes on k rows a query. All
rows are compared with all queries; what moves is the index once for each group and the queries once
for each block, which the sizes of both keep to about 2 * rows * queries / ``block`` short vectors.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without
an id; only vectors of equal length are compared (an empty one scores 0 with empty ones); repeated
rows count once; a query is not its own candidate, nor are other rows of its id; ties go to the
smaller id; fewer candidates than k are all returned; an empty table gives an empty result; extra
columns are left out. Sums must fit in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.session import cut, partitions, ship

BLOCK, GROUP, SLICES = 131072, 65536, 6
LEAST_BLOCK = 8192


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def top_in_block(q: np.ndarray, k: int, slices: list, rest: int, alive: np.ndarray, n: int) -> np.ndarray:
    """Row numbers that hold every one of the k best of a block of ``n`` rows. slices[sign][j]: bitmaps
    of attribute j (or of its complement), least significant first; ``rest``: bits left out."""
    columns: list[list[np.ndarray]] = [[] for _ in range(64)]
    for j in np.flatnonzero(q):
        weight, own = int(abs(q[j])), slices[int(q[j] < 0)][j]
        for a in range(weight.bit_length()):
            if weight >> a & 1:
                for b, bitmap in enumerate(own):
                    columns[a + b].append(bitmap)
    total = []
    for w, column in enumerate(columns):
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            t = a ^ b
            column.append(t ^ c)
            columns[w + 1].append((a & b) | (t & c))
        if len(column) == 2:
            a, b = column
            column[:] = [a ^ b]
            columns[w + 1].append(a & b)
        total.append(column[0] if column else None)
    while total and total[-1] is None:
        total.pop()
    count = lambda bits: int(np.bitwise_count(bits).sum())
    sure, tied, value = np.zeros_like(alive), alive, 0
    for w in range(len(total) - 1, -1, -1):
        high = tied & total[w] if total[w] is not None else np.zeros_like(alive)
        if count(sure) + count(high) >= k:
            tied, value = high, value | 1 << w
        else:
            sure, tied = sure | high, tied & ~high
    # what is left out adds at most |q| * (2**rest - 1) to one sum and nothing to another
    least = value - (int(np.abs(q).sum()) * ((1 << rest) - 1) + (1 << rest) - 1 >> rest) if rest else value
    if least <= 0:
        chosen = alive
    else:
        chosen, equal = np.zeros_like(alive), alive
        for w in range(max(len(total), least.bit_length()) - 1, -1, -1):
            bits = total[w] if w < len(total) and total[w] is not None else np.zeros_like(alive)
            if least >> w & 1:
                equal = equal & bits
            else:
                chosen, equal = chosen | (equal & bits), equal & ~bits
        chosen = chosen | equal
    return np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little", count=n))


def bitmaps(x: np.ndarray, kept: int) -> tuple[np.ndarray, int]:
    """[attribute, bit, word]: slices of each attribute above its least value, least significant first,
    and the bits left out."""
    above = x - (x.min(0) if len(x) else 0)
    width = int(above.max()).bit_length() if above.size else 1
    rest = max(0, width - kept)
    lead, wide = above >> rest, min(kept, max(width, 1))
    padded = np.zeros((x.shape[1], wide, len(x) + -len(x) % 64), bool)
    for b in range(wide):
        padded[:, b, : len(x)] = (lead >> b & 1).T
    return np.packbits(padded, axis=2, bitorder="little").view(np.uint64), rest


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """Integers in the least type that holds them: its name, and their bytes."""
    most = int(np.abs(x).max()) if x.size else 0
    kind = next(k for k in ("int8", "int16", "int32", "int64") if k == "int64" or most < 1 << 8 * np.dtype(k).itemsize - 1)
    return kind, x.astype(kind).tobytes()


def blocks_of(rows: DataFrame, blocks: int) -> DataFrame:
    """The index of rows (id, v, q): a row per block, with its queries packed beside it."""
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")

    def built(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id", kind="stable")
        ids, own = x["id"].to_numpy(np.int64), np.stack(x["v"].to_list()).astype(np.int64)
        asked = x["q"].to_numpy(bool)
        slices, rest = bitmaps(own, SLICES)
        kind, values = packed(own)
        q_kind, q_values = packed(own[asked])
        row = (own.shape[1], int(x["rb"].iloc[0]), ids.tobytes(), kind, values, slices.shape[1], rest, slices.tobytes(), int(asked.sum()), ids[asked].tobytes(), q_kind, q_values)
        return pd.DataFrame([row], columns=["dim", "rb", "ids", "kind", "v", "wide", "rest", "slices", "nq", "q_ids", "q_kind", "q_v"])

    return rows.select("id", "v", "q", F.size("v").alias("dim"), block.alias("rb")).groupBy("dim", "rb").applyInPandas(built, "dim int, rb int, ids binary, kind string, v binary, wide int, rest int, slices binary, nq bigint, q_ids binary, q_kind string, q_v binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, id_col, score: each query's k rows of largest inner product of floor(scale * x)."""
    spark = vectors.sparkSession
    ship(spark)
    x = F.col(vector_col)
    rows = vectors.where(finite(x) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, nq = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    # small tables are cut finer, so that all tasks have a part
    block = min(block, max(LEAST_BLOCK, -(-n // partitions(spark))))
    blocks, groups = max(1, -(-n // block)), max(1, -(-nq // group))
    index = cut(blocks_of(rows.groupBy("id", "v").agg(F.max("q").alias("q")), blocks), "slices")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # both sides' keys must be of one type: equal values of different types are dealt to different tasks
    left = index.select("dim", "rb", "ids", "kind", "v", "wide", "rest", "slices", upto(groups).alias("qb"))
    right = index.where("nq > 0").select("dim", upto(blocks).alias("rb"), F.pmod(F.col("rb"), F.lit(groups)).cast("int").alias("qb"), "q_ids", "q_kind", "q_v")
    right = right.toDF(*right.columns)  # both sides come from one table

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((3, 0), np.int64)]
        for dim, raw, kind, v, wide, rest, slices in a[["dim", "ids", "kind", "v", "wide", "rest", "slices"]].itertuples(index=False):
            ids = np.frombuffer(raw, np.int64)
            own = np.frombuffer(v, kind).reshape(len(ids), dim)
            plain = np.frombuffer(slices, np.uint64).reshape(dim, wide, -(-len(ids) // 64))
            both = [plain, ~plain]
            every = np.packbits(np.pad(np.ones(len(ids), bool), (0, -len(ids) % 64)), bitorder="little").view(np.uint64)
            for q_ids, q_kind, q_v in b[["q_ids", "q_kind", "q_v"]].itertuples(index=False):
                asked = np.frombuffer(q_ids, np.int64)
                for query, q in zip(asked.tolist(), np.frombuffer(q_v, q_kind).reshape(len(asked), dim).astype(np.int64)):
                    alive = every.copy()
                    for i in range(*np.searchsorted(ids, [query, query + 1])):
                        alive[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
                    found = top_in_block(q, k, both, rest, alive, len(ids))
                    score = own[found].astype(np.int64) @ q
                    best = np.lexsort((ids[found], -score))[:k]
                    out.append(np.stack([np.full(len(best), query), ids[found[best]], score[best]]))
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), np.concatenate(out, 1))))

    keys = ["dim", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id bigint, id bigint, score bigint")
    return ranked(found, k, id_col)


def ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k best of each query_id: largest score first, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
