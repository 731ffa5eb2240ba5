"""The flagship plan: where passages of reference items recur across documents (exact windows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftline.functions import seq
from siftline.operators.windows import peaks
from siftline.registry import query, table


BLOCK = 4096


def windows(df: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    """keys, p, w: every window of n characters with its place, a block of a text at a time."""
    cut = df.select(*keys, F.posexplode(seq.blocks(text, BLOCK, n)).alias("b", "t"))
    return cut.select(*keys, "b", F.posexplode(seq.kmers("t", n)).alias("o", "w")).select(*keys, (F.col("b") * BLOCK + F.col("o")).alias("p"), "w")


def shared_positions(items: DataFrame, docs: DataFrame, item: str, doc: str, text: str, n: int) -> DataFrame:
    """item, p, s: in how many documents the window of an item at p occurs. Documents' windows are
    made distinct in each task before they move, and only those an item has are kept (the items'
    windows are broadcast by the engine when they are small)."""
    wanted = windows(items, [item], text, n)
    held = windows(docs, [doc], text, n).select(doc, "w").join(wanted.select("w").distinct(), "w", "left_semi").distinct()
    return wanted.join(held, "w").groupBy(item, "p").agg(F.countDistinct(doc).alias("s"))


@query("""
    WITH w AS (SELECT item_id, unnest(range(0, CAST(length(text) - 15 AS BIGINT))) AS p, text FROM benchmark WHERE length(text) >= 16),
    iw AS (SELECT item_id, p, substr(text, CAST(p + 1 AS BIGINT), 16) AS w FROM w),
    d AS (SELECT doc_id, unnest(range(0, CAST(length(text) - 15 AS BIGINT))) AS p, text FROM documents WHERE length(text) >= 16),
    dw AS (SELECT DISTINCT doc_id, substr(text, CAST(p + 1 AS BIGINT), 16) AS w FROM d),
    s AS (SELECT item_id, p, count(DISTINCT doc_id) AS s FROM iw JOIN dw USING (w) GROUP BY 1, 2),
    t AS (SELECT *, max(s) OVER (PARTITION BY item_id ORDER BY p RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS top FROM s)
    SELECT item_id, CAST(p AS INTEGER) AS p, s FROM t WHERE s = top""")
def peaks_shared_passages(spark, sf_dir):
    s = shared_positions(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", "text", 16)
    return peaks(s, ["item_id"], "p", "s", 5)


@query("""
    WITH w AS (SELECT item_id, unnest(range(0, CAST(length(text) - 15 AS BIGINT))) AS p, text FROM benchmark WHERE length(text) >= 16),
    iw AS (SELECT item_id, p, substr(text, CAST(p + 1 AS BIGINT), 16) AS w FROM w),
    d AS (SELECT doc_id, unnest(range(0, CAST(length(text) - 15 AS BIGINT))) AS p, text FROM documents WHERE length(text) >= 16),
    dw AS (SELECT DISTINCT doc_id, substr(text, CAST(p + 1 AS BIGINT), 16) AS w FROM d),
    h AS (SELECT DISTINCT item_id, p, doc_id FROM iw JOIN dw USING (w)),
    o AS (SELECT item_id, doc_id, p + k AS p, max(exp(-(k * k) / 8.0)) AS w FROM h, (SELECT unnest(range(-6, 7)) AS k) GROUP BY 1, 2, 3)
    SELECT item_id, CAST(p AS INTEGER) AS p, round(sum(w), 6) AS s FROM o GROUP BY 1, 2""")
def kernel_shared_passages(spark, sf_dir):
    """S(p) with a Gaussian kernel (tau 2) instead of plain counts."""
    from siftline.operators.windows import kernel_count

    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    wanted = windows(items, ["item_id"], "text", 16)
    held = windows(docs, ["doc_id"], "text", 16).select("doc_id", "w").join(wanted.select("w").distinct(), "w", "left_semi").distinct()
    return kernel_count(wanted.join(held, "w"), ["item_id"], "doc_id", "p", 2.0).withColumn("s", F.round("s", 6))
