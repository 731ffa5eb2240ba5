"""Contiguous shards of equal bytes (operator 12).

Method: rows are dealt by range of their order; every range knows its total of bytes and rows, and the
totals of the ranges before it (global prefix sums, a row for each range) turn places within a range into
places of the whole. The line of all bytes is cut at equal targets: a row goes to the shard in which the
middle of its bytes lies, so a shard's bytes are off by one row's size at most. Shards are contiguous in
the order of ids, so a reader of a shard reads one run of the sorted data.

Texts stay where they are: only id, size and checksum are shuffled, once. Nothing depends on how many rows
one text or one id has, as the row's own number ends the order.

Cases: null texts have no bytes and the checksum 0 of no bytes; null ids come first; repeated rows take
places of their own; of equal ids the one of smaller size, then checksum comes first; with fewer rows than
shards some shards stay empty; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from siftline.session import cut, numbered, partitions, ship

SHARDS = 40
OVERHEAD = 16  # bytes that a row takes beside its text


def places(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """``rows`` with range (its number), and within it place (rows before) and ahead (bytes before), written."""
    ship(rows.sparkSession)
    dealt = rows.repartitionByRange(max(partitions(rows.sparkSession), 2), *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = ahead = 0
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index(size))
            upto = pc.add(pc.cumulative_sum(sizes), ahead)
            more = [pa.array(range(place, place + len(batch)), pa.int64()), pc.subtract(upto, sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "place", "ahead"])
            if len(batch):
                place, ahead = place + len(batch), upto[-1].as_py()

    return cut(dealt.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in dealt.dtypes) + ", place bigint, ahead bigint"), "places")


def shards(docs: DataFrame, n: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """id_col, size, text_crc32, shard (0 to n - 1), slot (the row's place in its shard)."""
    if n < 1:
        raise ValueError("there must be a shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized, row = numbered(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("crc")), "sizes")
    placed = places(sized, ["id", "size", "crc", row], "size")
    # a row for each range: its totals, and those of the ranges before
    totals = placed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", "bytes")], F.sum("bytes").over(Window.partitionBy(F.lit(1))).alias("total"))
    shard = F.expr(f"cast(least(cast(2 * (ahead + bytes_before) + size as decimal(38,0)) * {n} div (2 * total), {n - 1}) as int)")
    found = placed.join(F.broadcast(start), "range").select("id", "size", "crc", shard.alias("shard"), (F.col("place") + F.col("rows_before")).alias("place"))
    first = found.groupBy("shard").agg(F.min("place").alias("first"))  # n rows
    return found.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", n: int = SHARDS) -> None:
    """Documents in a folder for each shard, in its order. Ids must be unique."""
    rows = docs.join(placed.select(id_col, "shard", "slot"), id_col)
    rows.repartitionByRange(n, "shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
