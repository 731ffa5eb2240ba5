"""Sinks: partitioned writes, append of what is missing, manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, functions as F

from siftline.functions.seq import slice_at, wrap_fasta


def write_many(outputs: dict[str, DataFrame], root: str, kind: str = "parquet") -> None:
    """One folder for each output (tsv or parquet)."""
    for name, df in outputs.items():
        writer = df.write.mode("overwrite")
        if kind == "tsv":
            writer.option("sep", "\t").option("header", True).csv(f"{root}/{name}")
        else:
            writer.parquet(f"{root}/{name}")


def route_json(df: DataFrame, split: str, path: str) -> None:
    """JSON lines in a folder for each value of ``split``."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_match_table(df: DataFrame, path: str) -> None:
    """Partitioned by orientation and length, rows of a bag together."""
    df.repartition("orient", "L", "bag_id").sortWithinPartitions("bag_id").write.mode("overwrite").partitionBy("orient", "L").parquet(path)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the target does not have yet: a broken run can be run again."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df.write.mode("append").parquet(path)


def write_manifest(spark, path: str, complete: bool, **facts) -> None:
    """One JSON row; a run writes complete=False first and True last."""
    spark.createDataFrame([(complete, json.dumps(facts, sort_keys=True))], "complete boolean, facts string").coalesce(1).write.mode("overwrite").json(path)


def fasta_slices(df: DataFrame, seq: str, name: str, lo: str, hi: str, pad: int) -> DataFrame:
    """value: records of [lo - pad, hi + pad) clipped to the sequence, 60 letters a line, for a text sink."""
    a = F.greatest(F.col(lo) - pad, F.lit(0))
    b = F.least(F.col(hi) + pad, F.length(seq))
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrap_fasta(slice_at(seq, a, b - a))).alias("value"))


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int, facts: dict[str, str]) -> None:
    """A table in buckets of ``key``, sorted in them: tables of equal keys and numbers of buckets are joined and
    grouped by it without moving a row. ``facts`` (digests of what it was made from) become a table {name}_facts
    beside it, written last: a table without it is not complete."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{name}_facts`")
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{path}/rows").saveAsTable(name)
    known = spark.createDataFrame(sorted(facts.items()), "fact string, value string")
    known.coalesce(1).write.mode("overwrite").format("parquet").option("path", f"{path}/facts").saveAsTable(f"{name}_facts")


def digest_of(df: DataFrame) -> str:
    """A digest of the rows of a table, in whatever order and partitions: sums of two hashes of each row."""
    columns = sorted(df.columns)
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(k), row).cast("decimal(38,0)")).alias(f"h{k}") for k in range(2)]).first()
    return hashlib.sha256(f"{columns}|{sums.n}|{sums.h0}|{sums.h1}".encode()).hexdigest()
