"""Queries that go through files: each writes rows with a sink (or as plain text lines) into the shared
folder and gives what a reader makes of them. The files stay as long as the result may be read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftline.functions import seq
from siftline.operators import joins, validate
from siftline.plans.sequences import PAIRS, pairs
from siftline.registry import query, table
from siftline.session import shared_dir
from siftline.sources import readers, sinks
from siftline.streaming import increments


def folder(spark) -> str:
    return f"{shared_dir(spark)}/siftline/files-{uuid.uuid4().hex}"


def text_file(spark, lines, path: str) -> str:
    """``lines``: a frame of one string column."""
    lines.write.text(path)
    return path


def put(spark, path: str, content: str) -> None:
    """One small file of a fixture."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(content.encode()))
    out.close()


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def io_tsv(spark, sf_dir):
    at = folder(spark)
    sinks.write_many({"parts": table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")}, at, "tsv")
    return readers.tsv(spark, f"{at}/parts")


@query("""
    WITH r AS (SELECT c_mktsegment AS bag_id, 's' || c_custkey AS site_id, c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'ACGT' || c_custkey END AS flank, c_custkey % 2 = 0 AS pos FROM customer)
    SELECT bag_id, site_id, flank, 'AC,GT' AS regions, pos AS is_positive, CAST('v' || c_custkey AS VARCHAR) AS version FROM r""")
def io_sites(spark, sf_dir):
    """Site records as JSON lines in a folder per segment; an empty flank is null, order is kept as site_ord."""
    at, k = folder(spark), F.col("c_custkey")
    labels = F.struct((k % 2 == 0).alias("is_positive"))
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s"), k).alias("site_id"), F.col("c_mktsegment").alias("transposase_id"), F.col("c_mktsegment").alias("part"),
        F.struct(F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("ACGT"), k)).alias("flank"), F.lit(["AC", "GT"]).alias("noncoding_regions")).alias("inputs"), labels.alias("labels"), F.create_map(F.lit("generator_version_or_commit"), F.concat(F.lit("v"), k)).alias("generator_metadata"),
    )
    sinks.route_json(rows, "part", at)
    sites = readers.sites(spark, f"{at}/*")
    return sites.select("bag_id", "site_id", "flank", F.array_join("nc_regions", ",").alias("regions"), "labels.is_positive", F.col("meta")["generator_version_or_commit"].alias("version"))


@query("""SELECT 'r' || p_partkey AS id, 'r' || p_partkey AS header, replace(upper(substr(p_name || p_type, greatest(p_size - 3, 0) + 1, least(length(p_name || p_type), p_size + 13) - greatest(p_size - 3, 0))), ' ', '') AS seq FROM part""")
def io_fasta(spark, sf_dir):
    """Slices of names as FASTA records, read again."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), "p_partkey").alias("name"), F.concat("p_name", "p_type").alias("s"), F.col("p_size").alias("lo"), (F.col("p_size") + 10).alias("hi"))
    at = text_file(spark, sinks.fasta_slices(p, "s", "name", "lo", "hi", 3), folder(spark))
    return readers.fasta(spark, at)


@query("""
    SELECT 'c' || s_nationkey AS contig, CAST(10 * s_suppkey - 1 AS INTEGER) AS lo, CAST(10 * s_suppkey + 5 AS INTEGER) AS hi, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'ID=' || s_suppkey AS attributes, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS ordinal FROM supplier WHERE s_suppkey % 3 <> 0""")
def io_gff(spark, sf_dir):
    k = F.col("s_suppkey")
    lines = table(spark, sf_dir, "supplier").select(F.concat_ws("\t", F.concat(F.lit("c"), "s_nationkey"), F.lit("x"), F.when(k % 3 == 0, "gene").otherwise("CDS"), 10 * k, 10 * k + 5, F.lit("."), F.when(k % 2 == 0, "+").otherwise("-"), F.lit("0"), F.concat(F.lit("ID="), k)))
    return readers.gff_cds(spark, text_file(spark, lines, folder(spark)))


@query("SELECT 'q' || l_orderkey AS query, 's' || l_partkey AS subject, l_discount * 100 AS identity, CAST(l_quantity AS INTEGER) AS length, l_linenumber AS mismatches, l_extendedprice AS bits FROM lineitem")
def io_blast(spark, sf_dir):
    c = F.col
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("\t", F.concat(F.lit("q"), "l_orderkey"), F.concat(F.lit("s"), "l_partkey"), c("l_discount") * 100, c("l_quantity").cast("int"), "l_linenumber", *[F.lit("0")] * 5, F.lit("1e-5"), "l_extendedprice"))
    return readers.blast_tab(spark, text_file(spark, lines, folder(spark))).select("query", "subject", "identity", "length", "mismatches", "bits")


@query("""
    WITH h AS (SELECT 't' || l_partkey AS target, 'q' || l_suppkey AS query, l_linenumber / 1000.0 AS e, l_quantity AS score FROM lineitem)
    SELECT query, string_agg(target || ':' || CAST(score AS INTEGER), ',' ORDER BY e, target, score) AS hits FROM h WHERE e <= 0.002 GROUP BY 1""")
def io_domains(spark, sf_dir):
    """Rows of a domain table with comments; the hits of each query, best first."""
    n, filler = F.col("l_linenumber"), [F.lit("-")]
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("   ", F.concat(F.lit("t"), "l_partkey"), *filler * 2, F.concat(F.lit("q"), "l_suppkey"), *filler * 8, n / 1000, "l_quantity"))
    at = text_file(spark, spark.createDataFrame([("# a comment",)], "value string").unionByName(rows.toDF("value")), folder(spark))
    hits = readers.domain_table(spark, at, 0.002)
    return hits.select("query", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["target"], h["score"].cast("int").cast("string"))), ",").alias("hits"))


@query("SELECT 't' || p_partkey AS target, 'm' || p_size AS model, p_size AS seq_from, p_size + 10 AS seq_to, '+' AS strand, p_size / 2.0 AS score FROM part")
def io_covariance(spark, sf_dir):
    s, filler = F.col("p_size"), [F.lit("-")]
    rows = table(spark, sf_dir, "part").select(F.concat_ws(" ", F.concat(F.lit("t"), "p_partkey"), *filler, F.concat(F.lit("m"), s), *filler * 4, s, s + 10, F.lit("+"), *filler * 4, s / 2, F.lit("1e-3")))
    return readers.covariance_table(spark, text_file(spark, rows, folder(spark))).select("target", "model", "seq_from", "seq_to", "strand", "score")


@query("SELECT CAST(p_partkey AS INTEGER) AS pos, CASE WHEN p_partkey % 4 = 0 THEN 'NA' ELSE CAST(p_size AS VARCHAR) END || ',' || (p_size + 1) AS \"values\", CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END AS n_valid FROM part")
def io_unpaired(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.concat_ws("\t", k, F.when(k % 4 == 0, "NA").otherwise(s.cast("string")), s + 1))
    p = readers.unpaired_profile(spark, text_file(spark, rows, folder(spark)), 2)
    return p.select("pos", F.array_join(F.transform("values", lambda v: F.coalesce(v.cast("int").cast("string"), F.lit("NA"))), ",").alias("values"), F.size(F.filter("valid", lambda v: v)).alias("n_valid"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, NULL FROM region")
def io_union_files(spark, sf_dir):
    """Files of different widths, missing columns null."""
    at = folder(spark)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    sinks.write_many({"a": n, "b": table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))}, at, "tsv")
    return readers.union_files(spark, [f"{at}/a", f"{at}/b"]).drop("file")


@query("SELECT CAST(event_id AS VARCHAR) AS step, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS loss FROM events WHERE event_id % 3 <> 0")
def io_log_fields(spark, sf_dir):
    """Fields of log lines by patterns."""
    k = F.col("event_id")
    lines = table(spark, sf_dir, "events").select(F.when(k % 3 == 0, "nothing here").otherwise(F.concat(F.lit("step="), k, F.when(k % 2 == 0, F.concat(F.lit(" loss: "), "user_id")).otherwise(F.lit("")))))
    return readers.log_fields(spark, text_file(spark, lines, folder(spark)), {"step": r"step=(\d+)", "loss": r"loss: (\d+)"})


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS value FROM nation")
def io_first_scalar(spark, sf_dir):
    """The first number in each of a folder of whole files."""
    at = folder(spark)
    for n in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # a file each: 25 rows
        put(spark, f"{at}/{n.n_name}.txt", f"dG of it\ndG = {n.n_nationkey} kcal\ndG = 99\n" if n.n_nationkey % 2 == 0 else "none\n")
    return readers.first_scalar(spark, at, r"dG = (\d+)").select(F.regexp_replace("file", r"\.txt$", "").alias("name"), "value")


@query("SELECT 'g' || n_nationkey AS stem, CAST(n_nationkey AS VARCHAR) AS content FROM nation")
def io_catalog(spark, sf_dir):
    """Files below a root by their stems; those in an archive folder give way to others."""
    at = folder(spark)
    for n in table(spark, sf_dir, "nation").select("n_nationkey").collect():  # two files each: 25 rows
        put(spark, f"{at}/archive/g{n.n_nationkey}.fna", "old")
        put(spark, f"{at}/genomes/g{n.n_nationkey}.fna", str(n.n_nationkey))
    found = readers.catalog_of(spark, at)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).select("path", F.col("content").cast("string").alias("content"))
    return found.join(content, "path").select("stem", "content")


@query("SELECT c_custkey AS bag_id, CASE WHEN c_custkey % 2 = 0 THEN 'fwd' ELSE 'rc' END AS orient, CAST(9 + c_custkey % 3 AS INTEGER) AS L, c_nationkey AS m FROM customer WHERE c_custkey % 3 = 2")
def io_match_table(spark, sf_dir):
    """A table partitioned by orientation and length; the filter prunes its folders."""
    at, k = folder(spark), F.col("c_custkey")
    sinks.write_match_table(table(spark, sf_dir, "customer").select(k.alias("bag_id"), F.when(k % 2 == 0, "fwd").otherwise("rc").alias("orient"), (9 + k % 3).cast("int").alias("L"), F.col("c_nationkey").alias("m")), at)
    return spark.read.parquet(at).where("L = 11").select("bag_id", "orient", "L", "m")


@query("SELECT c_custkey, c_name, c_custkey <= 60 AS first_run FROM customer")
def io_append_missing(spark, sf_dir):
    """A run that broke off and is run again: no row is written twice."""
    at = folder(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    sinks.append_missing(rows.where("c_custkey <= 60").withColumn("first_run", F.lit(True)), at, ["c_custkey"])
    sinks.append_missing(rows.withColumn("first_run", F.lit(False)), at, ["c_custkey"])
    return spark.read.parquet(at)


@query("SELECT true AS complete, count(*) AS n FROM orders")
def io_manifest(spark, sf_dir):
    at = folder(spark)
    sinks.write_manifest(spark, at, False, orders=0)
    sinks.write_manifest(spark, at, True, orders=table(spark, sf_dir, "orders").count())
    return spark.read.json(at).select("complete", F.get_json_object("facts", "$.orders").cast("long").alias("n"))


@query("SELECT c_custkey, c_name, sha256(c_name) AS digest, c_custkey % 7 AS locus FROM customer")
def io_sidecar(spark, sf_dir):
    """Records with evidence that was checked against a digest of their content."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    side = c.select("c_custkey", F.sha2("c_name", 256).alias("digest"), (F.col("c_custkey") % 7).alias("locus"))
    return validate.attach_verified(c, side, ["c_custkey"], F.col("c_name"), "digest")


@query("SELECT r_regionkey, r_name, 'a' AS file FROM region UNION ALL SELECT r_regionkey + 10, r_name, 'b' FROM region")
def io_required(spark, sf_dir):
    """Shards of one schema, refused otherwise, side by side."""
    a = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    b = a.withColumn("r_regionkey", (F.col("r_regionkey") + 10).cast(dict(a.dtypes)["r_regionkey"]))
    readers.required(a.schema, b)
    return validate.allow_columns(a, ["r_regionkey", "r_name"]).withColumn("file", F.lit("a")).unionByName(validate.allow_columns(b, ["r_regionkey", "r_name"]).withColumn("file", F.lit("b")))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stream_new_files(spark, sf_dir):
    """Events arrive in two batches of files; each call of the stream takes what is new."""
    at, e = folder(spark), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for part in range(2):
        e.where(F.col("event_id") % 2 == part).write.mode("append").json(f"{at}/in")
        increments.emit_new_files(spark, f"{at}/in", "event_id long, user_id long, event_type string", f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def streamed_events(spark, sf_dir, transform):
    """Events through a stream, in four calls: all of them; some of the first days once more, which are then too late and
    must not count; and twice an event far ahead, after which all windows of before are final."""
    at = folder(spark)
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    last = e.agg(F.max("ts").alias("last")).first()["last"]
    ahead = [spark.createDataFrame([(-1, "end", 0.0)], "user_id long, event_type string, value double").select((F.lit(last) + F.expr(f"interval {y} years")).alias("ts"), "user_id", "event_type", "value") for y in (1, 2)]
    for k, rows in enumerate((e, e.where(F.col("ts") < F.lit(last) - F.expr("interval 5 days")), *ahead)):
        rows.write.parquet(f"{at}/in/{k}")
        increments.run_once(spark, f"{at}/in/*", "ts timestamp, user_id long, event_type string, value double", f"{at}/out", f"{at}/state", transform)
    return spark.read.parquet(f"{at}/out").where(F.col("start") <= F.lit(last))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Event-time windows of a day over a stream with a watermark and late rows."""
    w = streamed_events(spark, sf_dir, lambda e: increments.windowed_counts(e, "ts", ["event_type"], "1 day"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
    WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, g""")
def stream_sessions(spark, sf_dir):
    """Sessions of users over the same stream."""
    w = streamed_events(spark, sf_dir, lambda e: increments.sessions(e, "ts", ["user_id"], "12 hours"))
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""
    WITH a AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'no name' ELSE 'p' || (p_size % 5) || '/d' || (p_partkey % 7) || '|L' || CAST(floor(p_partkey / 35) AS BIGINT) END AS locus, c_custkey FROM customer JOIN part ON p_partkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND p_size % 5 < 2),
    x AS (SELECT 'p' || (p_size % 5) || '/d' || (p_partkey % 7) || '|L' || CAST(floor(p_partkey / 35) AS BIGINT) AS locus, 'a' || p_partkey AS allele, upper(p_name) AS s FROM part WHERE p_partkey % 11 > 0),
    l AS (SELECT locus, arg_min(allele, (-length(s), allele)) AS longest, arg_min(allele, (length(s), allele)) AS shortest, max(length(s)) > min(length(s)) AS differ FROM x GROUP BY 1)
    SELECT c_custkey, a.locus AS locus_id_full, CASE WHEN a.locus = 'no name' THEN 'malformed' WHEN differ IS NULL THEN 'missing' WHEN differ THEN 'resolved' ELSE 'single' END AS status, longest, shortest FROM a LEFT JOIN l ON l.locus = a.locus""")
def io_provenance(spark, sf_dir):
    """Parts as alleles of loci in folders of panels and directories, customers as the audit that asks for some."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    place = {"panel": F.concat(F.lit("p"), (F.col("p_size") % 5).cast("string")), "dir": F.concat(F.lit("d"), (k % 7).cast("string")), "locus_id": F.concat(F.lit("L"), F.floor(k / 35).cast("string"))}
    at = folder(spark)
    alleles = part.where(k % 11 > 0).withColumns(place).select(*place, F.concat(F.lit("a"), k).alias("allele"), F.col("p_name").alias("sequence"))
    alleles.repartition("panel", "dir").write.partitionBy("panel", "dir").parquet(at)
    asked = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").join(part.where("p_size % 5 < 2").withColumns(place), F.col("c_custkey") == k)
    name = F.when(F.col("c_custkey") % 10 == 0, "no name").otherwise(F.concat("panel", F.lit("/"), "dir", F.lit("|"), "locus_id"))
    found = joins.audited_alleles(asked.select("c_custkey", name.alias("locus_id_full")), spark.read.schema("locus_id string, allele string, sequence string, panel string, dir string").parquet(at), keep=["c_custkey"])
    return found.select("c_custkey", "locus_id_full", "status", F.col("longest.allele").alias("longest"), F.col("shortest.allele").alias("shortest"))


def bucketed_pair(spark, sf_dir):
    """Lines and orders as two tables in buckets of one key, each with the digest of what it was made from."""
    at, name = folder(spark), f"t{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bag"), "l_linenumber", F.col("l_quantity").cast("int").alias("m"))
    bags = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bag"), F.col("o_orderpriority").alias("family"))
    facts = {"registry": sinks.digest_of(bags.select("family").distinct()), "dataset": sinks.digest_of(bags)}
    for df, part in ((lines, "hits"), (bags, "bags")):
        sinks.write_bucketed(df, f"{name}_{part}", f"{at}/{part}", "bag", 8, facts)
    return [readers.bucketed(spark, f"{name}_{part}", facts) for part in ("hits", "bags")]


@query("""SELECT o_orderkey AS bag, o_orderpriority AS family, count(*) AS n, max(CAST(l_quantity AS INTEGER)) AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def io_bucketed(spark, sf_dir):
    """The best of each bag's hits, with its family: the join and the grouping move no row."""
    hits, bags = bucketed_pair(spark, sf_dir)
    return hits.join(bags.hint("merge"), "bag").groupBy("bag", "family").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"))


@query("""
    WITH a AS (SELECT p_partkey AS k, upper(translate(md5('a' || p_partkey), '0123456789abcdef', 'acgtacgtacgtacgt')) AS s FROM part)
    SELECT 'r' || k AS id, substr(CASE WHEN k % 5 = 0 THEN replace(s, 'AC', 'NC') ELSE s END, 1, 20) AS flank, substr(reverse(s), 1, 30) AS insert FROM a WHERE k % 3 > 0 AND NOT (k % 5 = 0 AND contains(substr(replace(s, 'AC', 'NC'), 1, 20), 'N'))""")
def io_paired_fasta(spark, sf_dir):
    """Records that two FASTA files share, of plain letters only."""
    at, k = folder(spark), F.col("p_partkey")
    s = F.translate(F.md5(F.concat(F.lit("a"), k.cast("string"))), "0123456789abcdef", "acgtacgtacgtacgt")
    p = table(spark, sf_dir, "part").select(k.alias("k"), F.upper(s).alias("s"))
    record = lambda seq: F.concat(F.lit(">r"), F.col("k").cast("string"), F.lit(" x\n"), seq)
    empty = text_file(spark, p.where("k % 3 > 0").select(record(F.when(F.col("k") % 5 == 0, F.replace("s", F.lit("AC"), F.lit("NC"))).otherwise(F.col("s")))), f"{at}/empty")
    filled = text_file(spark, p.select(record(F.lower(F.reverse("s")))), f"{at}/filled")
    return readers.paired_fasta(spark, filled, empty, 20, 30).select("id", "flank", "insert")


@query(f"""WITH {PAIRS} SELECT 'r' || k AS id, substr(b, 1, 30) AS flank, substr(a, 1, 25) AS insert FROM s WHERE k % 3 <> 1 AND NOT contains(substr(a, 1, 25), 'N') AND NOT contains(substr(b, 1, 30), 'N')""")
def io_paired_fasta(spark, sf_dir):
    """Records that a file of inserts and one of empty sites share, of plain letters only."""
    p, at = pairs(spark, sf_dir), folder(spark)
    record = lambda c: F.concat(F.lit(">r"), F.col("k").cast("string"), F.lit(" x\n"), seq.wrap_fasta(c))
    filled, empty = text_file(spark, p.select(record("a")), f"{at}/filled"), text_file(spark, p.where("k % 3 <> 1").select(record("b")), f"{at}/empty")
    return readers.paired_fasta(spark, filled, empty, 30, 25)


@query("""
    WITH p AS (SELECT *, translate(upper(p_name), 'RYSWKMBDHVN', 'ACGAGACAAAA') AS n, translate(upper(p_type), 'RYSWKMBDHVN', 'ACGAGACAAAA') AS t, count(*) OVER (PARTITION BY p_brand) AS sites FROM part),
    r AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN ['AAAAA'] WHEN 1 THEN [substr(n, 1, 20)] ELSE CASE WHEN length(n) >= 8 OR length(t) >= 8 THEN [substr(n, 1, 20), substr(t, 1, 20)] ELSE [substr(n, 1, 20)] END END AS kept FROM p)
    SELECT p_partkey AS site_id, p_brand AS bag, n AS flank, array_to_string(kept, ',') AS regions, CAST(len(kept) AS INTEGER) AS n_regions, CAST(list_sum(list_transform(kept, lambda x: length(x))) AS INTEGER) AS letters, sites AS n_sites, p_size % 2 = 1 AS is_reversed FROM r""")
def io_site_records(spark, sf_dir):
    """Parts as flat rows without labels, nested for a reader of sites."""
    k = F.col("p_partkey") % 4
    regions = F.when(k == 1, F.array("p_name")).when(k == 2, F.array("p_name", "p_type", "p_brand")).when(k == 3, F.array(F.lit(None).cast("string"), "p_name", "p_type"))
    flat = table(spark, sf_dir, "part").withColumns({"regions": regions, "orient": F.when(F.col("p_size") % 2 == 1, "rc")})
    found = readers.site_records(flat, "p_brand", "p_partkey", "p_name", "regions", "orient", most=20, n_regions=2, least=8, filler=5)
    return found.select("site_id", F.col("transposase_id").alias("bag"), "inputs.flank", F.array_join("inputs.noncoding_regions", ",").alias("regions"), F.col("labels.num_noncoding_regions").alias("n_regions"), F.col("labels.ncrna_length").alias("letters"), "labels.arch.n_sites", "labels.arch.is_reversed")
