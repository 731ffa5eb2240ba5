"""Queries of the scalar sequence and array functions, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import arrays, seq
from siftline.registry import query, table

#: the letters A, C, G and T of a text, as a stand-in for a sequence
DNA = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"


def dna(spark, sf_dir, name="documents", key="doc_id"):
    return table(spark, sf_dir, name).select(key, F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s"))


@query(f"""
    WITH d AS (SELECT doc_id, {DNA} AS s FROM documents),
    c AS (SELECT doc_id, length(s) AS n, length(s) - length(replace(s, 'A', '')) AS a, length(s) - length(replace(s, 'C', '')) AS c,
                 length(s) - length(replace(s, 'G', '')) AS g, length(s) - length(replace(s, 'T', '')) AS t FROM d),
    e AS (SELECT doc_id, n, a, c, g, t, list_sum(list_transform([a, c, g, t], lambda x: CASE WHEN x > 0 THEN -x / n * log2(x / n) ELSE 0 END)) AS h FROM c)
    SELECT doc_id, CAST(n AS INTEGER) AS n, CASE WHEN n = 0 THEN 0 ELSE round(100.0 * (g + c) / n, 6) END AS gc, CASE WHEN n = 0 THEN 0 ELSE round((a + t) / n, 6) END AS at_fraction, round(coalesce(h, 0), 6) AS entropy FROM e""")
def seq_composition(spark, sf_dir):
    s = dna(spark, sf_dir)
    return s.select("doc_id", F.length("s").alias("n"), F.round(seq.gc_percent("s"), 6).alias("gc"), F.round(seq.at_fraction("s"), 6).alias("at_fraction"), F.round(seq.base_entropy("s"), 6).alias("entropy"))


@query("""
    WITH d AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM documents WHERE text <> ''),
    i AS (SELECT doc_id, c, p - row_number() OVER (PARTITION BY doc_id, c ORDER BY p) AS g FROM d),
    r AS (SELECT doc_id, count(*) AS n FROM i GROUP BY doc_id, c, g)
    SELECT doc_id, CAST(max(n) AS INTEGER) AS longest_run FROM r GROUP BY doc_id""")
def seq_longest_run(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", seq.longest_run("text").alias("longest_run"))


@query(f"""
    WITH d AS (SELECT doc_id, {DNA} AS s FROM documents),
    x AS (SELECT doc_id, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS p FROM d WHERE length(s) > 0),
    l AS (SELECT doc_id, c, p, lag(c, 2) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM x)
    SELECT doc_id, round(coalesce(sum(CASE WHEN c = b THEN 1 ELSE 0 END) / nullif(count(b), 0), 0), 6) AS period2 FROM l GROUP BY doc_id""")
def seq_periodicity(spark, sf_dir):
    return dna(spark, sf_dir).where("length(s) > 0").select("doc_id", F.round(seq.periodicity("s", 2), 6).alias("period2"))


@query(f"""
    WITH d AS (SELECT {DNA} AS s FROM documents), w AS (SELECT substr(s, CAST(p AS BIGINT), 4) AS kmer FROM d, unnest(range(1, CAST(length(s) - 2 AS BIGINT))) AS t(p))
    SELECT kmer, count(*) AS n FROM w GROUP BY kmer""")
def seq_kmer_counts(spark, sf_dir):
    return dna(spark, sf_dir).select(F.explode(seq.kmers("s", 4)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, md5(reverse(translate({DNA}, 'ACGT', 'TGCA'))) AS rc, md5(least({DNA}, reverse(translate({DNA}, 'ACGT', 'TGCA')))) AS strand FROM documents")
def seq_reverse_complement(spark, sf_dir):
    return dna(spark, sf_dir).select("doc_id", F.md5(seq.revcomp("s")).alias("rc"), F.md5(seq.canonical_strand("s")).alias("strand"))


@query("""
    WITH u AS (SELECT doc_id, CAST(('0x' || substr(md5('v1::' || doc_id), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM documents)
    SELECT doc_id, round(u, 9) AS u, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM u""")
def seq_hash_split(spark, sf_dir):
    u = seq.hash_uniform("doc_id", salt="v1")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(u, 9).alias("u"), F.when(u < 0.8, "train").when(u < 0.9, "val").otherwise("test").alias("split"))


@query("""
    WITH x AS (SELECT p_partkey, p_name, p_type, unnest(range(1, CAST(least(length(p_name), length(p_type)) + 1 AS BIGINT))) AS i FROM part)
    SELECT p_partkey, round(avg(CASE WHEN substr(p_name, i, 1) = substr(p_type, i, 1) THEN 1.0 ELSE 0.0 END), 6) AS identity FROM x GROUP BY p_partkey""")
def seq_trimmed_identity(spark, sf_dir):
    return table(spark, sf_dir, "part").where("length(p_name) > 0 and length(p_type) > 0").select("p_partkey", F.round(seq.trimmed_identity("p_name", "p_type"), 6).alias("identity"))


@query("""
    WITH f AS (SELECT doc_id, list_filter(range(0, CAST(length(text) - 2 AS BIGINT)), lambda i: substr(text, CAST(i + 1 AS BIGINT), 3) = 'ent') AS hits FROM documents)
    SELECT doc_id, CAST(len(hits) AS INTEGER) AS n, CAST(hits[1] AS INTEGER) AS first, CAST(hits[-1] AS INTEGER) AS last FROM f""")
def seq_find_all(spark, sf_dir):
    # a long text makes one substring call a position: the overlapping hits come from k-mers instead
    at = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(seq.kmers("text", 3)).alias("p", "w"))
    hit = F.when(F.col("w") == "ent", F.col("p"))
    return at.groupBy("doc_id").agg(F.count(hit).cast("int").alias("n"), F.min(hit).alias("first"), F.max(hit).alias("last"))


@query("SELECT n_nationkey, sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') AS content_key FROM nation")
def seq_content_key(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", seq.content_key("n_nationkey", "n_name", "n_regionkey").alias("content_key"))


@query("""
    SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def array_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(seq.cosine("embedding", "other"), 6).alias("cosine"))


@query("""
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, list_max(CAST(embedding AS DOUBLE[])) AS m FROM embeddings)
    SELECT vec_id, round(m + ln(list_sum(list_transform(x, lambda v: exp(v - m)))), 6) AS log_sum_exp, round(exp(m) / list_sum(list_transform(x, lambda v: exp(v))), 6) AS largest FROM e""")
def array_softmax(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x")).select("vec_id", F.round(arrays.log_sum_exp("x"), 6).alias("log_sum_exp"), F.round(F.exp(F.array_max("x") - arrays.log_sum_exp("x")), 6).alias("largest"))


@query("""
    SELECT vec_id, round(list_avg(list_filter(CAST(embedding[9:24] AS DOUBLE[]), lambda v: v IS NOT NULL)), 6) AS mean, CAST(1.0 AS DOUBLE) AS valid FROM embeddings""")
def array_mean_valid(spark, sf_dir):
    m = arrays.mean_valid("embedding", 8, 16)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(m["mean"], 6).alias("mean"), m["valid"].alias("valid"))


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM c GROUP BY user_id""")
def map_counter(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return counts.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN value < 50 THEN 'low' WHEN value <= 100 THEN 'mid' ELSE 'high' END AS band FROM events""")
def json_and_bands(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(F.col("value") < 50, "low").when(F.col("value").between(50, 100), "mid").otherwise("high").alias("band"))


@query("""
    SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DECIMAL(18, 0)) / 100 AS total FROM events GROUP BY 1, 2""")
def dates_and_decimals(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("value") * 100).cast("long")) / 100).alias("total"))
