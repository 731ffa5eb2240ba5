import json

import pytest
from pyspark.sql import functions as F

from siftline.operators import joins
from siftline.sources import readers, sinks
from siftline.streaming import increments


def test_sites(spark, tmp_path):
    lines = [{"site_id": f"s{i}", "transposase_id": "b1" if i < 2 else "b2", "inputs": {"flank": "ACGT" if i else "", "noncoding_regions": ["AC", "GT"]}, "generator_metadata": {"k": "v"}} for i in range(4)]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = readers.sites(spark, str(tmp_path / "x.jsonl"), ["b1"]).orderBy("site_ord").collect()
    assert [(r.site_id, r.site_ord, r.flank) for r in got] == [("s0", 0, None), ("s1", 1, "ACGT")]


def test_fasta_and_tables(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x y\nacg\nTT\n>two\nGGNG\n")
    (tmp_path / "b.fa").write_text(">one\nTTTT\n>two\nCCCC\n")
    assert sorted(tuple(r) for r in readers.fasta(spark, str(tmp_path / "a.fa")).select("id", "seq").collect()) == [("one", "ACGTT"), ("two", "GGNG")]
    assert [r.id for r in readers.paired_fasta(spark, str(tmp_path / "a.fa"), str(tmp_path / "b.fa")).collect()] == ["one"]
    (tmp_path / "d.txt").write_text("# c\nT1 - 5 q1 - 9 1e-9 3 4 5 6 7 1e-8 20.5 1\nT2 - 5 q1 - 9 1e-9 3 4 5 6 7 0.5 1.5 1\n")
    hits = readers.domain_table(spark, str(tmp_path / "d.txt"), 1e-3).collect()
    assert len(hits) == 1 and hits[0].hits[0]["target"] == "T1"
    (tmp_path / "u.txt").write_text("#x\n1 0.5 NA\n2 0.25 0.75\n")
    r = readers.unpaired_profile(spark, str(tmp_path / "u.txt"), 2).orderBy("pos").first()
    assert r["values"] == [0.5, None] and r["valid"] == [True, False]
    (tmp_path / "g.gff").write_text("#h\nc1\tx\tCDS\t5\t9\t.\t+\t0\tid=1\nc1\tx\tgene\t1\t9\t.\t+\t0\tid=2\n")
    assert [(r.lo, r.hi, r.ordinal) for r in readers.gff_cds(spark, str(tmp_path / "g.gff")).collect()] == [(4, 9, 1)]
    (tmp_path / "log").write_text("a score=7 x\nnothing\n")
    assert [r.score for r in readers.log_fields(spark, str(tmp_path / "log"), {"score": r"score=(\d+)"}).collect()] == ["7"]


def test_sinks(spark, tmp_path):
    df = spark.range(4).withColumn("split", F.when(F.col("id") < 2, "a").otherwise("b"))
    path = str(tmp_path / "t")
    sinks.append_missing(df.where("id < 3"), path, ["id"])
    sinks.append_missing(df, path, ["id"])
    assert spark.read.parquet(path).count() == 4
    sinks.route_json(df, "split", str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("split = 'a'").count() == 2
    sinks.write_manifest(spark, str(tmp_path / "m"), True, n=3)
    assert spark.read.json(str(tmp_path / "m")).first()["complete"]
    s = spark.createDataFrame([("x", "ACGTACGT", 2, 4)], "name string, seq string, lo int, hi int")
    assert sinks.fasta_slices(s, "seq", "name", "lo", "hi", 10).first()["value"] == ">x\nACGTACGT"


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"x": i}))
        increments.emit_new_files(spark, str(tmp_path / "in"), "x int", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]


def test_windowed_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:{m:02d}:00Z", "k": "a", "value": 1.0}) for m in (1, 4, 12)))
    s = increments.windowed_counts(spark.readStream.schema("ts timestamp, k string, value double").json(str(tmp_path / "in")), "ts", ["k"], "10 minutes")
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]


def test_only_audited_folders_are_read(spark, tmp_path):
    """The plan prunes by what the audit names when it runs, and the files of other folders are not opened."""
    rows = [(f"p{k % 4}", f"d{k % 5}", f"L{k}", f"a{k}.{n}", "acgt" * (n + 1)) for k in range(40) for n in range(2)]
    spark.createDataFrame(rows, "panel string, dir string, locus_id string, allele string, sequence string").repartition("panel", "dir").write.partitionBy("panel", "dir").parquet(str(tmp_path / "a"))
    alleles = spark.read.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(1, "p1/d1|L21"), (2, "p1/d1|L1"), (3, "p2/d2|L99"), (4, "nonsense"), (5, None)], "k int, locus_id_full string").write.parquet(str(tmp_path / "b"))
    audit = spark.read.parquet(str(tmp_path / "b"))
    df = joins.audited_alleles(audit, alleles, keep=["k"])
    got = {r.k: (r.status, r.longest and r.longest.allele, r.shortest and r.shortest.sequence) for r in df.collect()}
    assert got == {1: ("resolved", "a21.1", "ACGT"), 2: ("resolved", "a1.1", "ACGT"), 3: ("missing", None, None), 4: ("malformed", None, None), 5: ("missing", None, None)}
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()
    assert len({f.rsplit("/", 1)[0] for f in alleles.inputFiles()}) == 20
    scans = []

    def walk(node):
        if node.nodeName().startswith("Scan parquet") and "sequence" in node.simpleString(200):
            scans.append(node.metrics().apply("numPartitions").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif name.endswith("QueryStage"):
            walk(node.plan())

    walk(df._jdf.queryExecution().executedPlan())
    assert scans == [4]  # of 20 folders: each key prunes for itself


def test_bucketed_tables_meet_without_an_exchange(spark, tmp_path):
    hits = spark.createDataFrame([(k % 50, k) for k in range(500)], "bag int, m int")
    bags = spark.createDataFrame([(k, f"f{k % 3}") for k in range(50)], "bag int, family string")
    facts = {"registry": sinks.digest_of(bags.select("family").distinct()), "dataset": sinks.digest_of(bags)}
    for df, name in ((hits, "hits_b"), (bags, "bags_b")):
        sinks.write_bucketed(df, name, str(tmp_path / name), "bag", 4, facts)
    a, b = (readers.bucketed(spark, n, facts) for n in ("hits_b", "bags_b"))
    joined = a.join(b.hint("merge"), "bag").groupBy("bag", "family").agg(F.max("m").alias("m"))
    assert {(r.bag, r.m) for r in joined.collect()} == {(k, 450 + k) for k in range(50)}
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sinks.digest_of(bags) == sinks.digest_of(bags.repartition(7)) != sinks.digest_of(bags.withColumn("family", F.lit("f0")))
    changed = facts | {"registry": sinks.digest_of(bags.select("family").distinct().limit(2))}
    with pytest.raises(ValueError, match="registry"):
        readers.bucketed(spark, "hits_b", changed)
    spark.sql("DROP TABLE hits_b_facts")
    with pytest.raises(ValueError, match="not complete"):
        readers.bucketed(spark, "hits_b", facts)
    spark.sql("DROP TABLE hits_b")
    spark.sql("DROP TABLE bags_b")
    spark.sql("DROP TABLE bags_b_facts")


def test_site_records(spark):
    from siftline.sources import readers

    rows = [("b", 1, "acgn", ["a" * 30, "RYSW" * 10, "C" * 30], "rc"), ("b", 1, "acgn", ["a" * 30, "RYSW" * 10, "C" * 30], "rc"), ("b", 2, None, ["AC", "GT"], None), ("c", 3, "", [], None), (None, 4, "T", None, "fwd"), ("c", 5, "T", [None, "ac"], "fwd")]
    flat = spark.createDataFrame(rows, "bag string, site int, flank string, regions array<string>, orient string")
    got = readers.site_records(flat, "bag", "site", "flank", "regions", "orient", most=25, filler=7)
    found = {r.site_id: r for r in got.collect()}
    assert got.count() == 6 and got.limit(0).count() == 0
    assert found[1].inputs.flank == "ACGA" and found[1].inputs.noncoding_regions == ["A" * 25, ("ACGA" * 10)[:25]]
    assert found[1].labels.arch.is_reversed and found[1].labels.arch.n_sites == 3 and found[1].labels.ncrna_length == 50
    assert found[2].inputs.flank is None and found[2].inputs.noncoding_regions == ["AC"] and found[2].labels.arch.orient == "fwd"
    assert found[3].inputs.noncoding_regions == ["A" * 7] and found[3].inputs.flank == ""
    assert found[4].transposase_id is None and found[4].labels.arch.n_sites == 1 and found[4].inputs.noncoding_regions == ["A" * 7]
    assert found[5].inputs.noncoding_regions == ["AC"]
