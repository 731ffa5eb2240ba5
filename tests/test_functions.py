from pyspark.sql import functions as F

from siftline.functions import arrays, seq


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def test_motif_values(spark):
    for s, want in (("AAAAAAA", 7), ("ATATAT", 1), ("ACGTACGT", 1), ("AATTAACG", 2), ("", 0)):
        assert one(spark, seq.longest_run("s"), s=s) == want
    for s, p, want in (("ATATATATATA", 2, 1.0), ("ACGTACGTACGT", 4, 1.0), ("A" * 11, 1, 1.0)):
        assert one(spark, seq.periodicity("s", p), s=s) == want
    assert one(spark, seq.periodicity("s", 1), s="ACGTACGTACGT") < 0.1
    assert one(spark, seq.at_fraction("s"), s="AATTAACGTTAA") == 10 / 12
    for s, want in (("AAAAAA", 0.0), ("ACGT", 2.0), ("AT", 1.0)):
        assert abs(one(spark, seq.base_entropy("s"), s=s) - want) < 1e-12


def test_strings(spark):
    assert one(spark, seq.revcomp("s"), s="ACGTNa") == "tNACGT"
    assert one(spark, seq.encode("s"), s="acGTN") == [0, 1, 2, 3, 4]
    assert one(spark, seq.fusion("a", "b"), a="ACN", b="CAA") == [-1, 1, 0]
    assert one(spark, seq.hamming("a", "b"), a="ACGT", b="ACCA") == 2
    assert one(spark, seq.hamming("a", "b"), a="ACGT", b="ACC") is None
    assert one(spark, seq.find_all("a", "b"), a="AAAA", b="AA") == [0, 1, 2]
    assert one(spark, seq.fold_iupac("s"), s="RYSWKMBDHVNACGT") == "ACGAGACAAAAACGT"
    assert one(spark, seq.matches("a", "b"), a="ANG", b="ANT") == 1
    assert one(spark, seq.matches("a", "b", True), a="ANG", b="ANT") == 2
    assert one(spark, seq.fragment_status("a", "b"), a="AACCGT", b="ACC") == "unique"
    assert one(spark, seq.fragment_status("a", "b"), a="AACCGT", b="GGG") == "missing"
    assert one(spark, seq.trimmed_identity("a", "b"), a="", b="ACC") == 0.0
    assert one(spark, seq.offset_identity("a", "b", 5, 4), a="ACGTACGTAA", b="CGTACGTAA")["offset"] == 1
    assert one(spark, seq.wrap_fasta("s", 3), s="ACGTAC") == "ACG\nTAC"
    r = one(spark, seq.region_at(F.array(F.lit("ACGT"), F.lit("GG")), F.lit(18)))
    assert (r["region"], r["offset"], r["in_spacer"]) == (1, 1, False)
    assert one(spark, seq.region_at(F.array(F.lit("ACGT"), F.lit("GG")), F.lit(5)))["in_spacer"]


def test_hits_and_boundaries(spark):
    found = {(h["i"], h["j"]): h["m"] for h in one(spark, seq.window_hits("a", "b", 3, 0), a="ACGTN", b="TACGA")}
    assert found[0, 1] == 3 and found[1, 2] == 2 and found[0, 0] == 0 and found[0, 2] == 0
    b = one(spark, seq.boundaries("a", "b"), a="A" * 150, b="A" * 50)
    assert b["mismatches"] == 0 and len(b["intervals"]) == 51 and (b["intervals"][50]["lo"], b["intervals"][50]["hi"]) == (50, 150)
    t = one(spark, seq.seed_repeat("s", 15, 4, 12), s="GGGGGACGTTTT" + "ACGTTTTCCCCC")
    assert t["word"] == "ACGTTTT" and t["gap"] == 0


def test_arrays(spark):
    assert one(spark, arrays.invert(F.array(F.lit(2), F.lit(0), F.lit(2)), 3)) == [1, None, 0]
    assert one(spark, arrays.project(F.array(F.lit(5), F.lit(6)), F.array(F.lit(1), F.lit(None).cast("int"), F.lit(-1)), F.lit(0))) == [6, 0, 0]
    assert one(spark, arrays.fit_length(F.array(F.lit(1)), 3, F.lit(0))) == [1, 0, 0]
    assert one(spark, arrays.iou(F.lit(0), F.lit(10), F.lit(5), F.lit(15))) == 5 / 15
    assert one(spark, arrays.counter(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == {"a": 1, "b": 2}
    m = one(spark, arrays.mean_valid(F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(float("nan")), F.lit(3.0)), 0, 4))
    assert (m["mean"], m["valid"]) == (2.0, 0.5)
    assert one(spark, arrays.running_sum(F.array(F.lit(1.0), F.lit(2.0)))) == [1.0, 3.0]
    assert one(spark, arrays.floor_percentile(F.array(*map(F.lit, range(10))), 90)) == 9
