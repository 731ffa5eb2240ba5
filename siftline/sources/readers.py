"""Readers: explicit schemas, bad rows fail, missing values become null at the door."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from siftline.functions import seq

LABELS = "is_positive boolean, is_planted boolean, active_noncoding_index int, match_orientation string, guide_length int, n_mismatches int, planted_start int, guide_dna string, target_dna string, violation_profile string, site_class string, negative_mode string"
SITE = f"site_id string, transposase_id string, ncrna_id string, inputs struct<flank:string,noncoding_regions:array<string>>, labels struct<{', '.join(x.replace(' ', ':', 1) for x in LABELS.split(', '))}>, generator_metadata map<string,string>"


def sites(spark: SparkSession, path: str, bags: list[str] | None = None) -> DataFrame:
    """JSON lines to sites(bag_id, site_id, site_ord, flank, nc_regions, labels, meta). site_ord is the
    place in (file, block, line) order and must be kept with the data from here on."""
    raw = spark.read.schema(SITE).option("mode", "FAILFAST").json(path)
    if bags is not None:
        raw = raw.where(F.col("transposase_id").isin(bags))
    rows = raw.withColumn("__at", F.monotonically_increasing_id()).withColumn("site_ord", F.row_number().over(Window.partitionBy("transposase_id").orderBy("__at")) - 1)
    return rows.select(F.col("transposase_id").alias("bag_id"), "site_id", "site_ord", F.nullif("inputs.flank", F.lit("")).alias("flank"), F.col("inputs.noncoding_regions").alias("nc_regions"), "labels", F.col("generator_metadata").alias("meta"))


def fasta(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """id (up to the first blank), header, seq (upper case, one string), in any order; ``wanted`` has ids."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.element_at(F.split("value", "\r?\n", 2), 1)
    rows = raw.select(F.element_at(F.split(head, r"\s"), 1).alias("id"), head.alias("header"), F.upper(F.regexp_replace(F.coalesce(F.get(F.split("value", "\r?\n", 2), F.lit(1)), F.lit("")), r"\s", "")).alias("seq"))
    return rows if wanted is None else rows.join(wanted.select("id").distinct(), "id", "left_semi")


def paired_fasta(spark: SparkSession, filled: str, empty: str, flank: int = 120, insert: int = 250) -> DataFrame:
    """id, flank, insert of records that both files have, of plain letters only."""
    a, b = fasta(spark, filled).select("id", F.substring("seq", 1, insert).alias("insert")), fasta(spark, empty).select("id", F.substring("seq", 1, flank).alias("flank"))
    return a.join(b, "id").where(F.col("insert").rlike("^[ACGT]+$") & F.col("flank").rlike("^[ACGT]+$"))


def tsv(spark: SparkSession, path: str, schema: str | None = None, comment: str | None = None, header: bool = True) -> DataFrame:
    """Tab-separated; without a schema all columns are strings."""
    reader = spark.read.option("sep", "\t").option("header", header).option("quote", "")
    if schema:
        reader = reader.schema(schema).option("mode", "FAILFAST")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def gff_cds(spark: SparkSession, path: str) -> DataFrame:
    """contig, lo (zero-based), hi, strand, attributes, ordinal of CDS lines, by place."""
    rows = tsv(spark, path, "contig string, source string, kind string, first int, last int, score string, strand string, phase string, attributes string", "#", header=False).where("kind = 'CDS'")
    return rows.select("contig", (F.col("first") - 1).alias("lo"), F.col("last").alias("hi"), "strand", "attributes", F.row_number().over(Window.partitionBy("contig").orderBy("first", "last", "strand")).alias("ordinal"))


def blast_tab(spark: SparkSession, path: str) -> DataFrame:
    schema = "query string, subject string, identity double, length int, mismatches int, gaps int, q_lo int, q_hi int, s_lo int, s_hi int, e_value double, bits double"
    return tsv(spark, path, schema, header=False)


def white_space_table(spark: SparkSession, path: str, columns: dict[int, tuple[str, str]]) -> DataFrame:
    """Fields of lines that are no comment, split at white space: {index: (name, type)}."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(*[F.get(parts, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in columns.items()])


def domain_table(spark: SparkSession, path: str, most_e: float) -> DataFrame:
    """query, hits array<struct(e_value, target, score)> with e_value <= most_e, best first."""
    rows = white_space_table(spark, path, {0: ("target", "string"), 3: ("query", "string"), 12: ("e_value", "double"), 13: ("score", "double")})
    return rows.where(F.col("e_value") <= most_e).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("e_value", "target", "score"))).alias("hits"))


def covariance_table(spark: SparkSession, path: str) -> DataFrame:
    return white_space_table(spark, path, {0: ("target", "string"), 2: ("model", "string"), 7: ("seq_from", "int"), 8: ("seq_to", "int"), 9: ("strand", "string"), 14: ("score", "double"), 15: ("e_value", "double")})


def unpaired_profile(spark: SparkSession, path: str, u_max: int) -> DataFrame:
    """pos, values array<float>, valid array<boolean>: NA is null and not valid."""
    parts = F.split(F.trim("value"), r"\s+")
    values = F.transform(F.slice(parts, 2, u_max), lambda x: x.try_cast("float"))
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.get(parts, F.lit(0)).cast("int").alias("pos"), values.alias("values"), F.transform(values, lambda x: x.isNotNull()).alias("valid"))


def union_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Tab-separated files of different widths, missing columns null, with the file's name."""
    out = None
    for path in paths:
        part = tsv(spark, path).withColumn("file", F.col("_metadata.file_name"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def catalog_of(spark: SparkSession, root: str, suffix: str = "*.fna") -> DataFrame:
    """stem, path of files below root; of equal stems one outside an archive folder, then the first path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(root).select("path")
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "path", F.lower("path").contains("/archive").alias("old"))
    return rows.groupBy("stem").agg(F.min_by("path", F.struct("old", "path")).alias("path"))


def log_fields(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """A row per line on which some pattern's first group is found; others null."""
    found = {k: F.nullif(F.regexp_extract("value", p, 1), F.lit("")) for k, p in patterns.items()}
    return spark.read.text(path).select(*[v.alias(k) for k, v in found.items()]).where(F.coalesce(*[F.col(k) for k in found]).isNotNull())


def first_scalar(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file, value: the first match in each whole file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).alias("value"))


def required(schema: T.StructType, df: DataFrame) -> DataFrame:
    """df, refused before it runs if a column of ``schema`` is missing or of another type."""
    kinds = dict(df.dtypes)
    wrong = [f.name for f in schema if kinds.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"missing or of another type: {', '.join(wrong)}")
    return df


def bucketed(spark: SparkSession, name: str, facts: dict[str, str]) -> DataFrame:
    """A table that sinks.write_bucketed has written, if it is complete and was made from what ``facts`` says: a
    registry or dataset that has changed since is refused, so a stale table is never joined with a new one."""
    if not spark.catalog.tableExists(f"{name}_facts"):
        raise ValueError(f"{name} is not complete")
    held = {r.fact: r.value for r in spark.table(f"{name}_facts").collect()}
    off = sorted(k for k in facts if held.get(k) != facts[k])
    if off:
        raise ValueError(f"{name} was made from another {', '.join(off)}; write it again")
    return spark.table(name)


def site_records(flat: DataFrame, bag: str, site: str, flank: str, regions: str, orient: str | None = None, most: int = 250, n_regions: int = 2, least: int = 20, filler: int = 120) -> DataFrame:
    """Flat rows as the nested records of :func:`sites`, for data that comes without labels: letters upper case
    and folded to ACGT, the first ``n_regions`` regions cut to ``most`` letters (only the first where all are
    shorter than ``least``; ``filler`` A's where there is none), how many sites the bag has, and labels that
    say that nothing is known. Null regions are left out, a null flank stays null; repeated rows stay."""
    clean = F.transform(F.filter(F.coalesce(F.col(regions), F.array().cast("array<string>")), lambda r: r.isNotNull()), lambda r: F.substring(seq.fold_iupac(r), 1, most))
    first = F.slice(clean, 1, n_regions)
    kept = F.when(F.size(clean) == 0, F.array(F.lit("A" * filler))).when(F.exists(first, lambda r: F.length(r) >= least), first).otherwise(F.slice(clean, 1, 1))
    sizes = flat.groupBy(F.col(bag).alias("__bag")).agg(F.count(F.lit(1)).alias("__sites"))
    rows = flat.join(sizes, F.col(bag).eqNullSafe(F.col("__bag"))).withColumns({"__kept": kept, "__orient": F.coalesce(F.col(orient), F.lit("fwd")) if orient else F.lit("fwd")})
    length = F.aggregate("__kept", F.lit(0), lambda n, r: n + F.length(r))
    arch = F.struct(F.col("__sites").alias("n_sites"), F.col("__orient").alias("orient"), (F.col("__orient") == "rc").alias("is_reversed"))
    labels = F.struct(F.lit(0).alias("is_positive"), F.lit(False).alias("is_planted"), F.lit("discovery").alias("negative_mode"), F.size("__kept").alias("num_noncoding_regions"), length.alias("ncrna_length"), arch.alias("arch"))
    return rows.select(F.col(site).alias("site_id"), F.col(bag).alias("transposase_id"), F.struct(seq.fold_iupac(flank).alias("flank"), F.col("__kept").alias("noncoding_regions")).alias("inputs"), labels.alias("labels"))
