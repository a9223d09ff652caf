"""Readers and writers of a study's files. Every reader takes a path, a glob or a list, and is one distributed scan."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCI = "chr string, pos bigint, ref string, alt string"
STATISTICS = "betahat double, sebetahat double, maf double, pip double"
#: Columns of the per-gene fine-mapping files.
PIP_SCHEMAS = {
    "all": f"{LOCI}, {STATISTICS}, gene_id string",
    "top": f"{LOCI}, {STATISTICS}, `cs_coverage_0.95` bigint, `cs_coverage_0.7` bigint, `cs_coverage_0.5` bigint, `cs_coverage_0.95_min_corr` bigint, `cs_coverage_0.7_min_corr` bigint, "
    "`cs_coverage_0.5_min_corr` bigint, gene_id string",
}
PREDICTIONS = "CHROM string, POS bigint, ID string, REF string, ALT string, GENE_ID string, PIP double, PRED_PROBABILITY double"
RENAMED = {"ID": "variant_id", "POS": "pos", "REF": "ref", "ALT": "alt", "PIP": "pip", "GENE_ID": "gene_id", "PRED_PROBABILITY": "pred_prob"}


def _file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def read_pip_csv(spark: SparkSession, paths, kind: str = "all") -> DataFrame:
    """Per-gene files, space between columns, a header line; cell is the name of the folder two levels above the file."""
    d = spark.read.csv(paths, schema=PIP_SCHEMAS[kind], sep=" ", header=True)
    return d.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3).alias("cell"))


def write_by_chr(df: DataFrame, path: str, part_bytes: int = 128 << 20, rows_a_file: int = 2_000_000) -> None:
    """One folder a chromosome, replaced as a whole, in files of about part_bytes (of shuffled data, before compression), however the chromosomes' sizes differ.

    Rows are dealt by chromosome and then rebalanced at run time: a chromosome larger than that is split over tasks, small ones share a
    task. rows_a_file bounds a file's rows besides.
    """
    with part_size(df.sparkSession, part_bytes):
        df.hint("rebalance", "chr").write.partitionBy("chr").mode("overwrite").option("maxRecordsPerFile", rows_a_file).option("compression", "snappy").parquet(path)


@contextmanager
def part_size(spark: SparkSession, part_bytes: int):
    """Within it, rebalanced partitions have about part_bytes: a skewed key's share is cut to that size, small keys share a task. The session's own size comes back after."""
    name, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set(name, str(part_bytes))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def write_release(released: DataFrame, path: str, by: list[str], part_bytes: int = 128 << 20) -> None:
    """A release (of release_sets) partitioned by `by`, then by chromosome. Only the partitions that it brings are replaced, so a partial rerun leaves the others alone.

    The checks of release_sets run while the rows are written; a fault fails the job before anything is replaced.
    """
    with part_size(released.sparkSession, part_bytes):
        out = released.hint("rebalance", *by, "CHROM").sortWithinPartitions(*by, "CHROM", "POS", "GENE_ID", "CS_INDEX", "ID")
        out.write.partitionBy(*by, "CHROM").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_counts(counts: DataFrame, path: str, by: list[str]) -> None:
    """The counts table of a release, of which likewise only the rows of the `by` values that come are replaced."""
    counts.coalesce(1).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_chr(spark: SparkSession, path: str, chroms: list[str] | None = None, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """S3: the chromosomes, columns and rows asked for; all three reach the scan."""
    d = spark.read.parquet(path)
    if chroms is not None:
        d = d.where(F.col("chr").isin(chroms))
    if where is not None:
        d = d.where(where)
    return d.select(*columns) if columns else d


def read_bed(spark: SparkSession, path: str, suffix: str = ".bed") -> DataFrame:
    """Chr, start_pos, end_pos, annotation (the file's name); comment, track and browser lines and *.unmapped.bed are skipped."""
    d = spark.read.text(path).select("value", _file_name().alias("_f")).where(F.col("_f").endswith(suffix) & ~F.col("_f").endswith(".unmapped" + suffix))
    part = F.split("value", "\t")
    d = d.where(~F.col("value").rlike("^(#|track|browser)") & (F.size(part) >= 3))
    return d.select(part[0].alias("chr"), part[1].cast("bigint").alias("start_pos"), part[2].cast("bigint").alias("end_pos"), F.expr(f"left(_f, length(_f) - {len(suffix)})").alias("annotation"))


def import_predictions(spark: SparkSession, glob: str) -> DataFrame:
    """Released tables (tab, header '#CHROM ...', gzip or not) with the library's names; files that are missing add no rows."""
    d = spark.read.csv(glob, schema=PREDICTIONS, sep="\t", header=True, enforceSchema=True)
    return d.select(*[F.col(a).alias(b) for a, b in RENAMED.items()], F.concat(F.lit("chr"), F.regexp_replace("CHROM", "^chr", "")).alias("chr"))


def export_faults(df: DataFrame) -> DataFrame:
    """One row: n_rows, and how many rows have an id of another chromosome."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("variant_id").startswith(F.concat("chr", F.lit(":")))).alias("n_other_chr"))


def export_predictions(df: DataFrame, path: str) -> None:
    """Gzip text by chromosome, sorted by position, gene and variant across the files of a chromosome; fails on empty or mixed input."""
    found = export_faults(df).first()
    if not found.n_rows or found.n_other_chr:
        raise ValueError(f"{found.n_rows} rows, {found.n_other_chr} of them with an id of another chromosome")
    back = {b: a for a, b in RENAMED.items()}
    out = df.select("chr", F.regexp_replace("chr", "^chr", "").alias("#CHROM"), *[F.col(c).alias(back[c]) for c in ("pos", "variant_id", "ref", "alt", "gene_id", "pip", "pred_prob")])
    out.repartitionByRange("chr", "POS").sortWithinPartitions("chr", "POS", "GENE_ID", "ID").write.partitionBy("chr").mode("overwrite").option("comment", "\u0001").csv(
        path, sep="\t", header=True, compression="gzip")  # the default comment mark would put the header's # in quotes
    n = import_predictions(df.sparkSession, f"{path}/*/*.csv.gz").count()
    if n != found.n_rows:
        raise ValueError(f"{n} rows written of {found.n_rows}")


def prep_gwas(df: DataFrame) -> DataFrame:
    """z = beta / se (null where se is 0 or missing); rows without z go; ordered by position."""
    return df.withColumn("z", F.try_divide("beta", "se")).dropna(subset=["z"]).drop("beta", "se").orderBy("chr", "pos")


def prep_snpvar(df: DataFrame) -> DataFrame:
    """CHR, BP, A1, A2, SNPVAR of all chromosomes, ordered; a negative variance fails the job where it is met."""
    checked = F.when(F.col("SNPVAR") < 0, F.raise_error(F.lit("negative SNPVAR in the constrained estimates")).cast("double")).otherwise(F.col("SNPVAR"))
    return df.select("CHR", "BP", "A1", "A2", checked.alias("SNPVAR")).orderBy("CHR", "BP", "A1", "A2")


def protein_coding_genes(spark: SparkSession, gtf: str) -> DataFrame:
    """Distinct gene_id, without version, of the `gene` features whose gene_type is protein_coding."""
    names = "seqname string, source string, feature string, start bigint, stop bigint, score string, strand string, frame string, attribute string"
    d = spark.read.csv(gtf, schema=names, sep="\t", comment="#", quote="").where("feature = 'gene'").where(F.col("attribute").rlike('gene_type "protein_coding"'))
    return d.select(F.regexp_extract("attribute", 'gene_id "([^".]*)', 1).alias("gene_id")).where("gene_id <> ''").distinct()


def read_lane(spark: SparkSession, path: str, lane: str, chroms: list[str] | None = None) -> DataFrame:
    """Train, train_restricted or test set of the chosen chromosomes, from one table partitioned by lane (then cell, chr); absent chromosomes add no rows."""
    if lane not in ("train", "train_restricted", "test"):
        raise ValueError(f"no such lane: {lane}")
    d = spark.read.parquet(path).where(F.col("lane") == lane)
    return d if chroms is None else d.where(F.col("chr").isin(chroms))


def with_chr(scores: DataFrame, id_col: str = "variant_id") -> DataFrame:
    """Chr from the id's prefix; write_by_chr then splits the table."""
    return scores.withColumn("chr", F.substring_index(id_col, ":", 1))
