"""Joins on alleles, on positions and on genes. Position joins put intervals into bins of their own size, so every join is an equi-join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.functions.keys import canonical_key

ALLELES = ["chr", "pos", "ref", "alt"]


FAN = 8


def bin_level(length: Column, width: int) -> Column:
    """The lowest level whose bins, of width * FAN ** level, are at least as long as the interval."""
    need = F.ceil(F.log(F.greatest(length.cast("double") / width, F.lit(1.0))) / math.log(FAN) - 1e-9)
    return F.when(F.pow(F.lit(float(FAN)), need) * width >= length, need).otherwise(need + 1).cast("int")


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: Column, lo: Column, hi: Column, width: int) -> DataFrame:
    """Points with lo <= at <= hi on equal keys.

    An interval lies in bins of its own level: `width` bases, or so many times FAN that it spans no more than two of them, whatever its
    length. A point is looked up once on each level that occurs (one, where lengths are alike). keys, and all columns used, must have
    one name on both sides only for the keys.
    """
    size = lambda level: (F.lit(width) * F.pow(F.lit(FAN), level)).cast("bigint")
    bin_of = lambda c, level: F.floor(c / size(level)).cast("bigint")
    i = intervals.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("_level", bin_level(F.col("_hi") - F.col("_lo") + 1, width))
    levels = i.agg(F.sort_array(F.collect_set("_level"))).scalar()
    i = i.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(F.col("_lo"), F.col("_level")), bin_of(F.col("_hi"), F.col("_level"))))))
    p = points.withColumn("_at", at).withColumn("_level", F.explode(levels)).withColumn("_bin", bin_of(F.col("_at"), F.col("_level")))
    return p.join(i, [*keys, "_level", "_bin"]).where("_at between _lo and _hi").drop("_level", "_bin", "_lo", "_hi", "_at")


def annotate_intervals(variants: DataFrame, intervals: DataFrame, width: int = 2000) -> DataFrame:
    """Long flags (key, annotation): the base [pos-1, pos) overlaps an interval [start, end), so start < pos <= end."""
    hits = range_join(variants.select(*ALLELES).distinct(), intervals.select("annotation", "chr", "start_pos", "end_pos"), ["chr"], F.col("pos"), F.col("start_pos") + 1, F.col("end_pos"), width)
    return hits.select(*ALLELES, "annotation").distinct()


def max_link_score(variants: DataFrame, links: DataFrame, cells: list[str], w: int = 1024, width: int = 4096) -> DataFrame:
    """Per variant-gene pair and cell the best score of the gene's links that overlap [pos-w, pos+w], both ends inclusive; 0 without one."""
    pairs = variants.select("gene_id", *ALLELES).distinct()
    near = range_join(pairs, links.select("gene_id", "chr", "cell", "start_pos", "end_pos", "abc_score"), ["gene_id", "chr"], F.col("pos"), F.col("start_pos") - w, F.col("end_pos") + w, width)
    best = near.groupBy("gene_id", *ALLELES).agg(*[F.max(F.when(F.col("cell") == c, F.col("abc_score"))).alias(f"_s{k}") for k, c in enumerate(cells)])
    # A pair becomes a row a cell after the join, so that it is shuffled once.
    each = F.array(*[F.struct(F.lit(c).alias("cell"), F.coalesce(F.col(f"_s{k}"), F.lit(0.0)).alias("abc_score")) for k, c in enumerate(cells)])
    return pairs.join(best, ["gene_id", *ALLELES], "left").select("gene_id", *ALLELES, F.inline(each))


def link_scores(variants: DataFrame, links: DataFrame, cells: dict[str, str], w: int = 1024, width: int = 4096) -> DataFrame:
    """J5 in wide form: the variants with one column a cell (name: cell), 0 without a link. Hits are aggregated wide, so pairs are neither copied a cell nor pivoted back."""
    pairs = variants.select("gene_id", *ALLELES).distinct()
    near = range_join(pairs, links.where(F.col("cell").isin(list(cells.values()))).select("gene_id", "chr", "cell", "start_pos", "end_pos", "abc_score"), ["gene_id", "chr"], F.col("pos"), F.col("start_pos") - w, F.col("end_pos") + w, width)
    best = near.groupBy("gene_id", *ALLELES).agg(*[F.max(F.when(F.col("cell") == c, F.col("abc_score"))).alias(n) for n, c in cells.items()])
    return variants.join(best, ["gene_id", *ALLELES], "left").fillna(0.0, list(cells))


def pair_genes(variants: DataFrame, genes: DataFrame, w: int = 1_000_000) -> DataFrame:
    """Variants paired with their given genes, else with every gene whose TSS lies within w; distinct.

    A given gene (column gene_id, null or empty where none) must be known and on the variant's chromosome, or the pair is dropped; a
    variant with any given gene takes no part in the window search.
    """
    genes = genes.groupBy("gene_id", "chr").agg(F.min("gene_tss").alias("gene_tss"))
    if "gene_id" in variants.columns:
        asked = variants.where("gene_id is not null and gene_id <> ''").select(*ALLELES, "gene_id").distinct()
        given = asked.join(genes, ["gene_id", "chr"]).select(*ALLELES, "gene_id", "gene_tss")
        free = variants.select(*ALLELES).join(asked.select(*ALLELES), ALLELES, "left_anti")
        return given.unionByName(pair_genes(free, genes, w))
    near = range_join(variants.select(*ALLELES).distinct(), genes.select("gene_id", "chr", "gene_tss"), ["chr"], F.col("pos"), F.col("gene_tss") - w, F.col("gene_tss") + w, 2 * w + 1)
    # Variants are distinct, a gene has one row a chromosome, and range_join gives a pair once: no shuffle of all pairs is needed.
    return near.select(*ALLELES, "gene_id", "gene_tss")


def flag_keys(baseline: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """0/1 column for membership in a key set."""
    k = keys.select(*ALLELES).distinct().withColumn(name, F.lit(1))
    return baseline.join(k, ALLELES, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def match_panel(gwas: DataFrame, panel: DataFrame) -> DataFrame:
    """GWAS on panel orientation: keep or flip z; rows without z go; one row per key, same orientation first, then position and z."""
    key = canonical_key(F.col("chr"), F.col("pos"), F.col("ref"), F.col("alt"))
    p = panel.select(key.alias("key"), F.col("ref").alias("p_ref"), F.col("alt").alias("p_alt")).distinct()
    j = gwas.where("z is not null and not isnan(z)").withColumn("key", key).join(p, "key")
    keep = (F.col("ref") == F.col("p_ref")) & (F.col("alt") == F.col("p_alt"))
    j = j.withColumns({"orient": F.when(keep, "keep").otherwise("flip"), "z_panel": F.when(keep, F.col("z")).otherwise(-F.col("z"))})
    first = F.row_number().over(Window.partitionBy("key").orderBy((F.col("orient") != "keep").cast("int"), "pos", "z_panel", "n", "p_ref"))
    return j.withColumn("_r", first).where("_r = 1").select("key", "chr", "pos", "orient", "z_panel", "n")


def enough_matched(matched: DataFrame, windows: DataFrame, least: int = 10) -> DataFrame:
    """J12 by gene: the matched rows (chr, pos and others) in each gene's window (gene_id, chr, start_pos, end_pos, inclusive), of genes with at least `least` of them."""
    near = range_join(matched, windows.select("gene_id", "chr", "start_pos", "end_pos"), ["chr"], F.col("pos"), F.col("start_pos"), F.col("end_pos"), 1_000_000)
    whole = near.groupBy("gene_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return near.join(whole.select("gene_id"), "gene_id", "left_semi").drop("start_pos", "end_pos")


def missing_outputs(expected: DataFrame, done: DataFrame, required: int) -> DataFrame:
    """Genes of `expected` that lack one of the required models in done(gene_id, model)."""
    whole = done.groupBy("gene_id").agg(F.countDistinct("model").alias("m")).where(F.col("m") >= required)
    return expected.select("gene_id").distinct().join(whole, "gene_id", "left_anti")


def join_alleles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables with equal alleles."""
    return a.join(b, ALLELES)


def keep_annotated(df: DataFrame, annotated: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in the table of annotated variants."""
    return df.join(annotated.select(*keys), keys, "left_semi")


def features_for_positions(df: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Every row, with the features of its position where there are any; the join's own filter takes the place of a list of positions."""
    return df.join(features, keys, "left")


def attach_aux(df: DataFrame, constraint: DataFrame, maf: DataFrame, fill: bool = True) -> DataFrame:
    """gene_lof (constraint: gene_id, gene_lof) and gnomad_MAF (maf: alleles, gnomad_MAF) by left joins; missing values take the frame's median."""
    d = df.join(constraint.groupBy("gene_id").agg(F.max("gene_lof").alias("gene_lof")), "gene_id", "left").join(maf.groupBy(*ALLELES).agg(F.max("gnomad_MAF").alias("gnomad_MAF")), ALLELES, "left")
    if not fill:
        return d
    medians = lambda c: d.agg(F.median(c)).scalar()
    return d.withColumns({c: F.coalesce(F.col(c), medians(c)) for c in ("gene_lof", "gnomad_MAF")})


def restrict_genes(df: DataFrame, coding: DataFrame | None = None, consensus: DataFrame | None = None) -> DataFrame:
    """Rows of the coding genes (gene_id) and of the genes that all priors fine-mapped (consensus: gene_id, in_all_priors); either may be left out."""
    if coding is not None:
        df = df.join(coding.select("gene_id"), "gene_id", "left_semi")
    if consensus is not None:
        df = df.join(consensus.where("in_all_priors = 1").select("gene_id"), "gene_id", "left_semi")
    return df
