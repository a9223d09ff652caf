"""Tables put together from the other operators, for all genes, chromosomes and cells in one job (M1-M4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.keys import variant_features, variant_type
from locusframe.operators.aggregates import ALLELES, best_pip_row, peak_summary, sample_negatives
from locusframe.operators.features import tf_summary
from locusframe.operators.joins import annotate_intervals, keep_annotated, link_scores
from locusframe.operators.study import clean_features
from locusframe.sources.shared import written


def variant_annotations(variants: DataFrame, intervals: DataFrame, names: dict[str, str], tracks: DataFrame, lists: DataFrame, cells: list[str], dropped: DataFrame | None = None) -> DataFrame:
    """M1: per variant a 0/1 column for each annotation (column: annotation), the truncated TF score of each cell, and their products with the flags.

    tracks: alleles, track, v; dropped (track): tracks that take no part (CAGE). Only variants with a track that stays are in the table. Flags
    and scores are conditional aggregates, so a variant is one row a side before the join.
    """
    v = variants.select(*ALLELES).distinct()
    if dropped is not None:
        tracks = tracks.join(dropped.select("track").distinct(), "track", "left_anti")
    flags = annotate_intervals(v, intervals.where(F.col("annotation").isin(list(names.values())))).groupBy(*ALLELES).agg(*[F.max((F.col("annotation") == a).cast("int")).alias(n) for n, a in names.items()])
    tf = tf_summary(tracks, lists, ALLELES).groupBy(*ALLELES).agg(*[F.max(F.when(F.col("cell") == c, F.col("tf_composite"))).alias(f"tf_{c}") for c in cells])
    d = v.join(flags, ALLELES, "left").fillna(0, list(names)).join(tf, ALLELES)
    return d.withColumns({f"{n}_x_{c}": F.col(n) * F.col(f"tf_{c}") for n in names for c in cells})


def gene_feature_table(fits: DataFrame, order: list[Column], intervals: DataFrame, genes: DataFrame, links: DataFrame, cells: dict[str, str],
                       peaks: DataFrame | None = None, shape: tuple[list[str], list[str], list[str]] = ([], [], []), tracks: DataFrame | None = None, lists: DataFrame | None = None, tf_cells: tuple[str, ...] = ()) -> DataFrame:
    """M2: per gene and annotated variant its best row, distances to the gene's mean TSS, the best link score per cell (column: cell), and,
    where given, peak summaries (peaks: alleles, cell, assay and metrics; shape: cells, metrics, assays; 0 where absent) and TF summaries
    (tracks: alleles, track, v; lists: cell, track). Rows of other variants are left out before they are ranked or summarized; annotated variants and best rows are written once."""
    annotated = written(annotate_intervals(fits, intervals).select(*ALLELES).distinct(), "feature-variants")
    v = written(best_pip_row(keep_annotated(fits, annotated, ALLELES), order), "feature-best")
    distance = F.col("_tss") - F.col("pos")
    v = v.join(genes.groupBy("gene_id").agg(F.avg("gene_tss").alias("_tss")), "gene_id", "left").withColumns({"distance_TSS": distance, "abs_distance_TSS": F.abs(distance), "abs_distance_TSS_log": F.when(distance != 0, F.log(F.abs(distance)))}).drop("_tss")
    v = link_scores(v, links, cells)
    if peaks is not None:
        p = peak_summary(keep_annotated(peaks, annotated, ALLELES), *shape, keys=ALLELES)
        v = v.join(p, ALLELES, "left").fillna(0.0, [c for c in p.columns if c not in ALLELES])
    if tracks is not None:
        of = {"max": "tf_max", "min": "tf_min", "abs_max": "tf_max_abs"}
        t = tf_summary(keep_annotated(tracks, annotated, ALLELES), lists, ALLELES).groupBy(*ALLELES).agg(*[F.max(F.when(F.col("cell") == c, F.col(s))).alias(f"{n}_{c}_TF_score") for c in tf_cells for n, s in of.items()])
        v = v.join(t, ALLELES, "left")
    return v


def training_set(positives: DataFrame, candidates: DataFrame, order: list[Column], per: int = 10, features: DataFrame | None = None, slot: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """M3: positives (label 1) and, per gene and variant type, `per` times as many of the candidates (label 0), in a fixed order.

    features (one row a gene_id and alleles, and columns): only rows with features take part, and they carry them. A positive of several rows is one.
    Rows meet their features once, and are written for the steps that count and draw.
    """
    p, n = (variant_type(d).drop("type_del", "type_snv", "type_ins") for d in (positives, candidates))
    both = p.withColumn("label", F.lit(1)).unionByName(n.withColumn("label", F.lit(0)))
    both = written(both if features is None else both.join(features, ["gene_id", *ALLELES]), "training-rows")
    p = both.where("label = 1")
    return p.unionByName(sample_negatives(p, both.where("label = 0"), ["gene_id", "variant_type"], order, per, slot))


def feature_matrix(df: DataFrame, names: list[str], absolute: list[str], gpn: str | None = None) -> DataFrame:
    """M4: df with `features`, the cleaned array of `names` in their order; variant features are computed, absent columns are 0.

    gpn names the score column whose absolute value is appended last and stays null where it is missing.
    """
    own = {"is_SNP": "is_snp"}
    d = variant_features(df)
    have = {c.lower() for c in d.columns}
    col = lambda n: F.col(own.get(n, n)) if own.get(n, n).lower() in have else F.lit(0.0)
    values = F.array(*[col(n).cast("double") for n in names])
    computed = {"length_diff", "is_snp", "is_indel", "is_insertion", "is_deletion"} - {c.lower() for c in df.columns}
    return d.withColumn("features", clean_features(values, [n in absolute for n in names], F.col(gpn) if gpn else None)).drop(*computed)
