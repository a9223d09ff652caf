"""Variant keys and scalar functions of a variant (column in, column out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ascending coefficients of the Numerical Recipes approximation of erfc.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def variant_id(chr_: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", chr_, pos.cast("string"), ref, alt)


def parse_variant(df: DataFrame, col: str = "variant_id") -> DataFrame:
    """Chr, pos, ref, alt of a chr:pos:ref:alt id; a malformed position is null."""
    part = lambda i: F.get(F.split(col, ":"), F.lit(i))
    return df.withColumns({"chr": part(0), "pos": part(1).try_cast("bigint"), "ref": part(2), "alt": part(3)})


def variant_features(df: DataFrame) -> DataFrame:
    """Length difference and flags. The names insertion and deletion are swapped, as published models expect."""
    diff = F.length("ref") - F.length("alt")
    flag = lambda c: c.cast("int")
    return df.withColumns({"length_diff": diff, "is_snp": flag(diff == 0), "is_indel": flag(diff != 0), "is_insertion": flag(diff > 0), "is_deletion": flag(diff < 0)})


def variant_type(df: DataFrame) -> DataFrame:
    """-1 deletion, 0 SNV, 1 insertion (true sign), with indicator columns."""
    t = F.signum((F.length("alt") - F.length("ref")).cast("double")).cast("int")
    return df.withColumn("variant_type", t).withColumns({n: (F.col("variant_type") == v).cast("int") for n, v in (("type_del", -1), ("type_snv", 0), ("type_ins", 1))})


def canonical_key(chr_: Column, pos: Column, a: Column, b: Column, upper: bool = False) -> Column:
    """The same key for either orientation of the alleles."""
    a, b = (F.upper(a), F.upper(b)) if upper else (a, b)
    return F.concat_ws(":", chr_, pos.cast("string"), F.least(a, b), F.greatest(a, b))


def translate_id(col: Column) -> Column:
    """P5: chr_pos_ref_alt_b38 to chr:pos:ref:alt."""
    return F.regexp_replace(F.regexp_replace(col, "_b38$", ""), "_", ":")


def strip_version(gene: Column) -> Column:
    return F.regexp_replace(gene, r"\.\d+$", "")


def reject_reason(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """Why a user's variant is not usable, null if it is. Columns are as they come, all strings."""
    clean = lambda c: F.upper(F.trim(c))
    name = F.regexp_replace(F.trim(chrom), "(?i)^chr", "")
    return (
        F.when(F.coalesce(chrom, pos, ref, alt).isNull() | chrom.isNull() | pos.isNull() | ref.isNull() | alt.isNull(), "missing")
        .when(~name.rlike("^([1-9]|1[0-9]|2[0-2])$"), "not_autosome").when(F.trim(pos).try_cast("bigint").isNull() | (F.trim(pos).try_cast("bigint") < 1), "position")
        .when(~clean(ref).rlike("^[ACGT]+$") | ~clean(alt).rlike("^[ACGT]+$"), "allele").when(clean(ref) == clean(alt), "same_allele"))


def reject_counts(df: DataFrame, c: Column, pos: Column, ref: Column, alt: Column) -> DataFrame:
    """How many variants each reason rejects, and how many are `ok`."""
    return df.groupBy(F.coalesce(reject_reason(c, pos, ref, alt), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def recalibrate(p: Column, prior: float = 1.8 / 14716) -> Column:
    """P10: shift the logit of p from an even prior to `prior`; missing p is the prior."""
    odds = p / (1 - p) * (prior / (1 - prior))
    return F.when(p.isNull(), prior).when(p >= 1, 1.0).when(p <= 0, 0.0).otherwise(odds / (1 + odds))


def neglog10p(z: Column) -> Column:
    """Two-sided -log10 p of a z score, in log space, so that |z| of 40 and more stays finite."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = poly * t + c
    return -(F.log(t) - x * x + poly) / F.log(F.lit(10.0))


def region_label(distance: Column) -> Column:
    """P15."""
    return F.when(F.abs(distance) > 10_000, "enhancer").otherwise("promoter")


def distance_tss(df: DataFrame, genes: DataFrame) -> DataFrame:
    """Signed, absolute and log distance of each row to its gene's mean TSS (genes: gene_id, gene_tss); the log of 0 is null."""
    j = df.join(genes.groupBy("gene_id").agg(F.avg("gene_tss").alias("_tss")), "gene_id").withColumn("distance_tss", F.col("_tss") - F.col("pos"))
    d = F.abs("distance_tss")
    return j.withColumns({"abs_distance": d, "ln_distance": F.when(d > 0, F.log(d))}).drop("_tss")


def gene_constraint(post_mean: Column) -> Column:
    """log2; null where it is undefined."""
    return F.when(post_mean > 0, F.log2(post_mean))


def cell_tf_product(flag: Column, score: Column) -> Column:
    """A cell's regulatory flag times its TF score, truncated toward 0."""
    return (score * flag).cast("int")
