"""Summaries of a study: peaks near variants, allele frequencies, set matching, sharing across cells, heritability curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.functions.keys import canonical_key, neglog10p
from locusframe.operators.aggregates import ALLELES, top_n
from locusframe.operators.joins import range_join


def clean_features(values: Column, absolute: list[bool], last: Column | None = None) -> Column:
    """Null, NaN and infinite entries of a feature array become 0; entries marked in `absolute` lose their sign. `last` is appended as |last|, null where missing."""
    mask = F.array(*[F.lit(a) for a in absolute])
    finite = F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    out = F.zip_with(finite, mask, lambda x, a: F.when(a, F.abs(x)).otherwise(x))
    return out if last is None else F.concat(out, F.array(F.abs(F.nanvl(last.cast("double"), F.lit(None)))))


def pair_peaks(variants: DataFrame, peaks: DataFrame, w: int = 1024) -> DataFrame:
    """Variants and peaks whose centre lies within w bases, with the signed distance. Peaks: annotation, chr, start_pos, end_pos."""
    centre = (F.col("start_pos") + F.floor((F.col("end_pos") - F.col("start_pos")) / 2)).cast("bigint")
    p = peaks.select("annotation", "chr", centre.alias("centre"))
    near = range_join(variants.select(*ALLELES).distinct(), p, ["chr"], F.col("pos"), F.col("centre") - w, F.col("centre") + w, 2 * w)
    return near.withColumn("distance", F.col("pos") - F.col("centre"))


def allele_frequency(variants: DataFrame, sites: DataFrame) -> DataFrame:
    """Af of each variant that has a site: the same orientation before the swapped one, then the first record; a missing af is 0.

    sites: alleles, af, record_no. Alleles of both sides are compared through a key that does not depend on orientation.
    """
    key = canonical_key(*[F.col(c) for c in ALLELES]).alias("_key")
    s = sites.select(key, F.col("ref").alias("_ref"), F.coalesce("af", F.lit(0.0)).alias("_af"), "record_no")
    j = variants.select(*ALLELES).distinct().select("*", key).join(s, "_key")
    return j.groupBy(*ALLELES).agg(F.min_by("_af", F.struct((F.col("ref") != F.col("_ref")).alias("swapped"), "record_no", "_af")).alias("af"))


def match_summary(ref: DataFrame, comp: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Sets on either side, matched and alone, shares matched and of equal top variants, median Jaccard. ref and comp: one row per set; matched: from same_top."""
    r, c = ref.groupBy(*keys).agg(F.count("*").alias("n_ref")), comp.groupBy(*keys).agg(F.count("*").alias("n_comp"))
    m = matched.groupBy(*keys).agg(F.count("*").alias("n_matched"), F.median("jaccard").alias("median_jaccard"), (100.0 * F.avg(F.col("same_top_variant").cast("int"))).alias("pct_same_top"))
    j = r.join(c, keys).join(m, keys, "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    return j.select(*keys, "n_ref", "n_comp", "n_matched", (F.col("n_ref") - F.col("n_matched")).alias("ref_only"), (F.col("n_comp") - F.col("n_matched")).alias("comp_only"),
                    (100.0 * F.col("n_matched") / F.col("n_ref")).alias("pct_ref_matched"), "median_jaccard", "pct_same_top")


def crosscell_sets(rows: DataFrame, h4: float = 0.8, by: list[str] = ["cell"]) -> DataFrame:  # noqa: B006
    """Per focal credible set the cells it was tested against, the largest H4 and the cells that share it.

    rows: gene_id, idx, other_cell, h4, note (null for a test) and the columns of `by`. A set without a partner counts as not shared.
    """
    key = ["gene_id", *by, "idx"]
    tested = F.col("note").isNull()
    shares = F.array_join(F.sort_array(F.collect_set(F.when(tested & (F.col("h4") > h4), F.col("other_cell")))), ",")
    s = rows.groupBy(*key).agg(F.max((F.col("note") == "focal credible set").cast("int")).alias("_focal"), F.countDistinct(F.when(tested, F.col("other_cell"))).alias("n_other_tested"),
                               F.max(F.when(tested, F.col("h4"))).alias("max_h4"), shares.alias("shared_with"))
    return s.where("_focal = 1").drop("_focal").withColumn("shared", F.coalesce((F.col("max_h4") > h4).cast("int"), F.lit(0)))


def crosscell_genes(rows: DataFrame, h4: float = 0.8, by: list[str] = ["cell"]) -> DataFrame:  # noqa: B006
    """Per cell and gene with a credible set: sets, shared sets, the cells that share any of them, whether any is shared."""
    s = crosscell_sets(rows, h4, by)
    cells = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("shared_with") != "", F.split("shared_with", ",")).otherwise(F.array().cast("array<string>"))))))
    g = s.groupBy(*by, "gene_id").agg(F.count("*").alias("n_cs"), F.sum("shared").alias("n_cs_shared"), F.array_join(cells, ",").alias("shared_with"))
    return g.withColumn("shared", (F.col("n_cs_shared") > 0).cast("int"))


def crosscell_summary(rows: DataFrame, h4: float = 0.8, by: list[str] = ["cell"]) -> DataFrame:  # noqa: B006
    """Per cell (or what `by` names) counts of credible sets and genes, shared and with a partner; genes fitted include those without a set."""
    s = crosscell_sets(rows, h4, by)
    gene = s.groupBy(*by, "gene_id").agg(F.count("*").alias("n"), F.sum("shared").alias("k"), F.count_if(F.col("n_other_tested") > 0).alias("p"))
    summed = gene.groupBy(*by).agg(F.sum("n").alias("n_cs"), F.sum("k").alias("n_cs_shared"), F.sum("p").alias("n_cs_with_partner"), F.count("*").alias("n_egenes_with_cs"), F.count_if(F.col("k") > 0).alias("n_egenes_shared"))
    fit = rows.where(F.col("note").isin("focal credible set", "no credible set")).groupBy(*by).agg(F.countDistinct("gene_id").alias("n_egenes_fit"))
    return summed.join(fit, by, "left").withColumns({n: F.round(F.try_divide(100.0 * F.col(a), F.col(b)), 1) for n, a, b in (
        ("pct_cs_shared", "n_cs_shared", "n_cs"), ("pct_cs_shared_with_partner", "n_cs_shared", "n_cs_with_partner"), ("pct_egenes_shared", "n_egenes_shared", "n_egenes_with_cs"))})


def tau_star(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Standardised effect of an annotation from its delete-block coefficients. blocks: keys, value, prop_snps, m, h2.

    A column of one block, or of equal blocks, has no error, and null z and p.
    """
    x = F.col("value") * F.sqrt(F.col("prop_snps") * (1 - F.col("prop_snps"))) * F.col("m") / F.col("h2")
    g = blocks.groupBy(*keys).agg(F.avg(x).alias("tau_star"), (F.stddev_samp(x) * F.sqrt(F.count(x) - 1)).alias("se"), F.count(x).alias("n_blocks"))
    g = g.withColumn("z", F.when(F.col("se") > 0, F.col("tau_star") / F.col("se")))
    return g.withColumn("p", F.pow(F.lit(10.0), -neglog10p(F.col("z"))))


def tau_check(tau: DataFrame, coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """How far z of tau* is from the regression coefficient's z (coef_z), which it must equal: the largest and the median difference."""
    d = tau.join(coefficients.select(*keys, "coef_z"), keys).select(F.abs(F.col("z") - F.col("coef_z")).alias("_d"))
    return d.agg(F.max("_d").alias("max_difference"), F.median("_d").alias("median_difference"), F.count("_d").alias("n"))


def select_tau(sweep: DataFrame, cohort: str, cut: str, tau: str, cuts: int = 20) -> DataFrame:
    """The cut with the largest tau of each cohort whose sweep has all its cuts; ties go to the lowest cut."""
    g = sweep.groupBy(cohort).agg(F.countDistinct(cut).alias("_n"), F.max_by(cut, F.struct(F.col(tau), (-F.col(cut)).alias("k"))).alias("selected"), F.max(tau).alias(tau))
    return g.where(F.col("_n") == cuts).drop("_n")


def size_match(df: DataFrame, key: str, size: str) -> DataFrame:
    """Whether annotations of a cell are of one size."""
    return df.groupBy(key).agg(F.min(size).alias("least"), F.max(size).alias("most"), F.countDistinct(size).alias("n_sizes"))


def bin_sum_difference(df: DataFrame, keys: list[str], lo: int = 432, hi: int = 463) -> DataFrame:
    """Reference minus alternative sum over the central bins. df: keys, allele ('ref' or 'alt'), bin, value."""
    signed = F.when(F.col("allele") == "ref", F.col("value")).otherwise(-F.col("value"))
    return df.where(F.col("bin").between(lo, hi)).groupBy(*keys).agg(F.sum(signed).alias("difference"))


def profile_divergence(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per fold the count difference and, with its sign, summed |log p| difference and Jensen-Shannon distance; then means over folds.

    df: keys, fold, ref_p, alt_p (positive, each summing to 1 in a fold), ref_count, alt_count (equal in all rows of a fold).
    """
    p, q = F.col("ref_p"), F.col("alt_p")
    m = (p + q) / 2
    fold = df.groupBy(*keys, "fold").agg((F.max("alt_count") - F.max("ref_count")).alias("counts"), F.sum(F.abs(F.log(q) - F.log(p))).alias("_probs"), F.sum((p * F.log(p / m) + q * F.log(q / m)) / 2).alias("_js"))
    sign = F.signum(F.col("counts").cast("double"))
    return fold.groupBy(*keys).agg(F.avg("counts").alias("counts"), F.avg(F.col("_probs") * sign).alias("probs"), F.avg(F.sqrt(F.greatest("_js", F.lit(0.0))) * sign).alias("jsd"))


def share_of_total(df: DataFrame, scope: list[str], value: str) -> DataFrame:
    """A value's share of its scope's sum."""
    return df.withColumn("share", F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*scope))))


def top_n_annotations(baseline: DataFrame, ranked: DataFrame, ranking: str, names: list[str], score: str, n: int) -> DataFrame:
    """K2: one 0/1 column per ranking, for the n best keys of the baseline in each."""
    best = top_n(ranked, [ranking], score, ALLELES, n, baseline)
    flags = best.groupBy(*ALLELES).agg(*[F.max((F.col(ranking) == x).cast("int")).alias(f"top_{x}") for x in names])
    out = baseline.select(*ALLELES).distinct().join(flags, ALLELES, "left")
    return out.withColumns({f"top_{x}": F.coalesce(F.col(f"top_{x}"), F.lit(0)) for x in names})


def short_rankings(baseline: DataFrame, ranked: DataFrame, ranking: str, names: list[str], n: int) -> DataFrame:
    """K1: rankings (of `names`) with fewer than n keys of the baseline, and how many they have."""
    have = ranked.select(ranking, *ALLELES).distinct().join(baseline.select(*ALLELES), ALLELES, "left_semi").groupBy(ranking).agg(F.count("*").alias("n_candidates"))
    every = ranked.sparkSession.createDataFrame([(x,) for x in names], f"{ranking} string")
    d = every.join(have, ranking, "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    return d.where(F.col("n_candidates") < n)


def gwas_gene_list(cells: list[DataFrame], windows: DataFrame) -> DataFrame:
    """Autosomal genes of any cell that have a window; one row per gene."""
    every = reduce(DataFrame.unionByName, [c.select("gene_id", "chr") for c in cells])
    autosomal = every.where(F.col("chr").rlike("^chr([1-9]|1[0-9]|2[0-2])$"))
    return autosomal.groupBy("gene_id").agg(F.min("chr").alias("chr")).join(windows, "gene_id", "left_semi")


def annotation_matrix(keys: DataFrame, long: DataFrame, names: list[str]) -> DataFrame:
    """Long annotations (alleles, annotation) as 0/1 columns over all keys; column names are given, so no pass looks for them."""
    flags = long.where(F.col("annotation").isin(names)).groupBy(*ALLELES).agg(*[F.max((F.col("annotation") == x).cast("int")).alias(x) for x in names])
    return keys.select(*ALLELES).distinct().join(flags, ALLELES, "left").fillna(0, names)


def annotation_sums(keys: DataFrame, long: DataFrame) -> DataFrame:
    """Per chromosome and annotation the number of annotated keys (the .l2.M sums)."""
    on = long.select(*ALLELES, "annotation").distinct().join(keys.select(*ALLELES).distinct(), ALLELES, "left_semi")
    return on.groupBy("chr", "annotation").agg(F.count("*").alias("m"))
