"""Aggregations, windows, top-k, sampling and set operations over variant tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.sources.shared import written

ALLELES = ["chr", "pos", "ref", "alt"]


def max_over_genes(df: DataFrame, score: str) -> DataFrame:
    """A1."""
    return df.groupBy(*ALLELES).agg(F.max(score).alias(score))


def best_pip_row(df: DataFrame, order: list[Column]) -> DataFrame:
    """A2: one whole row per gene and variant: highest pip, ties by `order`."""
    w = Window.partitionBy("gene_id", *ALLELES).orderBy(F.desc("pip"), *order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def peak_summary(df: DataFrame, cells: list[str], metrics: list[str], assays: list[str], keys: list[str] = ["variant_id"]) -> DataFrame:  # noqa: B006
    """A3: per key and each cell, metric and assay max(0, .), min(0, .) and max |.|; an absent one gives 0, so the columns are always the same.

    df: keys, cell, assay and a column for each metric. Not-a-number counts as missing.
    """
    zero, cols = F.lit(0.0), []
    for c in cells:
        for m in metrics:
            for a in assays:
                v = F.when((F.col("cell") == c) & (F.col("assay") == a) & ~F.isnan(m), F.col(m))
                name = f"{c}_{m}"
                cols += [F.greatest(zero, F.coalesce(F.max(v), zero)).alias(f"{name}_max_{a}"), F.least(zero, F.coalesce(F.min(v), zero)).alias(f"{name}_min_{a}"), F.coalesce(F.max(F.abs(v)), zero).alias(f"{name}_abs_max_{a}")]
    return df.groupBy(*keys).agg(*cols)


def list_genes(df: DataFrame) -> DataFrame:
    """The genes of a table and their chromosomes."""
    return df.select("gene_id", "chr").distinct()


def attribution_summary(df: DataFrame, categories: list[str]) -> DataFrame:
    """Per cohort, region and category the mean absolute attribution over all rows of the region, its share, and the number of rows; place: the category's.

    df: cohort, region and a column for each category.
    """
    means = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("place"), F.avg(F.abs(c)).alias("mean_abs")) for k, c in enumerate(categories)])
    long = df.groupBy("cohort", "region").agg(means.alias("_m"), F.count("*").alias("n_variants")).select("cohort", "region", "n_variants", F.inline("_m"))
    return long.withColumn("share", F.try_divide("mean_abs", F.sum("mean_abs").over(Window.partitionBy("cohort", "region"))))


def summary_wide(long: DataFrame, keys: list[str], column: str, value: str, names: list[str]) -> DataFrame:
    """One column for each of `names`; absent ones are 0."""
    return long.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(column) == n, F.col(value))), F.lit(0.0)).alias(n) for n in names])


def pip_rank(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rank by pip within the keys (ties by `order`), whether it is the top, and the number of rows."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({"pip_rank": F.row_number().over(w.orderBy(F.desc("pip"), *order)), "n": F.count("*").over(w)})
    return d.withColumn("is_top_pip", F.col("pip_rank") == 1)


def median_fill(df: DataFrame, cols: list[str], scope: list[str]) -> DataFrame:
    """A5: exact median of a column within a scope in place of nulls."""
    m = df.groupBy(*scope).agg(*[F.median(c).alias(f"_m_{c}") for c in cols])
    return df.join(m, scope).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols}).drop(*[f"_m_{c}" for c in cols])


def sample_weights(df: DataFrame, label: str, pip: str, scope: list[str]) -> DataFrame:
    """Negatives weigh 1, positives pip * N_neg / sum(pip of positives), within a scope."""
    s = df.groupBy(*scope).agg(F.count_if(F.col(label) == 0).alias("_n"), F.sum(F.when(F.col(label) == 1, F.col(pip))).alias("_s"))
    w = F.when(F.col(label) == 1, F.when(F.col("_s") > 0, F.col(pip) * F.col("_n") / F.col("_s")).otherwise(F.col(pip))).otherwise(1.0)
    return df.join(s, scope).withColumn("weight", w).drop("_n", "_s")


def pip_from_alpha(df: DataFrame) -> DataFrame:
    """1 - prod(1 - alpha) over effects."""
    sure = F.max("alpha") >= 1
    return df.groupBy("gene_id", "cell", "variant_key").agg(F.when(sure, 1.0).otherwise(1 - F.exp(F.sum(F.when(F.col("alpha") < 1, F.log1p(-F.col("alpha")))))).alias("pip"))


def softmax(df: DataFrame, keys: list[str], lbf: str, prior: Column | None = None) -> DataFrame:
    """alpha = softmax of the log Bayes factor (plus log prior) per single-effect fit, by log-sum-exp."""
    x = F.col(lbf) if prior is None else F.col(lbf) + F.log(prior)
    w = Window.partitionBy(*keys)
    df = df.withColumn("_x", x).withColumn("_e", F.exp(F.col("_x") - F.max("_x").over(w)))
    return df.withColumn("alpha", F.col("_e") / F.sum("_e").over(w)).drop("_x", "_e")


def credible_set(df: DataFrame, keys: list[str], coverage: float | Column = 0.95) -> DataFrame:
    """The smallest prefix, by alpha, that reaches the coverage (a column: of the fit)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("alpha"), "variant_key").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_b", F.coalesce(F.sum("alpha").over(w), F.lit(0.0))).where(F.col("_b") < coverage).drop("_b")


def ems_reweight(df: DataFrame, keys: list[str], factor: str, missing: float, purity: str = "purity", least: float = 0.5) -> DataFrame:
    """Alpha * f / sum(alpha * f) * sum(alpha) within an effect whose set is pure (purity of at least `least`); other effects keep theirs."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_af", F.col("alpha") * F.coalesce(F.col(factor), F.lit(missing)))
    pure = (F.col(purity) >= least) & (F.sum("_af").over(w) > 0)
    return df.withColumn("alpha", F.when(pure, F.col("_af") / F.sum("_af").over(w) * F.sum("alpha").over(w)).otherwise(F.col("alpha"))).drop("_af")


def set_table(members: DataFrame, keys: list[str] = ["gene_id", "cell", "effect"]) -> DataFrame:  # noqa: B006
    """Per credible set its size, top and summed pip, top variant."""
    top = F.max_by("variant_key", F.struct("alpha", (-F.col("variant_key")).alias("k")))
    return members.groupBy(*keys).agg(F.count("*").alias("size"), F.max("alpha").alias("top_pip"), F.sum("alpha").alias("sum_pip"), top.alias("top_variant"))


def gene_table(fits: DataFrame, sets: DataFrame) -> DataFrame:
    """Per gene and cell the number of variants, of credible sets (0 without any) and the largest pip. fits: gene_id, cell, variant_key, pip."""
    g = fits.groupBy("gene_id", "cell").agg(F.countDistinct("variant_key").alias("n_variants"), F.max("pip").alias("max_pip"))
    n = sets.groupBy("gene_id", "cell").agg(F.count("*").alias("n_cs"))
    return g.join(n, ["gene_id", "cell"], "left").withColumn("n_cs", F.coalesce("n_cs", F.lit(0)))


def set_variants(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Member rows with the rank of their set."""
    return members.join(cs_rank(sets).select("gene_id", "cell", "effect", "cs_rank"), ["gene_id", "cell", "effect"])


def high_pip(fits: DataFrame, members: DataFrame, cut: float = 0.10) -> DataFrame:
    """Variants with a pip over the cut, in a set or not."""
    m = members.select("gene_id", "cell", "variant_key").distinct().withColumn("in_cs", F.lit(True))
    return fits.where(F.col("pip") > cut).join(m, ["gene_id", "cell", "variant_key"], "left").withColumn("in_cs", F.coalesce("in_cs", F.lit(False)))


def cs_rank(sets: DataFrame) -> DataFrame:
    """Rank of a gene's sets by top pip."""
    return sets.withColumn("cs_rank", F.row_number().over(Window.partitionBy("cell", "gene_id").orderBy(F.desc("top_pip"), "effect")))


def gene_level(genes: DataFrame, sets: DataFrame) -> DataFrame:
    """Purity, size, log Bayes factor and top pip of a gene's sets; genes without a set stay. sets: gene_id, cell, size, purity, lbf, top_pip."""
    of = {"mean_purity": F.avg("purity"), "min_purity": F.min("purity"), "mean_size": F.avg("size"), "median_size": F.median("size"), "mean_lbf": F.avg("lbf"), "max_lbf": F.max("lbf"), "mean_top": F.avg("top_pip"), "max_top": F.max("top_pip")}
    s = sets.groupBy("gene_id", "cell").agg(F.count("*").alias("n_cs"), *[c.alias(n) for n, c in of.items()])
    return genes.select("gene_id", "cell").distinct().join(s, ["gene_id", "cell"], "left").withColumn("n_cs", F.coalesce("n_cs", F.lit(0)))


def gene_consensus(df: DataFrame, prior: str, names: list[str]) -> DataFrame:
    """A gene's presence in each prior, in how many of the priors observed anywhere it occurs, and whether in all of those."""
    g = df.groupBy("gene_id").agg(*[F.max((F.col(prior) == n).cast("int")).alias(n) for n in names], F.countDistinct(prior).alias("n_priors"))
    return g.withColumn("in_all_priors", (F.col("n_priors") == df.agg(F.countDistinct(prior)).scalar()).cast("int"))


def match_by_index(ref: DataFrame, comp: DataFrame) -> DataFrame:
    """A17 (same index): sets of a gene with equal effect index, with the Jaccard of their members (0 if disjoint)."""
    key = ["gene_id", "effect"]
    na, nb = ref.groupBy(*key).agg(F.count("*").alias("na")), comp.groupBy(*key).agg(F.count("*").alias("nb"))
    both = ref.select(*key, "variant_key").join(comp.select(*key, "variant_key"), [*key, "variant_key"]).groupBy(*key).agg(F.count("*").alias("shared"))
    j = na.join(nb, key).join(both, key, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return j.select("gene_id", F.col("effect").alias("ref_cs"), F.col("effect").alias("comp_cs"), "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def same_top(matched: DataFrame, ref_sets: DataFrame, comp_sets: DataFrame) -> DataFrame:
    """Matched sets with both top variants and whether these are one. Sets: gene_id, effect, top_variant."""
    a = ref_sets.select("gene_id", F.col("effect").alias("ref_cs"), F.col("top_variant").alias("ref_top"))
    b = comp_sets.select("gene_id", F.col("effect").alias("comp_cs"), F.col("top_variant").alias("comp_top"))
    return matched.join(a, ["gene_id", "ref_cs"]).join(b, ["gene_id", "comp_cs"]).withColumn("same_top_variant", F.col("ref_top") == F.col("comp_top"))


def match_sets(ref: DataFrame, comp: DataFrame) -> DataFrame:
    """A17 (overlap): mutually best sets of a gene by Jaccard of their members (ties: lower index)."""
    a = ref.select("gene_id", F.col("effect").alias("ref_cs"), "variant_key")
    b = comp.select("gene_id", F.col("effect").alias("comp_cs"), "variant_key")
    na, nb = a.groupBy("gene_id", "ref_cs").agg(F.count("*").alias("na")), b.groupBy("gene_id", "comp_cs").agg(F.count("*").alias("nb"))
    both = a.join(b, ["gene_id", "variant_key"]).groupBy("gene_id", "ref_cs", "comp_cs").agg(F.count("*").alias("shared"))
    j = both.join(na, ["gene_id", "ref_cs"]).join(nb, ["gene_id", "comp_cs"]).withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    r1 = F.row_number().over(Window.partitionBy("gene_id", "ref_cs").orderBy(F.desc("jaccard"), "comp_cs"))
    r2 = F.row_number().over(Window.partitionBy("gene_id", "comp_cs").orderBy(F.desc("jaccard"), "ref_cs"))
    return j.withColumns({"r1": r1, "r2": r2}).where("r1 = 1 and r2 = 1").select("gene_id", "ref_cs", "comp_cs", "shared", "jaccard")


def coloc_pp(a: DataFrame, b: DataFrame, p1: float = 1e-4, p2: float = 1e-4, p12: float = 5e-6, least: int = 10, scope: list[str] = ["gene_id"]) -> DataFrame:  # noqa: B006
    """Posterior of H0..H4 per scope (a gene) and pair of effects over shared variants, and each side's lead variant. Columns: scope, effect, variant_key, lbf."""
    j = a.select(*scope, F.col("effect").alias("effect1"), "variant_key", F.col("lbf").alias("l1")).join(
        b.select(*scope, F.col("effect").alias("effect2"), "variant_key", F.col("lbf").alias("l2")), [*scope, "variant_key"])
    keys = [*scope, "effect1", "effect2"]
    hit = lambda x: F.min_by("variant_key", F.struct(-F.col(x), "variant_key"))
    m = j.groupBy(*keys).agg(F.max("l1").alias("m1"), F.max("l2").alias("m2"), F.max(F.col("l1") + F.col("l2")).alias("m12"), F.count("*").alias("nsnps"), hit("l1").alias("hit1"), hit("l2").alias("hit2"))
    m = m.where(F.col("nsnps") >= least)
    s = j.join(m, keys).groupBy(*keys, "nsnps", "hit1", "hit2", "m1", "m2", "m12").agg(*[F.sum(F.exp(x - F.col(f"m{n}"))).alias(f"s{n}") for n, x in (("1", F.col("l1")), ("2", F.col("l2")), ("12", F.col("l1") + F.col("l2")))])
    e = {n: F.col(f"m{n}") + F.log(f"s{n}") for n in ("1", "2", "12")}
    s = s.withColumns({"h1": e["1"] + F.log(F.lit(p1)), "h2": e["2"] + F.log(F.lit(p2)), "h4": e["12"] + F.log(F.lit(p12)), "d": e["12"] - e["1"] - e["2"]})
    h3 = F.log(F.lit(p1)) + F.log(F.lit(p2)) + e["1"] + e["2"] + F.log(F.greatest(1 - F.exp("d"), F.lit(1e-300)))
    s = s.withColumn("h3", h3).withColumn("top", F.greatest(F.lit(0.0), "h1", "h2", "h3", "h4"))
    total = F.exp(-F.col("top")) + sum((F.exp(F.col(h) - F.col("top")) for h in ("h1", "h2", "h3", "h4")), F.lit(0.0))
    return s.withColumn("_t", total).select(*keys, "nsnps", "hit1", "hit2", (F.exp(-F.col("top")) / F.col("_t")).alias("pp_h0"), *[(F.exp(F.col(f"h{k}") - F.col("top")) / F.col("_t")).alias(f"pp_h{k}") for k in (1, 2, 3, 4)])


def average_precision(df: DataFrame, keys: list[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """Sum over score steps of recall gain times precision; tied scores are one step; one class gives null.

    Steps are written once and cut at 255 quantiles of their key's scores: running sums are taken within a range of scores, and the
    ranges' totals, at most 256 a key, are summed on top, so a pooled curve is not one task's work.
    """
    w = F.lit(1.0) if weight is None else weight
    steps = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(*keys, score).agg(F.sum(w * F.col(label)).alias("tp"), F.sum(w).alias("n"))
    steps = written(steps, "precision-steps")
    quantiles = F.percentile_approx(score, [k / 256 for k in range(1, 256)], 10_000)
    steps = steps.join(steps.groupBy(*keys).agg(quantiles.alias("_cuts")), keys) if keys else steps.withColumn("_cuts", steps.agg(quantiles).scalar())
    steps = steps.withColumn("_range", F.size(F.filter("_cuts", lambda c: c > F.col(score)))).drop("_cuts")
    ranges = steps.groupBy(*keys, "_range").agg(F.sum("tp").alias("_tp"), F.sum("n").alias("_n"))
    above = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "_range", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(c) for c in ("_tp", "_n")])
    down = Window.partitionBy(*keys, "_range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.join(ranges, [*keys, "_range"]).withColumns({"ctp": F.sum("tp").over(down) + F.col("_tp"), "cn": F.sum("n").over(down) + F.col("_n")})
    return steps.groupBy(*keys).agg(F.when((F.sum("tp") > 0) & (F.sum("tp") < F.sum("n")), F.sum(F.col("tp") * F.col("ctp") / F.col("cn")) / F.sum("tp")).alias("ap"), F.sum("n").alias("n"), F.sum("tp").alias("n_pos"))


def top_n(df: DataFrame, ranking: list[str], score: str, key: list[str], n: int, baseline: DataFrame | None = None) -> DataFrame:
    """K1: the n best rows of each ranking among the keys of the baseline (all, if none is given); ties by key.

    A ranking is cut to the n best of each of its slices (by a hash of the key) first, so that no task sorts it whole.
    """
    if baseline is not None:
        df = df.join(baseline.select(*key), key, "left_semi")
    best = lambda *within: F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(score), *key))
    part = df.withColumn("_slice", F.pmod(F.xxhash64(*key), F.lit(64)))
    part = part.withColumn("rank", best(*ranking, "_slice")).where(F.col("rank") <= n).drop("_slice")
    return part.withColumn("rank", best(*ranking)).where(F.col("rank") <= n)


def hashed_slot(strata: list[str]) -> Callable[[Column, Column], Column]:
    """The default draw of sample_negatives: a hash of the stratum and the draw's number."""
    return lambda i, n: F.pmod(F.xxhash64(*strata, i, F.lit(42)), n)


def sample_negatives(pos: DataFrame, neg: DataFrame, strata: list[str], order: list[Column], per: int = 10, slot: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """K3: per stratum n_pos * per negatives, in an order that is fixed by the rows' keys.

    A stratum with fewer draws with replacement: draw i (from 1) takes the row at slot(i, n) of that order, a pseudo-random place
    from 0 to n-1, and rows drawn twice count once, so of n rows about n (1 - exp(-draws / n)) stay. The draws are a table
    of their own, one row a draw, joined by stratum and place.
    """
    slot = slot or hashed_slot(strata)
    need = pos.groupBy(*strata).agg((F.count("*") * per).alias("_need"))
    have = neg.groupBy(*strata).agg(F.count("*").alias("_n")).join(need, strata)
    draws = have.where("_n < _need").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_need"))))
    draws = draws.select(*strata, (slot(F.col("_i"), F.col("_n")) + 1).alias("_r"), F.lit(True).alias("_drawn")).distinct()
    ranked = neg.join(have, strata).withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))
    taken = ranked.join(draws, [*strata, "_r"], "left").where(F.when(F.col("_n") >= F.col("_need"), F.col("_r") <= F.col("_need")).otherwise(F.col("_drawn")))
    return taken.select(*neg.columns)


def threshold_sweep(df: DataFrame, score: str, cuts: list[float]) -> DataFrame:
    """M8: long annotation of keys above each cut."""
    c = F.explode(F.array(*[F.lit(x) for x in cuts])).alias("cut")
    return max_over_genes(df, score).select("*", c).where(F.col(score) > F.col("cut"))


def other_genes(a: DataFrame, b: DataFrame, drop: DataFrame, one_study: bool) -> DataFrame:
    """Rows (with `study` 1 or 2) of the genes that a or b has and `drop` has not; one_study: only of genes that one of the two has alone."""
    both = a.withColumn("study", F.lit(1)).unionByName(b.withColumn("study", F.lit(2)))
    flags = both.groupBy("gene_id").agg(F.countDistinct("study").alias("_n"))
    genes = (flags.where("_n = 1") if one_study else flags).join(drop.select("gene_id").distinct(), "gene_id", "left_anti")
    return both.join(genes.select("gene_id"), "gene_id", "left_semi")


def unique_variants(tables: list[DataFrame]) -> DataFrame:
    """The distinct variants of several analyses."""
    return reduce(DataFrame.unionByName, [t.select(*ALLELES) for t in tables]).distinct()


def gene_list_union(lists: list[DataFrame]) -> DataFrame:
    """One row per gene with the number (from 1) of the first list that has it."""
    every = reduce(DataFrame.unionByName, [d.select("gene_id", F.lit(k + 1).alias("source")) for k, d in enumerate(lists)])
    return every.groupBy("gene_id").agg(F.min("source").alias("source"))


def positives(df: DataFrame, split: str = "train") -> DataFrame:
    """U4: the positives of a split. test: pip of at least 0.9; train_restricted: over 0.90 in a set; train: members over 0.05 of sets with a row over 0.10, and rows over 0.50 outside sets."""
    if split == "test":
        return df.where("pip >= 0.9")
    if split == "train_restricted":
        return df.where("pip > 0.90 and cs95 >= 1")
    if split != "train":
        raise ValueError(f"no such split: {split}")
    top = df.where("cs95 >= 1").groupBy("cell", "gene_id", "cs95").agg(F.max("pip").alias("top")).where("top > 0.10").drop("top")
    return df.where("cs95 > 0 and pip > 0.05").join(top, ["cell", "gene_id", "cs95"], "left_semi").select(df.columns).union(df.where("cs95 = 0 and pip > 0.50"))


def credible_set_keys(members: DataFrame, prior: str, cuts: list[float]) -> DataFrame:
    """Distinct members of sets, per prior and cut the keys whose best pip exceeds it. members: prior, alleles, pip (rows of sets only)."""
    best = members.groupBy(prior, *ALLELES).agg(F.max("pip").alias("_p"))
    return best.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts]))).where(F.col("_p") > F.col("cut")).drop("_p")


def loco_folds(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    """M5: each chromosome as a fold: rows held out and trained on, and the parity that gives its configuration (the other parity's search)."""
    n = df.groupBy(chrom).agg(F.count("*").alias("n_held"))
    number = F.regexp_replace(chrom, "^chr", "").cast("int")
    return n.withColumns({"n_train": df.agg(F.count("*")).scalar() - F.col("n_held"), "config_parity": (number + 1) % 2})
