"""Colocalization tables: shared-variant products, credible-set metrics, association at lead variants, members of both sides, priors from variances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.functions.keys import canonical_key, neglog10p


def first_of(value, *order) -> Column:
    """The value (a column or several) of the row that comes first by `order`."""
    return F.min_by(F.struct(*value) if isinstance(value, (list, tuple)) else value, F.struct(*order))


def shared_products(eqtl: DataFrame, gwas: DataFrame) -> DataFrame:
    """Variants that two fits of a gene share, with the product of their pips. eqtl: cell, eqtl_prior, gene_id, key, pip, in_cs; gwas: gwas_prior, gene_id, key, pip."""
    e = eqtl.select("cell", "eqtl_prior", "gene_id", "key", F.col("pip").alias("eqtl_pip"), F.coalesce("in_cs", F.lit(False)).alias("in_cs"))
    return e.join(gwas.select("gwas_prior", "gene_id", "key", F.col("pip").alias("gwas_pip")), ["gene_id", "key"]).withColumn("product", F.col("eqtl_pip") * F.col("gwas_pip"))


def clpp(eqtl: DataFrame, gwas: DataFrame) -> DataFrame:
    """A10: per GWAS prior, cell, eQTL prior and gene the summed and largest product, the same in credible sets (null without members), and the top variant with both pips."""
    inside = F.when(F.col("in_cs"), F.col("product"))
    top = first_of(["key", "eqtl_pip", "gwas_pip"], -F.col("product"), "key")
    g = shared_products(eqtl, gwas).groupBy("gwas_prior", "cell", "eqtl_prior", "gene_id").agg(
        F.count("*").alias("n_shared"), F.sum("product").alias("clpp"), F.coalesce(F.sum(inside), F.lit(0.0)).alias("clpp_cs"), F.max("product").alias("max_product"),
        F.max(inside).alias("max_product_cs"), F.count_if("in_cs").alias("n_cs_variants"), top.alias("_top"))
    return g.select("*", F.col("_top.key").alias("top_variant"), F.col("_top.eqtl_pip").alias("eqtl_pip_at_top"), F.col("_top.gwas_pip").alias("gwas_pip_at_top")).drop("_top")


def clpp_variants(eqtl: DataFrame, gwas: DataFrame, cut: float = 0.1) -> DataFrame:
    """A10: the variants whose product exceeds the cut."""
    return shared_products(eqtl, gwas).where(F.col("product") > cut)


def clpp_gene(rows: DataFrame) -> DataFrame:
    """A gene's largest product over cells, per GWAS and eQTL prior."""
    return rows.groupBy("gwas_prior", "eqtl_prior", "gene_id").agg(F.max("max_product").alias("clpp_ems"))


def clpp_counts(genes: DataFrame, eqtl_priors: list[str], cut: float = 0.1) -> DataFrame:
    """Genes above the cut, GWAS priors by eQTL priors (one column each, 0 where none)."""
    n = [F.count_if((F.col("eqtl_prior") == p) & (F.col("clpp_ems") > cut)).alias(p) for p in eqtl_priors]
    return genes.groupBy("gwas_prior").agg(*n)


#: What a colocalization carries of its credible set.
SET_METRICS = {"size": "cs_size", "cs_rank": "cs_rank", "coverage": "cs_coverage", "purity": "cs_min_abs_corr", "lbf": "cs_lbf", "top_pip": "cs_top_pip", "top_variant": "cs_top_variant_id"}


def coloc_with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Colocalization pairs with the metrics of their first credible set, the parts of both hits (chr:pos:a1:a2) and whether these are one variant.

    A pair without a set stays, marked unmatched. sets: gene_id, effect and those of SET_METRICS that the caller has. Two rows of one
    set stop the job where they are met, since the join would multiply pairs; so does a hit without a position.
    """
    have = {c: n for c, n in SET_METRICS.items() if c in sets.columns}
    twice = F.raise_error(F.concat(F.lit("two rows of credible set "), F.col("effect1").cast("string"), F.lit(" of "), F.col("gene_id"))).cast("int")
    s = sets.groupBy("gene_id", F.col("effect").alias("effect1")).agg(F.count("*").alias("_n"), F.first(F.struct(*have)).alias("_s"))
    s = s.where(F.when(F.col("_n") == 1, 1).otherwise(twice) == 1).select("gene_id", "effect1", *[F.col(f"_s.{c}").alias(n) for c, n in have.items()], F.lit(True).alias("_matched"))
    d = pairs.join(s, ["gene_id", "effect1"], "left")
    part = lambda h, i: F.get(F.split(h, ":"), F.lit(i))
    for h in ("hit1", "hit2"):
        pos = part(h, 1).try_cast("bigint")
        lost = F.raise_error(F.concat(F.lit("no position in "), F.coalesce(h, F.lit("null")))).cast("bigint")
        d = d.withColumns({f"{h}_chr": F.regexp_replace(part(h, 0), "^chr", "").try_cast("int"), f"{h}_pos": F.coalesce(pos, lost), f"{h}_a1": part(h, 2), f"{h}_a2": part(h, 3)})
    return d.withColumns({"same_hit": F.col("hit1") == F.col("hit2"), "unmatched": F.col("_matched").isNull()}).drop("_matched")


def unmatched_pairs(rows: DataFrame) -> DataFrame:
    """Pairs, and those without a set, which the caller may warn of."""
    return rows.agg(F.count("*").alias("n_pairs"), F.count_if("unmatched").alias("n_unmatched"))


def gwas_at_keys(gwas: DataFrame) -> DataFrame:
    """Per key the largest -log10 p, z of the largest |z|, and maf and rsid of the first record. gwas: chr, pos, ref, alt, z, maf, rsid, record_no."""
    key = canonical_key(F.col("chr"), F.col("pos"), F.col("ref"), F.col("alt"), upper=True)
    return gwas.groupBy(key.alias("key")).agg(F.max(neglog10p(F.col("z"))).alias("neglog10p"), F.max_by("z", F.struct(F.abs("z"), "z")).alias("z"), first_of("maf", "record_no").alias("maf"), first_of("rsid", "record_no").alias("rsid"))


def gwas_at_hits(pairs: DataFrame, gwas: DataFrame, cut: float = 0.8) -> DataFrame:
    """Pairs with the GWAS association of both lead variants, and whether they colocalize (PP.H4 over the cut)."""
    at = gwas_at_keys(gwas)
    d = pairs
    for h in ("hit1", "hit2"):
        d = d.join(at.select(F.col("key").alias(h), *[F.col(c).alias(f"{h}_{c}") for c in ("neglog10p", "z", "maf", "rsid")]), h, "left")
    return d.withColumn("colocalized", F.col("pp_h4") > cut)


def expand_credible_sets(pairs: DataFrame, eqtl: DataFrame, gwas: DataFrame, names: DataFrame | None = None, gwas_stats: DataFrame | None = None, marginal: DataFrame | None = None) -> DataFrame:
    """Each colocalization's member rows of both sides.

    pairs: cell, eqtl_prior, gwas_prior, gene_id, idx1, idx2, pp_h4, hit1, hit2; eqtl: cell, eqtl_prior, gene_id, cs_idx, key, pip;
    gwas: gwas_prior, gene_id, cs_idx, key, pip. Added where given: gene names (gene_id, gene_name; else the id), gwas_stats (key,
    neglog10p, rsid), marginal (cell, gene_id, key, slope, se, z, neglog10p). y is the pip, mirrored on the eQTL side; one_sided marks
    colocalizations of which only one side has members.
    """
    ident = F.concat_ws("|", "cell", "eqtl_prior", "gwas_prior", "gene_id", F.concat(F.lit("cs"), F.col("idx1").cast("string"), F.lit("-"), F.col("idx2").cast("string")))
    p = pairs.select(ident.alias("coloc_id"), "cell", "eqtl_prior", "gwas_prior", "gene_id", "idx1", "idx2", "pp_h4", "hit1", "hit2")
    e = p.withColumn("cs_idx", F.col("idx1")).join(eqtl.select("cell", "eqtl_prior", "gene_id", "cs_idx", "key", "pip"), ["cell", "eqtl_prior", "gene_id", "cs_idx"])
    g = p.withColumn("cs_idx", F.col("idx2")).join(gwas.select("gwas_prior", "gene_id", "cs_idx", "key", "pip"), ["gwas_prior", "gene_id", "cs_idx"])
    e = e.withColumns({"side": F.lit("eqtl"), "is_coloc_lead": F.col("key") == F.col("hit1"), "y": -F.col("pip")})
    g = g.withColumns({"side": F.lit("gwas"), "is_coloc_lead": F.col("key") == F.col("hit2"), "y": F.col("pip")})
    d = e.unionByName(g).drop("hit1", "hit2")
    side, whole = Window.partitionBy("coloc_id", "side"), Window.partitionBy("coloc_id")
    d = d.withColumns({"cs_size_side": F.count("*").over(side), "pip_rank": F.row_number().over(side.orderBy(F.desc("pip"), "key")), "one_sided": F.min("side").over(whole) == F.max("side").over(whole)})
    d = d.withColumn("is_top_pip", F.col("pip_rank") == 1)
    if names is not None:
        d = d.join(names.groupBy("gene_id").agg(F.min("gene_name").alias("gene_name")), "gene_id", "left").withColumn("gene_name", F.coalesce(F.nullif("gene_name", F.lit("")), "gene_id"))
    else:
        d = d.withColumn("gene_name", F.col("gene_id"))
    if gwas_stats is not None:
        d = d.join(gwas_stats.select("key", F.col("neglog10p").alias("gwas_neglog10p"), "rsid"), "key", "left")
    if marginal is not None:
        key = ["cell", "gene_id", "key"]
        m = marginal.dropDuplicates(key).select(*key, *[F.col(c).alias(f"eqtl_{c}") for c in ("slope", "se", "z", "neglog10p")])
        d = d.join(m, key, "left")
    return d


def snpvar_prior(variants: DataFrame, windows: DataFrame, snpvar: DataFrame) -> DataFrame:
    """Prior of each variant of a gene (gene_id, key): the variance of its key in the gene's window (first record), the least of the gene where missing, as a share of the gene's sum.

    A gene without any match gets even weights. windows: gene_id, chr, start_pos, end_pos (inclusive); snpvar: chr, pos, a1, a2, snpvar, record_no.
    Records of a key share its position, so the first of them stands for all, and only keys that a gene asks for meet its windows: no
    row stands for a record that merely lies in a window.
    """
    first = snpvar.groupBy("chr", "pos", canonical_key(F.col("chr"), F.col("pos"), F.col("a1"), F.col("a2")).alias("key")).agg(first_of(["snpvar", "record_no"], "record_no").alias("_r"))
    asked = variants.select("gene_id", "key").distinct()
    found = asked.join(first, "key").join(windows.select("gene_id", "chr", "start_pos", "end_pos"), ["gene_id", "chr"]).where("pos between start_pos and end_pos")
    one = found.groupBy("gene_id", "key").agg(first_of("_r.snpvar", "_r.record_no").alias("_v"))
    j = asked.join(one, ["gene_id", "key"], "left")
    g = Window.partitionBy("gene_id")
    j = j.withColumn("_s", F.coalesce("_v", F.min("_v").over(g), F.lit(1.0)))
    return j.withColumn("prior", F.col("_s") / F.sum("_s").over(g)).drop("_s", "_v")


def coloc_notes(a: DataFrame, b: DataFrame, least: int = 10) -> DataFrame:
    """The genes of `a` without a test, and why: no fit on the other side, or fewer shared variants than `least`. Columns: gene_id, variant_key."""
    x, y = a.select("gene_id", "variant_key").distinct(), b.select("gene_id", "variant_key").distinct()
    n = x.join(y, ["gene_id", "variant_key"]).groupBy("gene_id").agg(F.count("*").alias("n_shared"))
    j = x.select("gene_id").distinct().join(y.select("gene_id", F.lit(True).alias("_b")).distinct(), "gene_id", "left").join(n, "gene_id", "left")
    j = j.withColumn("n_shared", F.coalesce("n_shared", F.lit(0))).where(F.col("n_shared") < least)
    return j.select("gene_id", "n_shared", F.when(F.col("_b").isNull(), "no fit on the other side").otherwise("too few shared variants").alias("note"))
