"""Orientation against a reference sequence, score lookup, track summaries, the feature list and its categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.operators.joins import ALLELES
from locusframe.sources.shared import written

# Names that trained models expect, in their order.
GROUPS = ["distance", "ABC", "celltype", "baseline", "chrombpnet_positive", "diff", "tf_positive"]
VARIANT_FEATURES = ["length_diff", "is_SNP", "is_indel", "is_insertion", "is_deletion", "gene_lof", "gnomad_MAF"]
ABSOLUTE_GROUPS = ["diff", "tf_positive", "chrombpnet_positive"]
NOT_FEATURES = ["abs_distance_TSS", "distance_TSS"]
CATEGORY_OF_GROUP = {"celltype": "CRE", "diff": "Enformer", "chrombpnet_positive": "chromBPNet", "ABC": "ABC", "tf_positive": "TF", "baseline": "baseline", "distance": "distance"}
CATEGORY_OF_NAME = {"gpn_star_llr": "abs_gpn", "gene_lof": "gene_lof", "gnomad_MAF": "gnomad_MAF", "is_SNP": "variant_type", "is_indel": "variant_type",
                    "is_insertion": "variant_type", "is_deletion": "variant_type", "length_diff": "variant_type"}
#: Where a feature is listed in several groups, the later category of this order holds.
CATEGORY_ORDER = ["distance", "baseline", "CRE", "Enformer", "chromBPNet", "ABC", "TF"]


def sequence_at(df: DataFrame, tiles: DataFrame, width: int, first: Column, name: str) -> DataFrame:
    """df with `name`: the reference sequence from 1-based position `first` (column chr) to the end of the next tile; null where there is none.

    tiles (chr, tile, seq): tile t holds positions t * width + 1 to (t + 1) * width. Each tile takes the head of the next one by
    one aggregate on its key, so that a row needs a single equi-join; sequences shorter than width + 1 are always whole.
    """
    both = tiles.select("chr", "tile", F.col("seq").alias("_own"), F.lit(None).cast("string").alias("_next")).union(
        tiles.select("chr", F.col("tile") - 1, F.lit(None).cast("string"), "seq"))
    both = both.groupBy("chr", "tile").agg(F.max("_own").alias("_own"), F.max("_next").alias("_next")).where("_own is not null")
    at = df.withColumn("_first", first).withColumn("tile", F.floor((F.col("_first") - 1) / width))
    text = F.upper(F.concat("_own", F.coalesce("_next", F.lit(""))))
    got = at.join(both, ["chr", "tile"], "left").withColumn(name, F.substr(text, (F.col("_first") - F.col("tile") * width).cast("int")))
    return got.drop("_first", "tile", "_own", "_next")


def orient_to_reference(variants: DataFrame, tiles: DataFrame, width: int) -> DataFrame:
    """`orient` is ref where REF is the reference sequence, else swap where ALT is (REF and ALT change places), else none."""
    d = sequence_at(variants, tiles, width, F.col("pos"), "_s")
    is_ref, is_alt = F.col("_s").startswith(F.col("ref")), F.col("_s").startswith(F.col("alt"))
    d = d.withColumn("orient", F.when(is_ref, "ref").when(is_alt, "swap").otherwise("none"))
    swap = F.col("orient") == "swap"
    return d.withColumns({"ref": F.when(swap, F.col("alt")).otherwise(F.col("ref")), "alt": F.when(swap, F.col("ref")).otherwise(F.col("alt"))}).drop("_s")


def llr_lookup(variants: DataFrame, training: DataFrame, scores: DataFrame, neutral: DataFrame, tiles: DataFrame, width: int) -> DataFrame:
    """Score and source of every single-base variant; others, and those without a score, have null and `none`.

    training (alleles, llr) under either orientation, the swapped one with its sign turned; else scores (alleles, llr) plus the
    neutral mean of the five bases around the position and the new base: neutral (context 'ACGTA_C', llr). Both orientations
    of training scores and scores share one row of the key, so they cost one join.
    """
    key = ["chr", "pos", "_lo", "_hi"]
    keyed = lambda d: d.withColumns({"_lo": F.least("ref", "alt"), "_hi": F.greatest("ref", "alt")})
    up = F.col("ref") == F.col("_lo")
    of = {"_up": ("t", up), "_down": ("t", ~up), "_s_up": ("s", up), "_s_down": ("s", ~up)}
    listed = training.select(*ALLELES, "llr", F.lit("t").alias("_k")).union(scores.select(*ALLELES, "llr", F.lit("s")))
    known = keyed(listed).groupBy(*key).agg(*[F.min(F.when((F.col("_k") == k) & side, F.col("llr"))).alias(n) for n, (k, side) in of.items()])
    v = keyed(variants).join(known, key, "left")
    own, other = F.when(up, F.col("_up")).otherwise(F.col("_down")), F.when(up, F.col("_down")).otherwise(F.col("_up"))
    v = v.withColumns({"_t": F.coalesce(own, -other), "_s": F.when(up, F.col("_s_up")).otherwise(F.col("_s_down"))}).drop("_lo", "_hi", *of)
    single = (F.length("ref") == 1) & (F.length("alt") == 1)
    # Only a variant with a score of its own and none of training needs its bases.
    v = written(v.withColumn("_ask", F.coalesce(single & F.col("_t").isNull() & F.col("_s").isNotNull(), F.lit(False))), "lookup-variants")
    asked, tile = v.where("_ask"), F.floor((F.col("pos") - 3) / width)
    near = asked.select("chr", F.explode(F.array(tile, tile + 1)).alias("tile")).distinct()
    asked = sequence_at(asked, tiles.join(near, ["chr", "tile"], "left_semi"), width, F.col("pos") - 2, "_around")
    asked = asked.withColumn("context", F.concat(F.substring("_around", 1, 5), F.lit("_"), "alt")).join(neutral.groupBy("context").agg(F.min("llr").alias("_n")), "context", "left")
    v = asked.drop("context", "_around").unionByName(v.where("not _ask").withColumn("_n", F.lit(None).cast("double")))
    second = F.col("_s") + F.col("_n")
    out = v.withColumns({"gpn_star_llr": F.when(single, F.coalesce("_t", second)),
                         "source": F.when(single & F.col("_t").isNotNull(), "training").when(single & second.isNotNull(), "scores").otherwise("none")})
    return out.drop("_ask", "_t", "_s", "_n")


def tf_summary(long: DataFrame, lists: DataFrame, keys: list[str], track: str = "track", value: str = "v") -> DataFrame:
    """A4: per key and cell, over the cell's tracks: largest, smallest and largest absolute value, and the largest truncated toward 0 (tf_composite). lists: cell, track."""
    j = long.join(lists.select("cell", track).distinct(), track)
    return j.groupBy(*keys, "cell").agg(F.max(value).alias("tf_max"), F.min(value).alias("tf_min"), F.max(F.abs(value)).alias("tf_max_abs"), F.max(value).cast("int").alias("tf_composite"))


def select_features(dictionary: DataFrame, present: DataFrame) -> DataFrame:
    """Feature, place, is_abs of the features present, in order: groups, then the variant features. dictionary: grp, position, feature.

    Names only, so the one window over all of them is small by nature.
    """
    group_no = reduce(lambda c, k: c.when(F.col("grp") == GROUPS[k], k), range(1, len(GROUPS)), F.when(F.col("grp") == GROUPS[0], 0))
    d = dictionary.withColumn("_g", group_no).where("_g is not null").groupBy("feature").agg(
        F.min(F.struct("_g", "position")).alias("_at"), F.max(F.col("grp").isin(ABSOLUTE_GROUPS)).alias("is_abs"))
    fixed = F.array_position(F.array(*map(F.lit, VARIANT_FEATURES)), F.col("feature"))
    names = present.select("feature").distinct().where(~F.col("feature").isin(NOT_FEATURES))
    j = names.join(d, "feature", "left").withColumn("_v", fixed).where("_at is not null or _v > 0")
    place = F.row_number().over(Window.orderBy(F.coalesce(F.col("_at._g"), F.lit(len(GROUPS))), F.coalesce(F.col("_at.position").cast("long"), F.col("_v")), "feature"))
    return j.select("feature", place.alias("place"), F.coalesce("is_abs", F.lit(False)).alias("is_abs"))


def category_of(features: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every feature with exactly one category; `other` where no rule names it."""
    named = F.create_map(*[F.lit(x) for kv in CATEGORY_OF_NAME.items() for x in kv])
    grouped = F.create_map(*[F.lit(x) for kv in CATEGORY_OF_GROUP.items() for x in kv])
    order = F.array(*map(F.lit, CATEGORY_ORDER))
    of = dictionary.withColumn("_c", grouped[F.col("grp")]).where("_c is not null").groupBy("feature").agg(F.max(F.array_position(order, F.col("_c"))).alias("_p"))
    j = features.select("feature").distinct().join(of, "feature", "left")
    return j.select("feature", F.coalesce(named[F.col("feature")], F.get(order, (F.col("_p") - 1).cast("int")), F.lit("other")).alias("category"))


def category_attribution(long: DataFrame, categories: DataFrame, keys: list[str], cut: float) -> DataFrame:
    """Per key and category the summed absolute attribution of the rows whose score exceeds the cut. long: keys, score, feature, attribution."""
    return long.where(F.col("score") > cut).join(categories, "feature").groupBy(*keys, "category").agg(F.sum(F.abs("attribution")).alias("attribution"))


def ems_rows(ems: DataFrame, order: list[Column]) -> DataFrame:
    """One row per variant and gene, the first by `order`."""
    w = Window.partitionBy("variant_id", "gene_id").orderBy(*order)
    return ems.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ems_baseline(rows: DataFrame) -> DataFrame:
    """p_random, the mean of ems / ems_normalized."""
    return rows.agg(F.avg(F.try_divide("ems", "ems_normalized")).alias("p_random"))


def ems_coverage(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Per gene the variants of its window, how many have a score, and their share. windows: gene_id, variant_id."""
    j = windows.select("gene_id", "variant_id").distinct().join(rows.select("gene_id", "variant_id", "ems"), ["gene_id", "variant_id"], "left")
    return j.groupBy("gene_id").agg(F.count("*").alias("n_in_window"), F.count("ems").alias("n_with_ems")).withColumn("coverage", F.col("n_with_ems") / F.col("n_in_window"))
