"""Linkage disequilibrium by blocks (A31, A32) and marginal regression of all cells at once (A30): packed dosages, one matrix product a block pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.functions.keys import neglog10p
from locusframe.sources.shared import written

PAIRS = "chr string, key1 {0}, key2 {0}, pos1 bigint, pos2 bigint, r double"


def sample_order(samples: DataFrame) -> Column:
    """The distinct sample_ids of a table, sorted, as one value: the order of every packed array. A cohort is some thousands, whatever the number of variants."""
    return samples.agg(F.sort_array(F.collect_set("sample_id"))).scalar()


def entries(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key with `_m`, a map from sample to value."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("sample_id", F.col(value).cast("double").alias("v")))).alias("_m"))


def ordered(one: DataFrame, keys: list[str], samples: Column, name: str) -> DataFrame:
    """Of `_m` the values in the order of the samples; null where a sample has none."""
    return one.withColumn("_all", samples).select(*keys, F.transform("_all", lambda s: F.try_element_at("_m", s)).alias(name))


def _values(t: pa.Table, name: str) -> np.ndarray:
    """A column of arrays of one length as a matrix; null is NaN."""
    return t[name].combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(t), -1)


def to_bytes(v: np.ndarray) -> list[bytes]:
    """Rows of dosages (NaN: not typed): 2 bits a sample where a row has 0, 1, 2 and missing only, else doubles. The first byte says which."""
    missing = np.isnan(v)
    calls = (missing | (v == 0) | (v == 1) | (v == 2)).all(1)
    c = np.where(calls[:, None], np.where(missing, 3, v), 3).astype(np.uint8)
    c = np.pad(c, ((0, 0), (0, -c.shape[1] % 4)), constant_values=3)
    c = c[:, ::4] | c[:, 1::4] << 2 | c[:, 2::4] << 4 | c[:, 3::4] << 6
    return [b"\x02" + c[i].tobytes() if calls[i] else b"\x40" + v[i].tobytes() for i in range(len(v))]


_CALLS = np.array([[(0.0, 1.0, 2.0, np.nan)[b >> s & 3] for s in (0, 2, 4, 6)] for b in range(256)])


def from_bytes(rows) -> np.ndarray:
    """The dosages of to_bytes; samples beyond the last are NaN, at most three."""
    if len(rows) and all(r[0] == 2 for r in rows):
        return _CALLS[np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)[:, 1:]].reshape(len(rows), -1)
    each = [_CALLS[np.frombuffer(r, np.uint8, offset=1)].ravel() if r[0] == 2 else np.frombuffer(r, offset=1) for r in rows]
    out = np.full((len(each), max(map(len, each), default=0)), np.nan)
    for k, r in enumerate(each):
        out[k, : len(r)] = r
    return out


def packed(geno: DataFrame, keys: list[str], samples: Column) -> DataFrame:
    """One row per key with `d`, its dosages in the order of the samples as bytes (to_bytes)."""
    one = entries(geno, keys, "dosage").select(*keys, F.map_keys("_m").alias("_s"), F.map_values("_m").alias("_v"), samples.alias("_all"))

    def run(batches):
        for b in batches:
            if len(b):
                order, ids = b["_all"][0].values, b["_s"]
                v = np.full((len(b), len(order)), np.nan)
                at = pc.index_in(ids.flatten(), value_set=order).to_numpy()
                v[np.repeat(np.arange(len(b)), np.diff(ids.offsets.to_numpy())), at] = b["_v"].flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*[b[k] for k in keys], pa.array(to_bytes(v), pa.binary())], names=[*keys, "d"])

    return one.mapInArrow(run, ", ".join(f"{k} {one.schema[k].dataType.simpleString()}" for k in keys) + ", d binary")


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """r of every row of a with every row of b over the samples typed in both (NaN: not typed); 0 where it is undefined."""
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    a, b, ma, mb = np.where(ma, a, 0), np.where(mb, b, 0), ma.astype(float), mb.astype(float)
    n, sa, sb = ma @ mb.T, a @ mb.T, ma @ b.T
    va, vb = n * ((a * a) @ mb.T) - sa**2, n * (ma @ (b * b).T) - sb**2
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (n * (a @ b.T) - sa * sb) / np.sqrt(va * vb)
    return np.where((va > 1e-9) & (vb > 1e-9), r, 0.0)


def _block_pair(w: int, least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one, two = rows[rows["side"] == 1], rows[rows["side"] == 2]
        same = bool(rows["same"].iloc[0])
        two = one if same else two
        out = pd.DataFrame({"chr": [], "key1": [], "key2": [], "pos1": [], "pos2": [], "r": []})
        if not len(one) or not len(two):
            return out
        if not same:  # only what may lie within w of the other side
            one, two = one[one["pos"] >= two["pos"].min() - w], two[two["pos"] <= one["pos"].max() + w]
            if not len(one) or not len(two):
                return out
        d = from_bytes([*one["d"], *two["d"]])
        r = correlations(d[: len(one)], d[len(one) :])
        p, q, k, l = one["pos"].to_numpy(), two["pos"].to_numpy(), one["variant_key"].to_numpy(), two["variant_key"].to_numpy()
        near = (np.abs(p[:, None] - q[None]) <= w) & (r * r >= least)
        if same:  # each pair once, not with itself
            near &= np.triu(np.ones(near.shape, bool), 1)
        i, j = np.nonzero(near)
        first = (p[i] < q[j]) | ((p[i] == q[j]) & (k[i] < l[j]))
        pick = lambda x, y: np.where(first, x, y)
        return pd.DataFrame({"chr": rows["chr"].iloc[0], "key1": pick(k[i], l[j]), "key2": pick(l[j], k[i]), "pos1": pick(p[i], q[j]), "pos2": pick(q[j], p[i]), "r": r[i, j]})

    return run


def ld_pairs(geno: DataFrame, w: int = 3_000_000, least: float = 0.001, block: int = 1024) -> DataFrame:
    """(chr, key1, key2, pos1, pos2, r) of variants of a chromosome at most w apart with r2 of at least `least`; an undefined r is 0 and has no row.

    geno: sample_id, chr, pos, variant_key, dosage (null: not typed). A variant is packed into one row. Variants fall into tiles of w
    bases, or, where variants lie far apart, of as many times w as keep the fullest tile to a quarter of a block, so that a product pays for its call;
    tiles into blocks of at most `block` variants by position; a block meets itself, the other blocks of its tile and those of
    the next tile, each once, as one task-sized matrix product, so a variant is copied once a block pair, never once a pair of variants.
    """
    one = written(packed(geno, ["chr", "pos", "variant_key"], sample_order(geno)), "ld-variants")
    fullest = one.groupBy("chr", F.floor(F.col("pos") / w)).agg(F.count("*").alias("n"))
    wide = fullest.agg(F.greatest(F.lit(1), F.floor(F.lit(block // 4) / F.max("n"))).cast("bigint")).scalar()
    one = one.withColumn("tile", F.floor(F.col("pos") / (F.lit(w).cast("bigint") * wide)).cast("bigint"))
    nth = F.row_number().over(Window.partitionBy("chr", "tile").orderBy("pos", "variant_key")) - 1
    one = one.withColumn("b", F.floor(nth / block).cast("bigint"))
    ends = one.groupBy("chr", "tile", "b").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    after = ends.select("chr", F.explode(F.array(F.col("tile"), F.col("tile") - 1)).alias("tile"), F.col("tile").alias("tile2"), F.col("b").alias("b2"), F.col("lo").alias("lo2"))
    pairs = ends.join(after, ["chr", "tile"]).where("(tile2 > tile or b2 >= b)").where(F.col("lo2") - F.col("hi") <= w)
    pairs = pairs.select("chr", "tile", "b", "tile2", "b2", F.expr("tile = tile2 and b = b2").alias("same"))
    sides = pairs.select("chr", "tile", "b", F.struct("tile", "b", "tile2", "b2").alias("pair"), "same", F.lit(1).alias("side")).union(
        pairs.where("not same").select("chr", F.col("tile2"), F.col("b2"), F.struct("tile", "b", "tile2", "b2"), "same", F.lit(2)))
    one = one.hint("merge")  # variants take many times their file in memory: not to be broadcast for the size of that
    placed = one.join(sides, ["chr", "tile", "b"]).select("chr", F.col("pair.tile").alias("t1"), F.col("pair.b").alias("b1"), F.col("pair.tile2").alias("t2"), F.col("pair.b2").alias("b2"), "same", "side", "pos", "variant_key", "d")
    schema = PAIRS.format(geno.schema["variant_key"].dataType.simpleString())
    return placed.groupBy("chr", "t1", "b1", "t2", "b2").applyInPandas(_block_pair(w, least), schema)


def ld_scores(pairs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per variant and annotation the sum of r2 over annotated neighbours (itself included). pairs: of ld_pairs; annotations: chr, key, annotation."""
    ways = F.array(*[F.struct(F.col(a).alias("key1"), F.col(b).alias("key")) for a, b in (("key1", "key2"), ("key2", "key1"))])
    both = pairs.withColumn("way", F.explode(ways)).select("chr", "way.key1", "way.key", "r")  # the pairs are made once
    own = annotations.select("chr", F.col("key").alias("key1"), "key", F.lit(1.0).alias("r")).distinct()
    return both.union(own).join(annotations, ["chr", "key"]).groupBy("chr", "key1", "annotation").agg(F.sum(F.col("r") ** 2).alias("ld_score"))


# --- marginal regression ---------------------------------------------------------------------------------------------


def single_phenotype(expr: DataFrame, keys: list[str] = ["gene_id", "sample_id"]) -> DataFrame:  # noqa: B006
    """One row per key (a gene and sample, of a cell); equal duplicates collapse, differing ones stop the job where they are met."""
    differ = F.raise_error(F.lit("co-located phenotypes differ")).cast("double")
    return expr.groupBy(*keys).agg(F.min("y").alias("_a"), F.max("y").alias("_b")).select(*keys, F.when(F.abs(F.col("_a") - F.col("_b")) > 1.5e-8 * F.abs("_a"), differ).otherwise(F.col("_a")).alias("y"))


def moments(x: np.ndarray, y: np.ndarray, cohort: np.ndarray, maf: float, mac: float, missing: float) -> dict[str, np.ndarray]:
    """Regressions of every row of y (phenotypes) on every row of x (dosages), NaN for missing; cohort: which samples each phenotype's cell has.

    Variants are checked within the cohort of the phenotype. Arrays are variants x phenotypes; `ok` marks rows of the result.
    """
    typed, seen = ~np.isnan(x), ~np.isnan(y)
    mean = np.where(seen.any(1), np.nansum(np.where(seen, y, 0), 1) / np.maximum(seen.sum(1), 1), 0)[:, None]
    x, y = np.where(typed, x, 0), np.where(seen, y - mean, 0)  # centred, so that moments keep their digits
    t, s, c = typed.astype(float), seen.astype(float), cohort.astype(float)
    called, alleles, size = t @ c.T, x @ c.T, c.sum(1)[None]
    minor = np.minimum(alleles, 2 * called - alleles)
    n, sx, sy, sxx, syy, sxy = t @ s.T, x @ s.T, t @ y.T, (x * x) @ s.T, t @ (y * y).T, x @ y.T
    with np.errstate(invalid="ignore", divide="ignore"):
        good = (called > 0) & (minor >= maf * 2 * called) & (minor >= mac) & (1 - called / size <= missing)
        vx, vy, vxy = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
        slope = vxy / vx
        se = np.sqrt(np.maximum(vy - slope * vxy, 0) / (n - 2) / vx)
    return {"slope": slope, "se": se, "n": n, "ok": good & (n > 2) & (vx > 1e-9)}


def _regress(maf: float, mac: float, missing: float, block: int):
    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        if len(x) and len(y):
            d, v, cohort = x["d"].to_numpy(), _values(y, "y"), _values(y, "cohort") > 0
            lists = x["genes"].combine_chunks()
            row, gene = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            by, nth = np.argsort(gene, kind="stable"), y["nth"].to_numpy()
            row, gene = row[by], gene[by]
            for g in np.unique(nth):
                at, rows = np.flatnonzero(nth == g), row[np.searchsorted(gene, g) : np.searchsorted(gene, g, "right")]
                for some in np.split(rows, range(block, len(rows), block)):
                    if len(some):
                        m = moments(from_bytes(d[some])[:, : v.shape[1]], v[at], cohort[at], maf, mac, missing)
                        i, j = np.nonzero(m["ok"])
                        out.append((some[i], at[j], m["slope"][i, j], m["se"][i, j], m["n"][i, j]))
        i, j, slope, se, n = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int),) * 5
        keys = [y["cell"].take(j), y["gene_id"].take(j), x["variant_key"].take(i)]
        return pa.table([*keys, slope.astype(float), se.astype(float), n.astype(np.int64)], names=["cell", "gene_id", "variant_key", "slope", "se", "n"])

    return run


def gene_groups(pairs: DataFrame, at_once: int) -> DataFrame:
    """Genes whose variants lie together, as groups of at_once pairs: gene_id, group, slices (of the group's variants, where one gene has more) and nth, its number.

    Genes go by their least variant_key, which for windows of a genome is their place. Which genes meet changes no result, so pairs
    may come twice here. The table is written, as places of a range are not the same if computed again.
    """
    g = pairs.groupBy("gene_id").agg(F.count("*").alias("n"), F.min("variant_key").alias("at"))
    g = g.repartitionByRange("at").withColumn("part", F.spark_partition_id())
    before = Window.partitionBy("part").orderBy("at", "gene_id").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("cut", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / at_once))
    group = Window.partitionBy("part", "cut")
    slices, nth = F.ceil(F.sum("n").over(group) / (2 * at_once)), F.row_number().over(group.orderBy("at", "gene_id"))
    return written(g.select("gene_id", F.struct("part", "cut").alias("group"), slices.alias("slices"), nth.alias("nth")), "regression-genes")


def marginal_regression(geno: DataFrame, expr: DataFrame, pairs: DataFrame, maf: float = 0.001, mac: int = 10, missing: float = 0.1, block: int = 1024, at_once: int = 1 << 18) -> DataFrame:
    """Slope, standard error, z and -log10 p of expression on dosage, per cell and pair of gene and variant.

    geno: sample_id, variant_key, dosage; expr: cell, gene_id, sample_id, y; pairs: gene_id, variant_key. A cell's cohort is the samples
    that it has any expression of; the checks on minor allele frequency, minor allele count and share of untyped samples hold within
    it. Pairs of fewer than 3 samples or without spread have no row. Samples without a dosage or an expression are left out of a fit.

    Dosages and expressions are packed by sample. Genes whose variants lie together form groups of about at_once pairs; a group gets the
    dosages of a variant once, 2 bits a sample, with the genes that ask for it, and every gene's variants, in blocks, meet its
    expressions of all cells in one product. So dosages are shuffled once a group, not once a pair, sample and cell.
    """
    pairs = written(pairs.select("gene_id", "variant_key"), "regression-pairs")
    y = written(entries(single_phenotype(expr, ["cell", "gene_id", "sample_id"]), ["cell", "gene_id"], "y"), "regression-phenotypes")
    order = sample_order(geno.select("sample_id").union(y.select(F.explode(F.map_keys("_m")).alias("sample_id"))))
    genes = gene_groups(pairs, at_once)
    asked = pairs.join(genes, "gene_id").repartition("variant_key").groupBy("variant_key", "group", "slices").agg(F.collect_set("nth").alias("genes"))
    left = asked.join(packed(geno, ["variant_key"], order), "variant_key").select("group", F.pmod(F.xxhash64("variant_key"), F.col("slices")).alias("slice"), "variant_key", "d", "genes")
    cohorts = y.select("cell", F.explode("_m")).where("value is not null").groupBy("cell").agg(F.collect_set("key").alias("_in")).withColumn("_all", order)
    cohorts = cohorts.select("cell", F.transform("_all", lambda s: F.array_contains("_in", s).cast("byte")).alias("cohort"))
    right = ordered(y, ["cell", "gene_id"], order, "y").join(cohorts, "cell").join(genes, "gene_id")
    right = right.select(F.col("group").alias("of"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("part"), "nth", "cell", "gene_id", "y", "cohort")
    kind = {c: t for c, t in (("cell", expr.schema["cell"]), ("gene_id", expr.schema["gene_id"]), ("variant_key", pairs.schema["variant_key"]))}
    schema = ", ".join(f"{c} {t.dataType.simpleString()}" for c, t in kind.items()) + ", slope double, se double, n bigint"
    s = left.groupBy("group", "slice").cogroup(right.groupBy("of", "part")).applyInArrow(_regress(maf, mac, missing, block), schema)
    z = F.try_divide("slope", "se")
    return s.select("cell", "gene_id", "variant_key", "slope", "se", z.alias("z"), neglog10p(z).alias("neglog10p"), "n")
