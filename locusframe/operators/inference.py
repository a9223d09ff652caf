"""Resampling, single-effect fine-mapping, jackknife regression, run labels and the release form of credible sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.operators.aggregates import credible_set, softmax
from locusframe.sources.shared import written


def poisson_draws(seeds: np.ndarray, counts: np.ndarray, replicates: int) -> np.ndarray:
    """How often the rows of each group are drawn in each replicate: one Poisson(k) count for k rows in place of k times Poisson(1)."""
    return np.array([np.random.default_rng([int(s) & 0xFFFFFFFF, (int(s) >> 32) & 0xFFFFFFFF]).poisson(k, replicates) for s, k in zip(seeds, counts, strict=True)], float).reshape(len(seeds), replicates)


def bootstrap_weights(df: DataFrame, keys: list[str], label: str, a: str, b: str, replicates: int = 2000, seed: int = 9448) -> DataFrame:
    """The draws of paired_bootstrap as rows, for a look at some: keys, label, both scores, replicate and _w (groups that a replicate draws not at all have no row)."""
    g = Bootstrap(df, keys, label, a, b, replicates, seed, poisson_draws, 1).groups.drop("_one")
    fields = [f for f in g.schema if not f.name.startswith("_")]

    def draw(batches):
        for rows in batches:
            w = poisson_draws(rows["_seed"].to_numpy(), rows["_k"].to_numpy(), replicates)
            i, j = np.nonzero(w)
            yield rows[[f.name for f in fields]].iloc[i].assign(replicate=j.astype("int32") + 1, _w=w[i, j])

    return g.mapInPandas(draw, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["replicate int", "_w double"]))


def _flat(rows: pd.DataFrame, keys: list[str], **arrays) -> pd.DataFrame:
    """One row: the keys of `rows` and each array as bytes."""
    return pd.DataFrame({**{c: rows[c].iloc[:1].to_numpy() for c in keys}, **{n: [v.astype(float).tobytes()] for n, v in arrays.items()}})


class Bootstrap:
    """Replicates of two precision-recall curves as vectors: every aggregate carries one array of a number a replicate, no row is copied to its replicates.

    Rows of equal keys, label and scores are one group with a count and a seed that depends on these values alone, so weights can be drawn
    wherever they are needed. Scores are cut into ranges (by quantiles of each key). A first pass sums the weights of each range, prefix sums over the
    ranges give what lies above each, and a second pass goes down each range in order. A task holds one range's groups and some
    hundred weight vectors at a time. Counts are whole numbers, so their sums do not depend on the order of rows.
    """

    def __init__(self, df: DataFrame, keys: list[str], label: str, a: str, b: str, replicates: int, seed: int | Column, draw, ranges: int):
        self.keys, self.label, self.scores, self.n, self.draw, self.ranges = keys, label, (a, b), replicates, draw, ranges
        clean = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        number = F.xxhash64(*keys, label, a, b, F.lit(seed)) if isinstance(seed, int) else seed
        d = df.where(clean(a) & clean(b)).groupBy(*keys, label, a, b).agg(F.count("*").alias("_k"))
        self.groups = d.withColumns({"_one": F.lit(1), "_seed": number.cast("bigint"), a: F.col(a).cast("double"), b: F.col(b).cast("double")})
        self.by = [*keys, "_one"]
        self.types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.groups.schema if f.name in self.by)

    def curve(self, score: str) -> DataFrame:
        """by, area, tp and n: per key the vectors of the sum over score steps of tp * (tp so far / rows so far), of all positives and of all rows."""
        by, label, size, draw = self.by, self.label, self.n, self.draw

        def weights(rows: pd.DataFrame):
            """(rows, weights) in slices."""
            for lo in range(0, len(rows), 256):
                part = rows.iloc[lo : lo + 256]
                yield part, draw(part["_seed"].to_numpy(), part["_k"].to_numpy(), size)

        cuts = self.groups.groupBy(*by).agg(F.percentile_approx(score, [k / self.ranges for k in range(1, self.ranges)], 10_000).alias("_cuts"))
        d = self.groups.join(cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c > F.col(score)))).select(*by, "_range", label, score, "_k", "_seed")
        held = [*by, "_range"]

        def partial(batches):
            for rows in batches:
                for _, some in rows.groupby(held, dropna=False):
                    tp, n = np.zeros(size), np.zeros(size)
                    for part, w in weights(some):
                        tp, n = tp + part[label].to_numpy(float) @ w, n + w.sum(0)
                    yield _flat(some, held, tp=tp, n=n)

        def total(rows: pd.DataFrame) -> pd.DataFrame:
            return _flat(rows, held, **{c: sum(np.frombuffer(v) for v in rows[c]) for c in ("tp", "n")})

        def above(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_range")
            tp, n = (np.array([np.frombuffer(v) for v in rows[c]]) for c in ("tp", "n"))
            return pd.DataFrame({**{c: rows[c].to_numpy() for c in held}, "tp": [v.tobytes() for v in np.cumsum(tp, 0) - tp], "n": [v.tobytes() for v in np.cumsum(n, 0) - n]})

        def down(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values([score, "_seed"], ascending=False)
            tp0, n0 = (np.frombuffer(start[c].iloc[0]) for c in ("tp", "n"))
            ctp, cn, area, step_tp, last = tp0.copy(), n0.copy(), np.zeros(size), np.zeros(size), None

            def close():
                return step_tp * np.divide(ctp, cn, out=np.zeros(size), where=cn > 0)

            for part, w in weights(rows):
                for value, y, v in zip(part[score], part[label], w, strict=True):
                    if value != last:
                        area, step_tp, last = area + close(), np.zeros(size), value
                    cn += v
                    if y:
                        ctp += v
                        step_tp += v
            return _flat(rows, held, area=area + close(), tp=ctp - tp0, n=cn - n0)

        first = f"{self.types}, _range int, "
        sums = d.mapInPandas(partial, first + "tp binary, n binary").groupBy(*held).applyInPandas(total, first + "tp binary, n binary")
        start = sums.groupBy(*by).applyInPandas(above, first + "tp binary, n binary")
        return d.groupBy(*held).cogroup(start.groupBy(*held)).applyInPandas(down, first + "area binary, tp binary, n binary")

    def deltas(self, summary: bool) -> DataFrame:
        """Per key the difference of the two average precisions, by replicate or summed up; replicates of one class are left out."""
        keys, by = self.keys, self.by
        parts = [self.curve(s).withColumn("_score", F.lit(k)) for k, s in enumerate(self.scores)]

        def finish(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["_score", "_range"])
            of = lambda k, c: sum(np.frombuffer(v) for v in rows.loc[rows["_score"] == k, c])
            tp, n = of(0, "tp"), of(0, "n")
            at = np.flatnonzero((tp > 0) & (tp < n))
            # The last digits of an area depend on how ranges were cut; twelve do not.
            delta = np.round((of(0, "area")[at] - of(1, "area")[at]) / tp[at], 12)
            key = {c: rows[c].iloc[0] for c in keys}
            if not summary:
                return pd.DataFrame({**{c: pd.Series([v] * len(at), dtype=object) for c, v in key.items()}, "replicate": at + 1, "delta": delta})
            lo, hi = np.percentile(delta, [2.5, 97.5]) if len(at) else (None, None)
            return pd.DataFrame({**{c: [v] for c, v in key.items()}, "delta": [delta.mean() if len(at) else None], "lo": [lo], "hi": [hi], "significant": [bool(lo > 0 or hi < 0) if len(at) else None], "n_replicates": [len(at)]})

        types = ", ".join(t for t in self.types.split(", ") if "`_one`" not in t)
        schema = ", ".join(filter(None, [types, "delta double, lo double, hi double, significant boolean, n_replicates bigint" if summary else "replicate int, delta double"]))
        return parts[0].unionByName(parts[1]).groupBy(*by).applyInPandas(finish, schema)


def bootstrap_deltas(df: DataFrame, keys: list[str], label: str, a: str, b: str, replicates: int = 2000, seed: int | Column = 9448, draw=poisson_draws, ranges: int = 64) -> DataFrame:
    """Per key and replicate the difference of average precisions of scores a and b, over rows scored by both."""
    return Bootstrap(df, keys, label, a, b, replicates, seed, draw, ranges).deltas(False)


def paired_bootstrap(df: DataFrame, keys: list[str], label: str, a: str, b: str, replicates: int = 2000, seed: int | Column = 9448, draw=poisson_draws, ranges: int = 64) -> DataFrame:
    """Mean difference, its 2.5 and 97.5 percentiles, and whether they lie on one side of 0. Replicates of one class are left out.

    draw(seeds, counts, replicates): the weights of groups; seed: a number, or a column of the group's values.
    """
    return Bootstrap(df, keys, label, a, b, replicates, seed, draw, ranges).deltas(True)


def with_arm(df: DataFrame, only: Column, name: str, every: str = "overall") -> DataFrame:
    """The rows twice, as `arm` every and, where `only` holds (SNVs, for instance), as `arm` name: both comparisons in one job."""
    arms = F.explode(F.when(F.coalesce(only, F.lit(False)), F.array(F.lit(every), F.lit(name))).otherwise(F.array(F.lit(every))))
    return df.withColumn("arm", arms)


def single_effect(df: DataFrame, keys: list[str], z: str, se: str, variance: float = 0.04, prior: Column | None = None) -> DataFrame:
    """Log Bayes factor of each variant under one effect of the given prior variance, and alpha = its softmax per key."""
    r = variance / (variance + F.col(se) ** 2)
    return softmax(df.withColumn("lbf", 0.5 * (F.log(1 - r) + F.col(z) ** 2 * r)), keys, "lbf", prior)


def pure_sets(fit: DataFrame, keys: list[str], pairs: DataFrame, coverage: float = 0.95, least: float = 0.5) -> DataFrame:
    """The credible set of each key with size, coverage reached and purity (smallest |r| among its members, 1 for one member).

    Pairs absent from `pairs` (key1 < key2, r) count as 0; sets under `least` are left out. Purity is counted from the pairs
    that exist: a set of n members is pure only if all n(n-1)/2 pairs are there, so no set is expanded into its pairs.
    """
    s = written(credible_set(fit, keys, coverage), "sets").hint("merge")  # made once; takes many times its file in memory, so not to be broadcast for the size of that
    size = s.groupBy(*keys).agg(F.count("*").alias("size"), F.sum("alpha").alias("coverage"))
    one, two = s.select(*keys, F.col("variant_key").alias("key1")), s.select(*keys, F.col("variant_key").alias("key2"))
    strong = pairs.where(F.abs("r") >= least)
    inside = one.join(strong, "key1").join(two, [*keys, "key2"]).groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.abs("r")).alias("_r"))
    j = size.join(inside, keys, "left").withColumn("purity", F.when(F.col("size") == 1, 1.0).when(F.col("_n") == F.col("size") * (F.col("size") - 1) / 2, F.col("_r")))
    return j.where("purity is not null").select(*keys, "size", "coverage", "purity")


def block_jackknife(df: DataFrame, keys: list[str], block: str, y: str, xs: list[str], weight: str) -> DataFrame:
    """Weighted regression of y on xs and a constant; per key, deleted block and term its coefficient (block null: all rows).

    Moments are one aggregate per block with partial sums; a key then has one row a block, and only the solves run in Python.
    Collinear terms give null.
    """
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    names, k = ["constant", *xs], len(terms)
    sums = [F.sum(F.col(weight) * terms[i] * terms[j]) for i in range(k) for j in range(k)] + [F.sum(F.col(weight) * t * F.col(y)) for t in terms]
    moments = df.groupBy(*keys, F.col(block).cast("long").alias("block")).agg(F.array(*sums).alias("m"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.array(rows["m"].tolist(), float)
        left = np.concatenate([m.sum(0, keepdims=True), m.sum(0) - m])
        out = []
        for b, v in zip([None, *rows["block"]], left, strict=True):
            try:
                beta = np.linalg.solve(v[: k * k].reshape(k, k), v[k * k :])
            except np.linalg.LinAlgError:
                beta = [None] * k
            out += [(*rows[keys].iloc[0], b, n, c) for n, c in zip(names, beta, strict=True)]
        return pd.DataFrame(out, columns=[*keys, "block", "term", "coefficient"]).astype({"block": "Int64"})

    schema = ", ".join(f"{c} {moments.schema[c].dataType.simpleString()}" for c in keys) + ", block bigint, term string, coefficient double"
    return moments.groupBy(*keys).applyInPandas(solve, schema)


def label_runs(df: DataFrame, name: str, pattern: str, parts: list[str]) -> DataFrame:
    """The parts that the pattern's groups find in a run's name; null where it does not match."""
    found = lambda k: F.regexp_extract(F.col(name), pattern, k)
    return df.withColumns({p: F.when(F.col(name).rlike(pattern), F.nullif(found(k + 1), F.lit(""))) for k, p in enumerate(parts)})


def focal_rows(df: DataFrame, run: list[str], focal: Column) -> DataFrame:
    """The focal row of each run; runs with none or several are left out."""
    d = df.where(focal)
    return d.withColumn("_n", F.count("*").over(Window.partitionBy(*run))).where("_n = 1").drop("_n")


def compare_arms(sweep: DataFrame, tau: DataFrame, pip: DataFrame, cohort: str, cut: str) -> DataFrame:
    """The sweep's row at each cohort's tau (tau: cohort, tau), arm `prediction`, with the rows of the cohorts' pip runs, arm `pip`."""
    at = sweep.join(tau, cohort).where(F.col(cut) == F.col("tau")).drop("tau").withColumn("arm", F.lit("prediction"))
    return at.unionByName(pip.join(tau.select(cohort), cohort, "left_semi").withColumn("arm", F.lit("pip")), allowMissingColumns=True)


def best_for_both(pairs: DataFrame, scope: list[str], left: list[str], right: list[str], score: str) -> DataFrame:
    """Pairs that are the best of both their sides within the scope, one per side; ties to the smaller other side."""
    a, b = Window.partitionBy(*scope, *left), Window.partitionBy(*scope, *right)
    d = pairs.withColumns({"_a": F.max(score).over(a), "_b": F.max(score).over(b)}).where((F.col(score) == F.col("_a")) & (F.col(score) == F.col("_b")) & (F.col(score) > 0))
    d = d.withColumn("_n", F.row_number().over(a.orderBy(*right))).where("_n = 1")
    return d.withColumn("_n", F.row_number().over(b.orderBy(*left))).where("_n = 1").drop("_a", "_b", "_n")


def release_sets(variants: DataFrame, sets: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Variant rows with their set's columns, in release form; a release that is not sound stops the job where that is met.

    variants: by, gene_id, cs_idx, chr, pos, ref, alt, pip, alpha, lbf_variable, prior_weight and, if there is one, variant_id; sets: by,
    gene_id, cs_idx, cs_size, min_abs_corr, coverage, lbf. Faults: two rows of one set, a variant row without a set, a set whose rows
    are not as many as its size, an id that is not chr:pos:ref:alt or of another chromosome, a chromosome that is no autosome. A set
    without any variant row has no row here: lost_sets() finds those.
    """
    key = [*by, "gene_id", "cs_idx"]
    where = F.concat_ws("/", *[F.col(c).cast("string") for c in key])
    stop = lambda what: F.raise_error(F.concat(F.lit(what + ": "), where)).cast("bigint")
    info = ["cs_size", "min_abs_corr", "coverage", "lbf"]
    s = sets.groupBy(*key).agg(F.count("*").alias("_rows"), *[F.first(c).alias(c) for c in info])
    s = s.select(*key, F.when(F.col("_rows") == 1, F.col("cs_size")).otherwise(stop("credible set keys are not unique")).alias("_size"), *info[1:])
    n = variants.groupBy(*key).agg(F.count("*").alias("_n"))
    sizes = s.join(n, key, "left").withColumn("cs_size", F.when(F.col("_n") != F.col("_size"), stop("credible set with missing variants")).otherwise(F.col("_size")))
    built = F.concat_ws(":", "chr", F.col("pos").cast("string"), "ref", "alt")
    vid = F.col("variant_id") if "variant_id" in variants.columns else built
    j = variants.withColumn("_id", vid).join(sizes.drop("_size", "_n"), key, "left")
    size = F.when(F.col("cs_size").isNull(), stop("variant row without a credible set")).when(F.size(F.split("_id", ":")) != 4, stop("variant id is not chr:pos:ref:alt"))
    size = size.when(F.get(F.split("_id", ":"), F.lit(0)) != F.col("chr"), stop("variant chromosome differs from gene chromosome")).when(~F.col("chr").rlike("^chr([1-9]|1[0-9]|2[0-2])$"), stop("unexpected chromosome")).otherwise(F.col("cs_size"))
    columns = {**{c: F.col(c) for c in by}, "CHROM": F.regexp_replace("chr", "^chr", ""), "POS": F.col("pos"), "ID": F.col("_id"), "REF": F.col("ref"), "ALT": F.col("alt"), "GENE_ID": F.col("gene_id"), "CS_INDEX": F.col("cs_idx"),
               "CS_SIZE": size, "CS_PURITY": F.col("min_abs_corr"), "CS_COVERAGE": F.col("coverage"), "CS_LBF": F.col("lbf"), "PIP": F.col("pip"), "ALPHA": F.col("alpha"),
               "VARIANT_LBF": F.col("lbf_variable"), "PRIOR_WEIGHT": F.col("prior_weight")}
    return j.select(*[c.alias(n) for n, c in columns.items()])


def release_faults(released: DataFrame) -> DataFrame:
    """Sets of a released table whose variant count is not their size, or that have no set row (empty where a release is sound)."""
    g = released.groupBy("GENE_ID", "CS_INDEX").agg(F.count("*").alias("n"), F.max("CS_SIZE").alias("size"))
    return g.where("size is null or n <> size")


def lost_sets(released: DataFrame, sets: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Sets that a release holds no variant of (empty where it is sound)."""
    have = released.select(*by, F.col("GENE_ID").alias("gene_id"), F.col("CS_INDEX").alias("cs_idx")).distinct()
    return sets.select(*by, "gene_id", "cs_idx").join(have, [*by, "gene_id", "cs_idx"], "left_anti")


def release_counts(released: DataFrame, keys: list[str]) -> DataFrame:
    """Genes, sets, rows and distinct variants per key."""
    return released.groupBy(*keys).agg(F.countDistinct("GENE_ID").alias("genes"), F.countDistinct("GENE_ID", "CS_INDEX").alias("sets"), F.count("*").alias("n_rows"), F.countDistinct("ID").alias("variants"))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows but for the keys that `new` brings, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
