"""Operators that work by blocks, ranges and written tables, against plain Python on small inputs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from locusframe.operators import aggregates as A
from locusframe.operators import coloc as C
from locusframe.operators import crosscell as X
from locusframe.operators import folds
from locusframe.operators import inference as I
from locusframe.operators import joins as J
from locusframe.operators import linkage as L
from locusframe.operators import study as S
from locusframe.sources import files
from locusframe.sources.shared import drop_shared, shared_folder

VARIANT = "chr string, pos long, ref string, alt string"


# --- interval bins ---------------------------------------------------------------------------------------------------


def test_intervals_of_any_length_lie_in_two_bins_at_most(spark):
    rng = np.random.default_rng(2)
    spans = [(int(lo), int(lo + 10**e + rng.integers(-1, 2))) for e in range(9) for lo in rng.integers(0, 3_000_000, 6)] + [(5, 5), (0, 0), (-30, 40), (9, 3), (1999, 2000), (0, 1999), (0, 2000)]
    at = sorted({int(x) for lo, hi in spans for x in (lo - 1, lo, lo + 1, hi - 1, hi, hi + 1)} | set(range(0, 4_000_000, 50_021)))
    i = spark.createDataFrame([("chr1", k, lo, hi) for k, (lo, hi) in enumerate(spans)], "chr string, k int, lo long, hi long")
    p = spark.createDataFrame([("chr1", x) for x in at] + [("chr2", 5)], "chr string, x long")
    got = {(r.x, r.k) for r in J.range_join(p, i, ["chr"], F.col("x"), F.col("lo"), F.col("hi"), 2000).collect()}
    assert got == {(x, k) for x in at for k, (lo, hi) in enumerate(spans) if lo <= x <= hi}
    level = i.where("lo <= hi").withColumn("level", J.bin_level(F.col("hi") - F.col("lo") + 1, 2000)).collect()
    for r in level:
        size = 2000 * J.FAN**r.level
        assert size >= r.hi - r.lo + 1 and (r.level == 0 or size / J.FAN < r.hi - r.lo + 1)
        assert r.hi // size - r.lo // size <= 1


# --- cross-cell table ------------------------------------------------------------------------------------------------


def test_every_pair_of_cells_has_a_test_or_one_reason(spark):
    """Gene by gene one case: a (tested), b (no fit in c2), c (broken in c2), d (no set in c2), e (nine shared variants), f (sets apart), g (no fit at all)."""
    rows, sets = [], []
    for g in "abcdef":
        for cell in ("c1", "c2"):
            keys = range(20) if cell == "c1" else {"e": range(11, 31), "f": range(5, 25)}.get(g, range(20))
            if cell == "c2" and g == "b":
                continue
            rows += [(g, "p", cell, 1, k, None if g == "c" and cell == "c2" and k == 3 else float(k == 15) * 8 - 1) for k in keys]
            if not (cell == "c2" and g == "d"):
                sets += [(g, "p", cell, 1, {"f": 2 if cell == "c1" else 23}.get(g, 15))]
    fits = spark.createDataFrame(rows, "gene_id string, prior string, cell string, effect int, variant_key long, lbf double")
    members = spark.createDataFrame(sets, "gene_id string, prior string, cell string, idx int, variant_key long")
    genes = spark.createDataFrame([(g,) for g in "abcdefg"], "gene_id string")
    got = X.crosscell_rows(genes, fits, members, ["p"], ["c1", "c2"]).toPandas()
    notes = {g: sorted((r.cell, r.other_cell or "", r.note) for r in got[(got.gene_id == g) & got.note.notna()].itertuples()) for g in "abcdefg"}
    focal = [("c1", "", X.FOCAL), ("c2", "", X.FOCAL)]
    assert notes == {
        "a": focal, "b": sorted([focal[0], ("c1", "c2", "no fit in other cell"), ("c2", "", "no fit")]), "c": sorted([focal[0], ("c1", "c2", "unreadable fit in other cell"), ("c2", "", "unreadable fit")]),
        "d": sorted([focal[0], ("c1", "c2", "no credible set in other cell"), ("c2", "", "no credible set")]), "e": sorted([*focal, ("c1", "c2", "fewer than 10 shared variants"), ("c2", "c1", "fewer than 10 shared variants")]),
        "f": sorted([*focal, ("c1", "c2", X.NOTHING_SHARED), ("c2", "c1", X.NOTHING_SHARED)]), "g": [("c1", "", "no fit"), ("c2", "", "no fit")],
    }
    tests = got[got.note.isna()]
    assert sorted(zip(tests.gene_id, tests.cell, tests.other_cell, tests.nsnps)) == [("a", "c1", "c2", 20), ("a", "c2", "c1", 20)]
    assert np.allclose(tests[[f"pp_h{k}" for k in range(5)]].sum(1), 1) and (tests.hit1 == 15).all()
    # A test whose Bayes factors overflow gives no result, and says so.
    wild = fits.where("gene_id = 'a'").withColumn("lbf", F.when(F.col("variant_key") == 15, float("inf")).otherwise(F.col("lbf")))
    got = X.crosscell_rows(genes.where("gene_id = 'a'"), wild, members, ["p"], ["c1", "c2"])
    assert got.where(F.col("note") == X.NO_RESULT).count() == 2 and got.where("note is null").count() == 0
    summary = S.crosscell_summary(X.crosscell_rows(genes, fits, members, ["p"], ["c1", "c2"]).withColumnRenamed("pp_h4", "h4"), by=["prior", "cell"])
    ok = members.where("gene_id in ('a', 'b', 'c', 'd', 'e', 'f')").where("not (cell = 'c2' and gene_id = 'c')")
    assert X.set_counts_check(summary, ok, ["prior", "cell"]).count() == 0
    assert X.set_counts_check(summary, ok.where("gene_id <> 'a'"), ["prior", "cell"]).count() == 2
    assert drop_shared(spark) > 0


# --- linkage and regression ------------------------------------------------------------------------------------------


def genotypes(seed, n, samples=40):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        d = rng.integers(0, 3, samples).astype(float)
        if k % 3:
            d = np.where(rng.random(samples) < 0.8, last, d)
        last = d
        rows.append((k, f"chr{k % 2 + 1}", int(1000 + (k // 2) * 100 + (k % 10 == 0) * 7), np.where(rng.random(samples) < 0.05, np.nan, d) if k != 4 else np.full(samples, np.nan)))
    return rows


@pytest.mark.parametrize("block", [3, 17, 1024])
def test_ld_pairs_of_two_chromosomes_in_blocks(spark, block):
    rows, w = genotypes(1, 90), 700
    d = spark.createDataFrame([(s, c, p, k, None if math.isnan(x) else int(x)) for k, c, p, g in rows for s, x in enumerate(g)], "sample_id int, chr string, pos long, variant_key long, dosage int")
    want = {}
    for (k, c, p, x), (l, e, q, y) in itertools.combinations(rows, 2):
        both = ~np.isnan(x) & ~np.isnan(y)
        if c == e and abs(p - q) <= w and both.sum() > 1 and x[both].std() > 0 and y[both].std() > 0:
            r = np.corrcoef(x[both], y[both])[0, 1]
            if r * r >= 0.001:
                want[(c, k, l) if (p, k) < (q, l) else (c, l, k)] = r
    got = {(r.chr, r.key1, r.key2): r.r for r in L.ld_pairs(d, w, block=block).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_marginal_regression_of_cells_with_their_own_samples(spark):
    rows = genotypes(3, 30)
    rng = np.random.default_rng(9)
    expr = [(cell, f"g{g}", s, float(rng.normal() + 100)) for cell, step in (("a", 1), ("b", 2)) for g in range(3) for s in range(0, 40, step) if rng.random() < 0.9]
    geno = spark.createDataFrame([(s, k, None if math.isnan(x) else int(x)) for k, _, _, g in rows for s, x in enumerate(g)], "sample_id int, variant_key long, dosage int")
    e = spark.createDataFrame(expr + expr[:5], "cell string, gene_id string, sample_id int, y double")
    pairs = spark.createDataFrame([(f"g{g}", k) for g in range(3) for k in range(g, 30)] * 2, "gene_id string, variant_key long")
    got = {(r.cell, r.gene_id, r.variant_key): (r.slope, r.se, r.n) for r in L.marginal_regression(geno, e, pairs, block=7).collect()}
    want = {}
    for cell in "ab":
        cohort = sorted({s for c, _, s, _ in expr if c == cell})
        for k, _, _, x in rows:
            x1 = x[cohort]
            seen = ~np.isnan(x1)
            minor = min(x1[seen].sum(), 2 * seen.sum() - x1[seen].sum())
            if not seen.any() or minor < 10 or minor / (2 * seen.sum()) < 0.001 or 1 - seen.mean() > 0.1:
                continue
            for g in range(3):
                ys = {s: y for c, n, s, y in expr if (c, n) == (cell, f"g{g}")}
                at = [s for s in ys if not math.isnan(x[s])]
                u, v = x[at], np.array([ys[s] for s in at])
                if k >= g and len(at) > 2 and u.std() > 0:
                    b, a = np.polyfit(u, v, 1)
                    want[cell, f"g{g}", k] = (b, math.sqrt(((v - a - b * u) ** 2).sum() / (len(at) - 2) / ((u - u.mean()) ** 2).sum()), len(at))
    assert got.keys() == want.keys() and len({c for c, *_ in want}) == 2
    assert all(np.allclose(got[k], want[k], rtol=1e-7) for k in want)
    with pytest.raises(PySparkException):
        L.marginal_regression(geno, e.union(spark.createDataFrame([("a", "g0", 0, 5.0), ("a", "g0", 0, 6.0)], e.schema)), pairs).collect()


def test_sets_are_pure_only_if_all_their_pairs_are(spark):
    fit = [("g", 1, 0.4), ("g", 2, 0.3), ("g", 3, 0.3), ("h", 1, 1.0), ("i", 1, 0.5), ("i", 3, 0.5), ("j", 2, 0.5), ("j", 4, 0.5)]
    d = spark.createDataFrame(fit, "gene_id string, variant_key long, alpha double")
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, -0.7), (2, 3, 0.6), (2, 4, 0.3)], "key1 long, key2 long, r double")
    got = {r.gene_id: (r.size, round(r.purity, 6)) for r in I.pure_sets(d, ["gene_id"], pairs).collect()}
    assert got == {"g": (3, 0.6), "h": (1, 1.0), "i": (2, 0.7)}
    got = {r.gene_id for r in I.pure_sets(d, ["gene_id"], pairs.where("key1 <> 1 or key2 <> 3")).collect()}
    assert got == {"h"}  # the pair 1, 3 is missing, so g and i are not pure


# --- resampling ------------------------------------------------------------------------------------------------------


def plain_ap(y, s, w):
    tp, n, area, total = 0.0, 0.0, 0.0, (y * w).sum()
    for v in sorted(set(s), reverse=True):
        at = s == v
        tp, n = tp + (y * w)[at].sum(), n + w[at].sum()
        area += (y * w)[at].sum() * (tp / n if n else 0)
    return area / total if 0 < total < w.sum() else None


def test_bootstrap_vectors_equal_plain_replicates_in_every_layout(spark):
    rng = np.random.default_rng(4)
    rows = [(["k", "l"][i % 2], int(rng.random() < 0.3), round(float(rng.random()), 2), None if i % 11 == 0 else round(float(rng.normal()), 1)) for i in range(400)] + [("one", 1, 0.5, 0.5)] * 3
    d = spark.createDataFrame(rows, "k string, y int, a double, b double")
    num = F.xxhash64("y", "a", "b")
    one = [sorted(map(tuple, I.bootstrap_deltas(d.repartition(n), ["k"], "y", "a", "b", 25, num, ranges=r).collect())) for n, r in ((1, 64), (5, 7), (3, 1))]
    assert one[0] == one[1] == one[2] and {k for k, *_ in one[0]} == {"k", "l"}
    groups = d.where("b is not null").groupBy("k", "y", "a", "b").count().withColumn("s", num).collect()
    for k in ("k", "l"):
        g = [r for r in groups if r.k == k]
        w = I.poisson_draws(np.array([r.s for r in g]), np.array([r["count"] for r in g]), 25)
        y, a, b = (np.array([r[c] for r in g], float) for c in "yab")
        want = {r + 1: plain_ap(y, a, w[:, r]) - plain_ap(y, b, w[:, r]) for r in range(25)}
        got = {r: x for key, r, x in one[0] if key == k}
        assert got.keys() == want.keys() and max(abs(got[r] - want[r]) for r in got) < 1e-9
    s = {r.k: r for r in I.paired_bootstrap(d, ["k"], "y", "a", "b", 25, num).collect()}
    x = [v for key, _, v in one[0] if key == "l"]
    assert np.allclose((s["l"].delta, s["l"].lo, s["l"].hi), (np.mean(x), *np.percentile(x, [2.5, 97.5])), atol=1e-9)
    assert s["one"].n_replicates == 0 and s["one"].delta is None and s["one"].significant is None
    arms = I.paired_bootstrap(I.with_arm(d, F.col("k") == "l", "snv"), ["arm"], "y", "a", "b", 25)
    assert {r.arm for r in arms.collect()} == {"overall", "snv"}


# --- panel, rankings, colocalizations --------------------------------------------------------------------------------


def test_panel_rows_without_z_stand_for_nothing(spark):
    panel = spark.createDataFrame([("chr1", 5, "A", "C")], VARIANT)
    g = spark.createDataFrame([("chr1", 5, "A", "C", None, 1), ("chr1", 5, "A", "C", math.nan, 1), ("chr1", 5, "C", "A", 2.0, 7)], VARIANT + ", z double, n int")
    assert [(r.orient, r.z_panel, r.n) for r in J.match_panel(g, panel).collect()] == [("flip", -2.0, 7)]


def test_rankings_hold_to_the_baseline(spark):
    d = spark.createDataFrame([("r", "chr1", p, "A", "C", float(p)) for p in range(10)] + [("q", "chr1", 3, "A", "C", 1.0)], "ranking string, " + VARIANT + ", score double")
    base = d.where("pos < 6").select("chr", "pos", "ref", "alt").distinct()
    assert {(r.ranking, r.pos, r.rank) for r in A.top_n(d, ["ranking"], "score", ["chr", "pos", "ref", "alt"], 2, base).collect()} == {("r", 5, 1), ("r", 4, 2), ("q", 3, 1)}
    flags = {r.pos: (r.top_r, r.top_q) for r in S.top_n_annotations(base, d, "ranking", ["r", "q"], "score", 2).collect()}
    assert flags == {p: (int(p > 3), int(p == 3)) for p in range(6)}
    assert {(r.ranking, r.n_candidates) for r in S.short_rankings(base, d, "ranking", ["r", "q", "none"], 6).collect()} == {("q", 1), ("none", 0)}


def test_two_rows_of_one_set_stop_the_job(spark):
    pairs = spark.createDataFrame([("g", 1, 1, "chr1:5:A:C", "chr1:6:A:C"), ("h", 1, 1, "chr1:5:A:C", "chr1:5:A:C")], "gene_id string, effect1 int, effect2 int, hit1 string, hit2 string")
    sets = spark.createDataFrame([("g", 1, 3, 0.9, 0.7), ("x", 1, 2, 0.5, 0.6)], "gene_id string, effect int, size int, top_pip double, purity double")
    got = {r.gene_id: (r.cs_size, r.cs_top_pip, r.cs_min_abs_corr, r.same_hit, r.unmatched) for r in C.coloc_with_sets(pairs, sets).collect()}
    assert got == {"g": (3, 0.9, 0.7, False, False), "h": (None, None, None, True, True)}
    assert C.unmatched_pairs(C.coloc_with_sets(pairs, sets)).first().asDict() == {"n_pairs": 2, "n_unmatched": 1}
    for bad in (C.coloc_with_sets(pairs, sets.union(spark.createDataFrame([("g", 1, 4, 0.1, 0.2)], sets.schema))), C.coloc_with_sets(pairs.withColumn("hit1", F.lit("nowhere")), sets)):
        with pytest.raises(PySparkException):
            bad.collect()


# --- releases and writes ---------------------------------------------------------------------------------------------

MEMBERS = [("a", "g1", 1, "chr1", 5, "A", "C", 0.5), ("a", "g1", 1, "chr1", 6, "A", "C", 0.4), ("b", "g1", 2, "chr2", 5, "A", "C", 0.9)]
SETROWS = [("a", "g1", 1, 2, 0.9), ("b", "g1", 2, 1, 0.8)]


def release(spark, members=MEMBERS, sets=SETROWS, pip=0.0):
    v = spark.createDataFrame(members, "cell string, gene_id string, cs_idx int, " + VARIANT + ", pip double").withColumn("pip", F.col("pip") + pip)
    s = spark.createDataFrame(sets, "cell string, gene_id string, cs_idx int, cs_size int, min_abs_corr double")
    extra = {c: F.lit(0.5) for c in ("alpha", "lbf_variable", "prior_weight")}
    return I.release_sets(v.withColumns(extra), s.withColumns({"coverage": F.lit(0.95), "lbf": F.lit(3.0)}), ["cell"])


def test_releases_fail_on_every_fault_and_reruns_replace_their_own_rows(spark):
    assert release(spark).count() == 3 and I.release_faults(release(spark)).count() == 0
    faults = {
        "keys are not unique": (MEMBERS, [*SETROWS, ("a", "g1", 1, 2, 0.1)]), "without a credible set": ([*MEMBERS, ("b", "g9", 1, "chr1", 5, "A", "C", 0.1)], SETROWS),
        "lost in the join": (MEMBERS, [*SETROWS, ("a", "g2", 1, 2, 0.1)]), "missing variants": (MEMBERS[1:], SETROWS), "unexpected chromosome": ([*MEMBERS[:2], ("b", "g1", 2, "chrX", 5, "A", "C", 0.9)], SETROWS),
    }
    at = shared_folder(spark, "release-test")
    files.write_release(release(spark), at, ["cell"])
    for said, (members, sets) in faults.items():
        if said == "lost in the join":  # a set without rows has none to carry the fault: its check is the count of sets
            continue
        with pytest.raises(PySparkException, match=said):
            files.write_release(release(spark, members, sets), at, ["cell"])
    assert I.lost_sets(release(spark), spark.createDataFrame(faults["lost in the join"][1], "cell string, gene_id string, cs_idx int, n int, p double"), ["cell"]).count() == 1
    files.write_release(release(spark, pip=0.05).where("cell = 'b'"), at, ["cell"])
    assert {(r.cell, r.POS, round(r.PIP, 2)) for r in spark.read.parquet(at).collect()} == {("a", 5, 0.5), ("a", 6, 0.4), ("b", 5, 0.95)}


def test_a_hot_chromosome_is_split_over_files_and_small_ones_are_not(spark):
    d = spark.range(0, 400_000, 1, 16).select(F.when(F.col("id") < 390_000, "chr1").otherwise(F.concat(F.lit("chr"), (F.col("id") % 20 + 2).cast("string"))).alias("chr"), F.xxhash64("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    at, before = shared_folder(spark, "hot"), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    files.write_by_chr(d, at, part_bytes=2 << 20)
    files_of = spark.read.parquet(at).select("chr", F.col("_metadata.file_path").alias("f")).groupBy("chr", "f").count().collect()
    n = {r.chr: sum(q.chr == r.chr for q in files_of) for r in files_of}
    sizes = [r["count"] for r in files_of]
    assert len(n) == 21 and n["chr1"] >= 8 and all(v <= 2 for c, v in n.items() if c != "chr1") and max(sizes) < 80_000
    assert spark.read.parquet(at).count() == 400_000
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) == before


# --- held-out trees --------------------------------------------------------------------------------------------------


def test_folds_fitted_side_by_side_are_those_fitted_alone(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, int(rng.random() < 0.2 + 0.5 * (i % 5 == 0)), float(i % 5), float(rng.normal()), 1.0 + i % 2) for i in range(600)]
    d = folds.assembled(spark.createDataFrame(rows, "id long, fold int, y int, u double, v double, w double"), ["u", "v"])
    how = {"maxIter": 3, "maxDepth": 3}
    models = folds.train_folds(d, "fold", [0, 1, 2], "y", "w", **how)
    alone = {f: folds.train_folds(d, "fold", [f], "y", "w", at_once=1, **how)[f] for f in (0, 2)}
    assert all(models[f].toDebugString.split("\n")[1:] == m.toDebugString.split("\n")[1:] for f, m in alone.items())
    by_model = {r.id: r.pred_prob for r in folds.score_folds(d, "fold", models, ["id"]).collect()}
    by_node = {r.id: r.pred_prob for r in folds.score_nodes(d, "fold", folds.node_table(spark, models), ["id"], 3).collect()}
    assert by_model.keys() == by_node.keys() and max(abs(by_model[i] - by_node[i]) for i in by_model) < 1e-9
