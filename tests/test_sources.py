"""Files written and read back, folds, resampling and purity, each against plain Python."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import folds, inference
from locusframe.sources import files

V = "variant_id string, chr string, pos long, ref string, alt string, gene_id string, pip double, pred_prob double"
ROWS = [("chr1:9:A:C", "chr1", 9, "A", "C", "G2", 0.1, 0.30000000000000004), ("chr1:9:A:C", "chr1", 9, "A", "C", "G1", 0.2, 1 / 3), ("chr2:5:A:T", "chr2", 5, "A", "T", "G1", 0.5, 0.7)]


def test_predictions_round_trip(spark, tmp_path):
    d = spark.createDataFrame(ROWS, V)
    files.export_predictions(d, f"file://{tmp_path}/out")
    lines = []
    for f in sorted((tmp_path / "out" / "chr=chr1").glob("*.gz")):
        lines += gzip.open(f, "rt").read().splitlines()
    assert lines[0].split("\t")[:3] == ["#CHROM", "POS", "ID"] and [x.split("\t")[5] for x in lines if x[0] != "#"] == ["G1", "G2"]
    back = files.import_predictions(spark, f"file://{tmp_path}/out/*/*.gz").select(d.columns)
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)
    with pytest.raises(ValueError):
        files.export_predictions(d.withColumn("chr", F.lit("chr3")), f"file://{tmp_path}/bad")
    with pytest.raises(ValueError):
        files.export_predictions(d.limit(0), f"file://{tmp_path}/bad")


@pytest.mark.parametrize("part_bytes", [1 << 10, 128 << 20])
def test_tables_by_chromosome(spark, tmp_path, part_bytes):
    d = files.with_chr(spark.createDataFrame(ROWS, V).drop("chr"))
    files.write_by_chr(d, f"file://{tmp_path}/t", part_bytes=part_bytes)
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {"chr=chr1", "chr=chr2"}
    got = files.read_chr(spark, f"file://{tmp_path}/t", ["chr1", "chr9"], ["gene_id", "pip"], F.col("pip") > 0.15)
    assert [tuple(r) for r in got.collect()] == [("G1", 0.2)]
    d.withColumn("lane", F.lit("train")).write.partitionBy("lane", "chr").parquet(f"file://{tmp_path}/lanes")
    assert files.read_lane(spark, f"file://{tmp_path}/lanes", "train", ["chr2", "chr7"]).count() == 1
    assert files.read_lane(spark, f"file://{tmp_path}/lanes", "test").count() == 0


def test_text_formats(spark, tmp_path):
    bed = tmp_path / "bed"
    bed.mkdir()
    (bed / "peaks_a.bed").write_text("track x\nchr1\t1\t5\textra\nchr2\t7\t9\n")
    (bed / "peaks_a.unmapped.bed").write_text("chr1\t3\t4\n")
    assert {tuple(r) for r in files.read_bed(spark, f"file://{bed}").collect()} == {("chr1", 1, 5, "peaks_a"), ("chr2", 7, 9, "peaks_a")}
    (tmp_path / "g.gtf").write_text('#!x\nchr1\tH\tgene\t1\t2\t.\t+\t.\tgene_id "E1.4_PAR_Y"; gene_type "protein_coding"; gene_name "a";\nchr1\tH\tgene\t1\t2\t.\t+\t.\tgene_id "E2.4"; gene_type "lncRNA";\n'
                                    'chr1\tH\texon\t1\t2\t.\t+\t.\tgene_id "E3.4"; gene_type "protein_coding";\n')  # fmt: skip
    assert [r.gene_id for r in files.protein_coding_genes(spark, f"file://{tmp_path}/g.gtf").collect()] == ["E1"]
    cell = tmp_path / "micro" / "PIP_all"
    cell.mkdir(parents=True)
    (cell / "G1.csv").write_text("chr pos ref alt betahat sebetahat maf pip gene_id\nchr1 5 A C 0.1 0.2 0.3 0.25 G1\n")
    got = files.read_pip_csv(spark, f"file://{tmp_path}/*/PIP_all/*.csv").first()
    assert (got.cell, got.pos, got.pip, got.gene_id) == ("micro", 5, 0.25, "G1")


def test_negative_variance_fails(spark):
    d = spark.createDataFrame([(1, 9, "A", "C", 0.5), (1, 3, "A", "C", 0.0)], "CHR int, BP long, A1 string, A2 string, SNPVAR double")
    assert [r.BP for r in files.prep_snpvar(d).collect()] == [3, 9]
    with pytest.raises(Exception, match="negative SNPVAR"):
        files.prep_snpvar(d.withColumn("SNPVAR", F.lit(-1.0))).collect()


def plain_ap(y, s, w):
    total = ap = tp = n = 0
    for c in sorted(set(s), reverse=True):
        at = s == c
        tp, n, gain = tp + (w * y)[at].sum(), n + w[at].sum(), (w * y)[at].sum()
        ap, total = ap + (gain * tp / n if n else 0), total + gain
    return ap / total if total and total < w.sum() else None


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 120)
    rows = [(i, int(y[i]), round(float(y[i] * 0.4 + rng.random()), 1), round(float(rng.random()), 1)) for i in range(120)] + [(999, 1, None, 0.5)]
    d = spark.createDataFrame(rows, "id long, y int, a double, b double")
    got = {r.replicate: r.delta for r in inference.bootstrap_deltas(d, [], "y", "a", "b", 20).collect()}
    w = inference.bootstrap_weights(d, [], "y", "a", "b", 20).toPandas()
    total = w.groupby("replicate")["_w"].sum()
    assert 0.9 * 120 < total.mean() < 1.1 * 120 and total.std() > 3
    for r, p in w.groupby("replicate"):
        y_, a, b, n = (p[c].to_numpy() for c in ("y", "a", "b", "_w"))
        assert math.isclose(got[r], plain_ap(y_, a, n) - plain_ap(y_, b, n), abs_tol=1e-9)
    one = inference.paired_bootstrap(d, [], "y", "a", "b", 60).first()
    assert one.lo <= one.delta <= one.hi and one.significant == (one.lo > 0 or one.hi < 0) and one.n_replicates == 60
    same = inference.paired_bootstrap(d.withColumn("c", F.col("b")), [], "y", "b", "c", 10).first()
    assert same.delta == 0 and not same.significant


def test_purity(spark):
    fit = spark.createDataFrame([("g", 1, 0.5), ("g", 2, 0.46), ("g", 3, 0.04), ("h", 1, 0.99), ("k", 1, 0.5), ("k", 3, 0.5)], "gene_id string, variant_key int, alpha double")
    pairs = spark.createDataFrame([(1, 2, -0.8), (1, 3, 0.3)], "key1 int, key2 int, r double")
    got = {r.gene_id: (r.size, round(r.coverage, 6), r.purity) for r in inference.pure_sets(fit, ["gene_id"], pairs).collect()}
    assert got == {"g": (2, 0.96, 0.8), "h": (1, 0.99, 1.0)}


def test_replaced_rows(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, inference.replace_rows(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_folds_score_only_what_they_left_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"chr{i % 2}", float(v := rng.random()), None if i % 5 == 0 else float(rng.random()), int(v > 0.5), 1.0) for i in range(200)]
    d = folds.assembled(spark.createDataFrame(rows, "id int, chr string, a double, b double, y int, w double"), ["a", "b"], "b")
    m = folds.train_folds(d, "chr", ["chr0", "chr1"], "y", "w", maxIter=3)
    long = folds.score_folds(d, "chr", m, ["id", "y"])
    got = folds.wide_scores({"gbt": long}, ["id", "y"]).collect()
    assert len(got) == 200 and sum((r.pred_gbt > 0.5) == r.y for r in got) > 185
