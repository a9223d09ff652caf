"""What a step ships grows with its input, and rules hold at key ranges that the small tables lack."""

import contextlib

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from locusframe.llm import mixing
from locusframe.llm.common import HashedWords
from locusframe.operators import aggregates as A
from locusframe.operators import assemblies as M
from locusframe.operators import coloc as C
from locusframe.operators import crosscell as X
from locusframe.operators import features, folds
from locusframe.operators import inference as I
from locusframe.operators import joins as J
from locusframe.operators import linkage
from locusframe.plans import block_queries, registry, table_queries  # noqa: F401 (the import registers its queries)
from locusframe.sources import fixtures


def rows_joined(spark, df):
    """Rows that the joins of df give, all together."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        todo, n = [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            at = todo.pop()
            todo += [at.children().apply(k) for k in range(at.children().size())]
            if "Join" in at.nodeName():
                with contextlib.suppress(Exception):  # a join without the metric
                    n += at.metrics().apply("numOutputRows").value()
        return n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_priors_join_asked_keys_only(spark):
    """Sixty genes whose windows hold 500 records each, of which each gene asks for one."""
    s = spark.range(500).select(F.lit("chr1").alias("chr"), F.col("id").alias("pos"), F.lit("A").alias("a1"), F.lit("C").alias("a2"), (F.col("id") + 1.0).alias("snpvar"), F.col("id").alias("record_no"))
    late = s.where("pos < 60").withColumns({"snpvar": F.lit(99.0), "record_no": F.col("record_no") + 1000})
    w = spark.range(60).select(F.concat(F.lit("g"), "id").alias("gene_id"), F.lit("chr1").alias("chr"), F.lit(0).cast("bigint").alias("start_pos"), F.when(F.col("id") < 59, 499).otherwise(10).cast("bigint").alias("end_pos"))
    v = w.select("gene_id", F.concat(F.lit("chr1:"), F.substring("gene_id", 2, 9), F.lit(":A:C")).alias("key")).union(w.select("gene_id", F.lit("chr1:9999:A:C")))
    got = C.snpvar_prior(v, w, s.union(late))
    assert rows_joined(spark, got) < 1000  # 60 x 500 where all records of a window meet
    share = {(r.gene_id, r.key): r.prior for r in got.collect()}
    assert len(share) == 120 and set(share.values()) == {0.5}
    one = C.snpvar_prior(w.where("gene_id = 'g7'").select("gene_id", F.explode(F.array(*[F.lit(f"chr1:{p}:A:C") for p in (1, 5, 700)])).alias("key")), w, s.union(late))
    assert {r.key: r.prior for r in one.collect()} == {"chr1:1:A:C": 0.2, "chr1:5:A:C": 0.6, "chr1:700:A:C": 0.2}


def test_tops_of_sets_whose_keys_lie_far_apart(spark, tmp_path):
    """The best variant of a set is the one of the highest Bayes factor however far its key is; the SQL says the same."""
    rows = [(o, p, 1, 3, q) for o, p, q in ((0, 10, 48.0), (0, 1_200_000, 50.0), (1, 10, 42.0), (1, 1_200_000, 50.0))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name, column, want in (("A17_match_sets", "same_top_variant", True), ("A17_match_by_index", "same_top_variant", True), ("A18_match_summary", "pct_same_top", 100.0)):
        assert [r[column] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()] == [want]
        assert c.sql(f"SELECT {column} FROM ({registry.ORACLE_SQL[name]})").fetchall() == [(want,)]


def test_topics_are_fitted_on_all_documents(spark):
    """Plain numpy on every text gives the same centroids; texts in any number count, not some thousand drawn ones."""
    text = lambda k: " ".join(f"w{(k * 7 + j * j) % (11 + k % 5)}" for j in range(3 + k % 13)) if k % 9 else ""
    docs = spark.createDataFrame([(k, text(k), f"l{k % 3}", "s") for k in range(4500)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r._topic for r in mixing.with_cells(docs.repartition(7)).select("doc_id", "_topic").collect()}
    x, n = mixing.vectors([text(k) for k in range(4500)], HashedWords())
    lang, has = np.arange(4500) % 3, n > 0
    z = mixing.stepped(x - np.stack([np.rint(x[has & (lang == v)].mean(0)) for v in lang]))
    rows = sorted(mixing.packed(z[has]))
    all_z = np.array([np.frombuffer(b, np.int16) for b in rows], float)
    pick = [0]
    while len(pick) < 8:
        pick.append(int((all_z @ all_z[pick].T).max(1).argmin()))
    c = all_z[pick]
    for _ in range(12):
        of = (all_z @ c.T).argmax(1)
        c = mixing.stepped(np.stack([all_z[of == k].sum(0) if (of == k).any() else c[k] for k in range(8)]))
    want = {k: f"t{(z[k] @ c.T).argmax()}" if has[k] else "" for k in range(4500)}
    assert got == want and len(set(want.values())) > 4


def test_sparse_variants_meet_in_few_blocks(spark, monkeypatch):
    """Where a window holds one variant, tiles are as many windows as pay for a product, and the pairs are those of brute force."""
    x = np.random.default_rng(5).integers(0, 3, (400, 16)).astype(float)
    g = spark.createDataFrame([(s, "chr1", v * 1000, v, float(x[v, s])) for v in range(400) for s in range(16)], "sample_id int, chr string, pos long, variant_key long, dosage double")
    pairs = linkage.ld_pairs(g, 1000, block=256)
    want = {(a, b): np.corrcoef(x[a], x[b])[0, 1] for a in range(400) for b in range(a + 1, min(a + 2, 400))}
    want = {k: r for k, r in want.items() if r * r >= 0.001}
    got = {(r.key1, r.key2): r.r for r in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    once = lambda rows: pd.DataFrame({"chr": ["chr1"], "key1": [0], "key2": [0], "pos1": [0], "pos2": [0], "r": [0.0]})
    monkeypatch.setattr(linkage, "_block_pair", lambda w, least: once)
    assert linkage.ld_pairs(g, 1000, block=256).count() < 20  # 799 with a tile a window


def test_no_task_ranks_a_whole_ranking(spark):
    """Of 150,000 rows of one ranking at most 64 times the rows asked for are sorted together; the ranks are those of a plain sort."""
    d = spark.range(150_000).select(F.lit("c").alias("cell"), (F.col("id") * 7919 % 9973).alias("pip"), "id")
    top = A.top_n(d, ["cell"], "pip", ["id"], 1001)
    want = sorted(((-(k * 7919 % 9973), k) for k in range(150_000)))[:1001]
    assert sorted((r["rank"], r.id) for r in top.collect()) == [(i + 1, k) for i, (_, k) in enumerate(want)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = A.top_n(d, ["cell"], "pip", ["id"], 1001)
        again.collect()
        todo, sent = [again._jdf.queryExecution().executedPlan()], []
        while todo:
            at = todo.pop()
            todo += [at.children().apply(k) for k in range(at.children().size())]
            if at.nodeName() == "Exchange":
                sent.append(at.metrics().apply("shuffleRecordsWritten").value())
        assert 0 < min(sent) <= 64 * 1001
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_pairs_of_genes_are_not_shuffled(spark):
    """All of 20,000 pairs come once, and only variants and genes are sent to be joined."""
    v = spark.range(200).select(F.lit("chr1").alias("chr"), (F.col("id") * 5000 + 900_000).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    g = spark.range(100).select(F.concat(F.lit("g"), "id").alias("gene_id"), F.lit("chr1").alias("chr"), (F.col("id") * 1000 + 950_000).alias("gene_tss"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, x in conf.items():
        spark.conf.set(k, x)
    try:
        d = J.pair_genes(v.union(v), g.union(g))
        rows = d.collect()
        assert len(rows) == len(set(rows)) == 20_000
        todo, sent = [d._jdf.queryExecution().executedPlan()], 0
        while todo:
            at = todo.pop()
            todo += [at.children().apply(k) for k in range(at.children().size())]
            if at.nodeName() == "Exchange":
                sent += at.metrics().apply("shuffleRecordsWritten").value()
        assert sent < 5000
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_fits_of_cells_are_computed_once(spark):
    """All steps between cells read one table of fits; what it is made of is read once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    rows = [(f"G{g}", f"cell{c}", e, v, float((g * 31 + c * 7 + e * 3 + v * 5) % 17)) for g in range(10) for c in range(3) for e in (1, 2) for v in range(20)]
    f = spark.createDataFrame(rows, "gene_id string, cell string, effect int, variant_key long, lbf double")
    genes = f.select("gene_id").distinct()
    got = block_queries._crosscell(f.mapInPandas(count, f.schema), genes).collect()
    assert seen.value == len(rows) and sum(r.note is None for r in got) > 10


def test_shared_variants_of_many_cells(spark):
    """The cells of a variant are bits of several columns where there are more than sixty; counts and sets are those of brute force."""
    cells = [f"c{k}" for k in range(130)]
    has = {(c, v) for k, c in enumerate(cells) for v in range(12) if (k * 7 + v * v) % 11 == 0}
    fits = spark.createDataFrame([("g", "p", c, v) for c, v in has] * 2, "gene_id string, prior string, cell string, variant_key long")
    shared = X.shared_variants(fits, cells)
    got = {(r.cell, r.other_cell): r.n_shared for r in X.shared_counts(shared, cells).collect()}
    want = {(a, b): n for a in cells for b in cells if a != b and (n := sum((a, v) in has and (b, v) in has for v in range(12)))}
    assert got == want and len(want) > 100
    members = fits.where("variant_key < 6").select("gene_id", "prior", "cell", (F.col("variant_key") % 2).alias("idx"), "variant_key")
    left = {(r.cell, r.other_cell, r.idx) for r in X.sets_left(shared, members, cells).collect()}
    assert left == {(a, b, v % 2) for a, v in has if v < 6 for b in cells if b != a and (b, v) in has}


def test_equal_rows_are_fitted_together(spark):
    """Of 60,000 rows with 24 kinds a boosting round reads 10 of a kind at most; a rare kind keeps its rows; trees and scores are those of all rows."""
    d = spark.range(60_000).select("id", (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 6).cast("double").alias("a"), (F.col("id") * 7919 % 13 < F.col("id") % 6 + 3).cast("int").alias("y"), F.lit(2.0).alias("w"))
    d = d.union(spark.createDataFrame([(60_000 + k, 0, 9.0, 1, 2.0) for k in range(4)], d.schema))
    d = folds.assembled(d, ["a"])
    m = folds.merged(d, "fold", "y", "w", 10).withColumn("x", folds.vector_to_array("x")[0])
    assert m.count() <= 24 * 10 + 4 and m.agg(F.sum("w")).first()[0] == 120_008 and m.where("x = 9").count() == 4
    models = folds.train_folds(d, "fold", [0, 1], "y", "w", maxIter=2)
    how = folds.PUBLISHED | {"maxIter": 2}
    plain = {f: folds.GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", **how).fit(d.where(F.col("fold") != f)) for f in (0, 1)}
    key = lambda r: (r.fold, r.tree, r.node)
    got, want = (sorted(folds.node_table(spark, x).collect(), key=key) for x in (models, plain))
    assert [(*key(r), r.feature, r.threshold) for r in got] == [(*key(r), r.feature, r.threshold) for r in want]
    assert all(abs(a.prediction - b.prediction) < 1e-9 for a, b in zip(got, want, strict=True))
    assert folds.score_folds(d, "fold", models, ["id"]).count() == 60_004


def sent(spark, df, broadcast="-1"):
    """Rows that df shuffles."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": broadcast}
    for k, x in conf.items():
        spark.conf.set(k, x)
    try:
        d = df()
        rows = d.collect()
        todo, n = [d._jdf.queryExecution().executedPlan()], 0
        while todo:
            at = todo.pop()
            todo += [at.children().apply(k) for k in range(at.children().size())]
            if at.nodeName() == "Exchange":
                n += at.metrics().apply("shuffleRecordsWritten").value()
        return n, rows
    finally:
        for k in conf:
            spark.conf.unset(k)


def counted(spark, df):
    """df, and how many of its rows were made."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    return df.mapInPandas(count, df.schema), seen


ROWS = "gene_id string, chr string, pos long, ref string, alt string"


def test_regression_reads_its_pairs_once(spark):
    g = spark.createDataFrame([(s, v, (s * 7 + v * 3 + s * v) % 3) for s in range(30) for v in range(20)], "sample_id int, variant_key long, dosage int")
    e = spark.createDataFrame([("c", f"g{k}", s, float((s * s + k) % 11)) for s in range(30) for k in range(4)], "cell string, gene_id string, sample_id int, y double")
    pairs, seen = counted(spark, spark.createDataFrame([(f"g{k}", v) for k in range(4) for v in range(20)] * 2, "gene_id string, variant_key long"))
    got = linkage.marginal_regression(g, e, pairs, block=6).toPandas()
    assert seen.value == 160 and len(got) > 40
    d = g.toPandas().merge(e.toPandas(), on="sample_id")
    for r in got.itertuples():
        x = d[(d["gene_id"] == r.gene_id) & (d["variant_key"] == r.variant_key)]
        assert r.n == 30 and abs(r.slope - np.polyfit(x["dosage"], x["y"], 1)[0]) < 1e-9


def test_training_rows_meet_their_features_once(spark):
    d = spark.createDataFrame([(f"g{k % 3}", "chr1", k, "A", "C", k) for k in range(600)], ROWS + ", k int")
    cand, seen = counted(spark, d.where("k >= 20"))
    features, made = counted(spark, d.where("k % 2 = 0").select("gene_id", *A.ALLELES, (F.col("k") * 2).alias("f")))
    got = M.training_set(d.where("k < 20"), cand, [F.col("k")], 3, features).collect()
    assert seen.value == 580 and made.value == 300
    assert sorted(r.k for r in got if r.label) == list(range(0, 20, 2)) and all(r.f == 2 * r.k for r in got) and len(got) == 40


def test_only_annotated_variants_are_summarized(spark):
    """Of 3,000 variants 30 are annotated: best rows, peaks and tracks of the others are not shuffled."""
    d = spark.createDataFrame([(f"g{k % 2}", "chr1", k * 100, "A", "C", k / 3000, k, "c", "a", 1) for k in range(3000)], ROWS + ", pip double, k int, cell string, assay string, track int")
    at = spark.createDataFrame([("x", "chr1", 0, 2950)], "annotation string, chr string, start_pos long, end_pos long")
    genes = spark.createDataFrame([("g0", 10), ("g1", 20)], "gene_id string, gene_tss long")
    links = spark.createDataFrame([("g0", "chr1", "c", 0, 500, 0.5)], "gene_id string, chr string, cell string, start_pos long, end_pos long, abc_score double")
    lists = spark.createDataFrame([("c", 1)], "cell string, track int")
    n, rows = sent(spark, lambda: M.gene_feature_table(d, [F.col("k")], at, genes, links, {"s": "c"}, d, (["c"], ["pip"], ["a"]), d.select(*A.ALLELES, "track", F.col("pip").alias("v")), lists, ("c",)), "10MB")
    assert n < 1000 and sorted(r.k for r in rows) == list(range(1, 30)) and all(r.c_pip_max_a == r.max_c_TF_score == r.pip for r in rows)


def test_bases_are_looked_up_for_scores_only(spark):
    """Of 4,000 variants 40 have a score and none of training: only those go to the tiles."""
    v = spark.createDataFrame([("chr1", k + 10, "A", "C") for k in range(4000)] + [("chr1", 5, None, "C")], "chr string, pos long, ref string, alt string")
    training = v.where("pos % 100 < 50").select("*", F.lit(2.0).alias("llr"))
    scores = v.where("pos % 50 = 0").select("*", F.lit(1.0).alias("llr"))
    tiles = spark.createDataFrame([("chr1", t, "ACGTA" * 20) for t in range(50)], "chr string, tile long, seq string")
    neutral = spark.createDataFrame([("GTAAC_C", 0.25)], "context string, llr double")
    n, rows = sent(spark, lambda: features.llr_lookup(v, training, scores, neutral, tiles, 100))
    got = {r.pos: (r.gpn_star_llr, r.source) for r in rows}
    assert n < 1000 and len(got) == 4001
    assert all(got[p] == ((2.0, "training") if p % 100 < 50 else (1.25, "scores") if p % 50 == 0 else (None, "none")) for p in range(10, 4010)) and got[5] == (None, "none")


def test_link_scores_shuffle_a_pair_once(spark):
    v = spark.createDataFrame([(f"g{k % 5}", "chr1", k * 5000, "A", "C") for k in range(1000)], ROWS)
    links = spark.createDataFrame([("g1", "chr1", c, 5000, 5100, s) for c, s in (("c0", 0.5), ("c0", 0.7), ("c3", 0.2), ("other", 0.9))], "gene_id string, chr string, cell string, start_pos long, end_pos long, abc_score double")
    cells = [f"c{k}" for k in range(10)]
    n, rows = sent(spark, lambda: J.max_link_score(v, links, cells))
    assert n < 5000 and len(rows) == 10_000 and {(r.pos, r.cell): r.abc_score for r in rows if r.abc_score} == {(5000, "c0"): 0.7, (5000, "c3"): 0.2}


def test_samples_go_to_the_variants(spark):
    """Making genotypes broadcasts the samples, not the variants, and needs no shuffle to bring the rows of a variant together."""
    d = fixtures.fixture(spark, "/root/testdata/sf0.001", "fx_geno").groupBy("variant_key").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = d.select("*")
        n = len(d.collect())
        todo, broadcast, shuffled = [d._jdf.queryExecution().executedPlan()], [], []
        while todo:
            at = todo.pop()
            todo += [at.children().apply(k) for k in range(at.children().size())]
            if at.nodeName() == "BroadcastExchange":
                broadcast.append(at.metrics().apply("numOutputRows").value())
            if at.nodeName() == "Exchange":
                shuffled.append(at.metrics().apply("shuffleRecordsWritten").value())
        assert n == 200 and broadcast and max(broadcast) <= 64 and max(shuffled) <= 200
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_genes_share_the_dosages_of_a_variant(spark, monkeypatch):
    """Forty genes ask for the same 50 variants: their dosages are sent once, not 2,000 times. Groups and slices of any size give the same rows."""
    x = np.random.default_rng(8).integers(0, 3, (50, 30)).astype(float)
    x[::7] += 0.25  # imputed
    x[3, 5] = np.nan
    g = spark.createDataFrame([(s, v, None if np.isnan(x[v, s]) else float(x[v, s])) for s in range(30) for v in range(50)], "sample_id int, variant_key long, dosage double")
    e = spark.createDataFrame([("c", f"g{k}", s, float((s * s + 3 * k) % 11)) for s in range(30) for k in range(40)], "cell string, gene_id string, sample_id int, y double")
    pairs = spark.createDataFrame([(f"g{k}", v) for k in range(40) for v in range(50)] * 2, "gene_id string, variant_key long")
    seen, real = spark.sparkContext.accumulator(0), linkage._regress

    def counting(*how):
        run = real(*how)

        def regress(left, right):
            seen.add(len(left))
            return run(left, right)

        return regress

    monkeypatch.setattr(linkage, "_regress", counting)
    got = {(r.gene_id, r.variant_key): (r.slope, r.n) for r in linkage.marginal_regression(g, e, pairs).collect()}
    assert seen.value == 50 and len(got) > 1500
    for (gene, v), (slope, n) in list(got.items())[::37]:
        at = ~np.isnan(x[v])
        y = np.array([(s * s + 3 * int(gene[1:])) % 11 for s in range(30)])
        assert n == at.sum() and abs(slope - np.polyfit(x[v][at], y[at], 1)[0]) < 1e-9
    for block, at_once in ((7, 20), (1024, 300)):
        again = {(r.gene_id, r.variant_key): (r.slope, r.n) for r in linkage.marginal_regression(g, e, pairs, block=block, at_once=at_once).collect()}
        assert again.keys() == got.keys() and all(np.allclose(again[k], got[k]) for k in got)


def test_dosages_as_bytes(spark):
    v = np.array([[0, 1, 2, np.nan, 1], [0.5, 1, 2, np.nan, 7], [2, 2, 2, 2, 2]], float)
    rows = linkage.to_bytes(v)
    assert [len(r) for r in rows] == [3, 41, 3]
    for k in ([0, 1, 2], [0, 2], [1]):
        d = linkage.from_bytes([rows[i] for i in k])
        assert np.array_equal(d[:, :5], v[k], equal_nan=True) and np.isnan(d[:, 5:]).all()
    assert linkage.from_bytes([]).shape == (0, 0)


def test_pairs_of_variants_are_made_once(spark, monkeypatch):
    """Scores read genotypes twice (the samples, the dosages) and make each product once, for both variants of a pair."""
    x = np.random.default_rng(3).integers(0, 3, (60, 20))
    g, seen = counted(spark, spark.createDataFrame([(s, "chr1", v * 100, v, int(x[v, s])) for v in range(60) for s in range(20)], "sample_id int, chr string, pos long, variant_key long, dosage int"))
    notes = spark.createDataFrame([("chr1", v, "a") for v in range(60)], "chr string, key long, annotation string")
    made, real = spark.sparkContext.accumulator(0), linkage._block_pair

    def counting(*how):
        run = real(*how)

        def block_pair(rows):
            made.add(1)
            return run(rows)

        return block_pair

    monkeypatch.setattr(linkage, "_block_pair", counting)
    d = linkage.ld_scores(linkage.ld_pairs(g, 1000, 0.0), notes)
    got = {r.key1: r.ld_score for r in d.collect()}
    r2 = np.corrcoef(x) ** 2
    assert all(abs(got[v] - sum(r2[v, u] for u in range(60) if abs(u - v) <= 10)) < 1e-9 for v in range(60))
    assert seen.value == 2 * 1200 and made.value == 1


def test_sets_are_made_once(spark):
    fit, seen = counted(spark, spark.createDataFrame([(f"g{k}", v, 0.25) for k in range(50) for v in range(4)], "gene_id string, variant_key long, alpha double"))
    pairs = spark.createDataFrame([(a, b, 0.5 + a / 10) for a in range(4) for b in range(a + 1, 4)], "key1 long, key2 long, r double")
    got = I.pure_sets(fit, ["gene_id"], pairs).collect()
    assert seen.value == 200 and len(got) == 50 and all((r.size, r.purity) == (4, 0.5) for r in got)


def test_every_chromosome_has_its_published_trees(spark, monkeypatch):
    """M7_score_folds scores with 1,000 trees a chromosome; all rows are scored."""
    asked, real = [], folds.score_forests

    def score(df, fold, forests, *how):
        asked.append((forests.folds, forests.feature.shape))
        return real(df, fold, forests, *how)

    monkeypatch.setattr(folds, "score_forests", score)
    rows = registry.QUERIES["M7_score_folds"](spark, "/root/testdata/sf0.001").collect()
    chroms = sorted({int(r.chrom[3:]) for r in rows})
    assert len(rows) == fixtures.fixture(spark, "/root/testdata/sf0.001", "fx_scored").count() and all(r.in_range for r in rows)
    assert asked == [(chroms, (len(chroms), 1000, 63))] and len(chroms) > 4


def test_folds_boosted_together_have_the_trees_of_spark(spark):
    """Fitted a fold a task or spread in blocks, the probabilities are those of Spark ML's boosting, also where few rows are of a kind."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, int(rng.random() < 0.2 + 0.5 * (i % 5 == 0)), float(i % 5), float(round(rng.normal() * 2)), 1.0 + i % 2) for i in range(1500)]
    d = folds.assembled(spark.createDataFrame(rows, "id long, fold int, y int, u double, v double, w double"), ["u", "v"])
    how = {"maxIter": 6, "maxDepth": 4}
    want = {r.id: r.pred_prob for r in folds.score_folds(d, "fold", folds.train_folds(d, "fold", [0, 1, 2], "y", "w", **how), ["id"]).collect()}
    for together, most in ((0, 5), (300_000, 100_000)):
        forests = folds.boost_folds(d, "fold", [0, 1, 2], "y", "w", together=together, every=2, block=40, **how)
        got = {r.id: r.pred_prob for r in folds.score_forests(d, "fold", forests, ["id"], most=most).collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-9 and len(set(got.values())) > 20
    # A feature of many values is cut at quantiles, alike both ways.
    d = folds.assembled(spark.createDataFrame([(i, i % 2, int(x + 0.3 * rng.normal() > 0), float(x), 1.0) for i, x in enumerate(rng.normal(size=600))], "id long, fold int, y int, u double, w double"), ["u"])
    p = [{r.id: (r.p, r.y) for r in folds.score_forests(d, "fold", folds.boost_folds(d, "fold", [0, 1], "y", "w", together=k, block=100, maxIter=3), ["id", "y"], "p").collect()} for k in (0, 300_000)]
    assert p[0].keys() == p[1].keys() and max(abs(p[0][k][0] - p[1][k][0]) for k in p[0]) < 1e-9 and len({x for x, _ in p[0].values()}) > 20
    right = [(x > 0.5) == y for x, y in p[0].values()]
    assert len(right) == 600 and np.mean(right) > 0.85
