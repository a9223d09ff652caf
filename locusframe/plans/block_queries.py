"""Registered queries of operators/crosscell.py and linkage.py, of resampling, releases and held-out trees, with independent SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from locusframe.operators import aggregates as A
from locusframe.operators import crosscell as X
from locusframe.operators import folds
from locusframe.operators import inference as I
from locusframe.operators import linkage as L
from locusframe.operators import study as S
from locusframe.plans.registry import AL, ALLELES, VID, query, r6
from locusframe.plans.study_queries import CELLS
from locusframe.plans.table_queries import NLP
from locusframe.sources import files
from locusframe.sources.shared import shared_folder, written

# --- colocalization between cells ------------------------------------------------------------------------------------

PRIORS = ["uniform", "EMS"]
_FITS = """fm AS MATERIALIZED (SELECT gene_id, 'uniform' AS prior, cell, effect, variant_key, lbf FROM fx_fit UNION ALL SELECT gene_id, 'EMS', cell, effect, variant_key, CASE WHEN gene_id LIKE '%3' AND cell = 'cell0' AND effect = 2 THEN NULL ELSE lbf END FROM fx_fit
  WHERE NOT (gene_id LIKE '%7' AND cell = 'cell2') AND NOT (gene_id LIKE '%1' AND cell = 'cell1' AND variant_key % 16 <> 0)),
 m1 AS (SELECT *, MAX(lbf) OVER e AS mx FROM fm WHERE lbf IS NOT NULL WINDOW e AS (PARTITION BY gene_id, prior, cell, effect)), m2 AS (SELECT *, EXP(lbf - mx) / SUM(EXP(lbf - mx)) OVER (PARTITION BY gene_id, prior, cell, effect) AS alpha FROM m1),
 m3 AS (SELECT *, COALESCE(SUM(alpha) OVER (PARTITION BY gene_id, prior, cell, effect ORDER BY alpha DESC, variant_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m2),
 mem AS MATERIALIZED (SELECT gene_id, prior, cell, effect AS idx, variant_key, alpha FROM m3 WHERE b < CASE WHEN prior = 'EMS' THEN 0.02 ELSE 0.5 END AND NOT (gene_id LIKE '%4' AND cell = 'cell1')),
 sl AS (SELECT gene_id, prior, cell FROM (SELECT DISTINCT gene_id FROM fx_gene) g, (SELECT UNNEST(['uniform', 'EMS']) AS prior), (SELECT UNNEST(['cell0', 'cell1', 'cell2']) AS cell)),
 st AS MATERIALIZED (SELECT sl.*, CASE WHEN n IS NULL THEN 'no fit' WHEN bad THEN 'unreadable fit' WHEN k IS NULL THEN 'no credible set' ELSE 'ok' END AS status FROM sl LEFT JOIN (SELECT gene_id, prior, cell, COUNT(*) AS n, BOOL_OR(lbf IS NULL) AS bad FROM fm GROUP BY ALL) f USING (gene_id, prior, cell)
  LEFT JOIN (SELECT gene_id, prior, cell, COUNT(*) AS k FROM mem GROUP BY ALL) s USING (gene_id, prior, cell)),
 v AS MATERIALIZED (SELECT DISTINCT gene_id, prior, cell, variant_key FROM fm JOIN st USING (gene_id, prior, cell) WHERE status = 'ok'),
 sh AS (SELECT x.gene_id, x.prior, x.cell, y.cell AS other_cell, COUNT(*) AS n FROM v x JOIN v y ON x.gene_id = y.gene_id AND x.prior = y.prior AND x.variant_key = y.variant_key AND x.cell <> y.cell GROUP BY ALL),
 lf AS MATERIALIZED (SELECT DISTINCT m.gene_id, m.prior, m.cell, y.cell AS other_cell, m.idx FROM mem m JOIN v y ON m.gene_id = y.gene_id AND m.prior = y.prior AND m.variant_key = y.variant_key AND m.cell <> y.cell),
 lp AS (SELECT DISTINCT gene_id, prior, cell, other_cell FROM lf),
 nt AS MATERIALIZED (SELECT a.gene_id, a.prior, a.cell, b.cell AS other_cell, CASE WHEN b.status <> 'ok' THEN b.status || ' in other cell' WHEN COALESCE(n, 0) < 10 THEN 'fewer than 10 shared variants' WHEN p.cell IS NULL OR q.cell IS NULL THEN 'credible set has no shared variants' END AS note
  FROM st a JOIN st b ON a.gene_id = b.gene_id AND a.prior = b.prior AND a.cell <> b.cell AND a.status = 'ok' LEFT JOIN sh ON sh.gene_id = a.gene_id AND sh.prior = a.prior AND sh.cell = a.cell AND sh.other_cell = b.cell
  LEFT JOIN lp p ON p.gene_id = a.gene_id AND p.prior = a.prior AND p.cell = a.cell AND p.other_cell = b.cell LEFT JOIN lp q ON q.gene_id = a.gene_id AND q.prior = a.prior AND q.cell = b.cell AND q.other_cell = a.cell),
 t AS MATERIALIZED (SELECT nt.gene_id, nt.prior, nt.cell, nt.other_cell, a.idx, b.idx AS other_idx FROM nt JOIN lf a ON a.gene_id = nt.gene_id AND a.prior = nt.prior AND a.cell = nt.cell AND a.other_cell = nt.other_cell
  JOIN lf b ON b.gene_id = nt.gene_id AND b.prior = nt.prior AND b.cell = nt.other_cell AND b.other_cell = nt.cell WHERE note IS NULL),
 ja AS MATERIALIZED (SELECT t.*, a.variant_key, a.lbf AS l1 FROM t JOIN fm a ON a.gene_id = t.gene_id AND a.prior = t.prior AND a.cell = t.cell AND a.effect = t.idx),
 j AS (SELECT ja.*, b.lbf AS l2 FROM ja JOIN fm b ON b.gene_id = ja.gene_id AND b.prior = ja.prior AND b.cell = ja.other_cell AND b.effect = ja.other_idx AND b.variant_key = ja.variant_key),
 s AS MATERIALIZED (SELECT gene_id, prior, cell, other_cell, idx, other_idx, COUNT(*) AS nsnps, SUM(EXP(l1)) AS e1, SUM(EXP(l2)) AS e2, SUM(EXP(l1 + l2)) AS e12 FROM j GROUP BY ALL),
 h AS (SELECT *, CAST(1e-4 AS DOUBLE) * e1 AS h1, CAST(1e-4 AS DOUBLE) * e2 AS h2, CAST(1e-8 AS DOUBLE) * (e1 * e2 - e12) AS h3, CAST(5e-6 AS DOUBLE) * e12 AS h4 FROM s),
 xc AS (SELECT gene_id, prior, cell, idx, other_cell, other_idx, CAST(NULL AS VARCHAR) AS note, nsnps, h3 / (1 + h1 + h2 + h3 + h4) AS p3, h4 / (1 + h1 + h2 + h3 + h4) AS p4 FROM h
  UNION ALL SELECT gene_id, prior, cell, NULL, NULL, NULL, status, NULL, NULL, NULL FROM st WHERE status <> 'ok'
  UNION ALL SELECT DISTINCT gene_id, prior, cell, idx, NULL, NULL, 'focal credible set', CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM mem JOIN st USING (gene_id, prior, cell) WHERE status = 'ok'
  UNION ALL SELECT gene_id, prior, cell, NULL, other_cell, NULL, note, NULL, NULL, NULL FROM nt WHERE note IS NOT NULL
  UNION ALL SELECT gene_id, prior, cell, NULL, other_cell, NULL, 'coloc returned no result', NULL, NULL, NULL FROM nt WHERE note IS NULL AND (gene_id, prior, cell, other_cell) NOT IN (SELECT (gene_id, prior, cell, other_cell) FROM s))"""


def _fitted(f):
    """Fits of two priors, some missing, broken, thin or without a set, and the members of their sets (A28, A14); each is computed once and written."""
    broken = F.col("gene_id").like("%3") & (F.col("cell") == "cell0") & (F.col("effect") == 2)
    ems = F.expr("not (gene_id like '%7' and cell = 'cell2') and not (gene_id like '%1' and cell = 'cell1' and variant_key % 16 <> 0)")
    fits = f.withColumn("prior", F.explode(F.when(ems, F.array(F.lit("uniform"), F.lit("EMS"))).otherwise(F.array(F.lit("uniform")))))
    fits = fits.select("gene_id", "prior", "cell", "effect", "variant_key", F.when((F.col("prior") == "uniform") | ~broken, F.col("lbf")).alias("lbf"))
    fits = written(fits, "crosscell-fits")
    key = ["gene_id", "prior", "cell", "effect"]
    alpha = A.softmax(fits.where("lbf is not null"), key, "lbf")
    members = A.credible_set(alpha, key, F.when(F.col("prior") == "EMS", 0.02).otherwise(0.5)).where("not (gene_id like '%4' and cell = 'cell1')")
    return fits, written(members, "crosscell-members")


def _crosscell(f, g):
    fits, members = _fitted(f)
    return X.crosscell_rows(g, fits, members.withColumnRenamed("effect", "idx"), PRIORS, CELLS)


@query("A29_crosscell_rows", f"WITH {_FITS} SELECT gene_id, prior, cell, idx, other_cell, other_idx, note, nsnps, ROUND(p3, 6) AS pp_h3, ROUND(p4, 6) AS pp_h4 FROM xc", "fx_fit", "fx_gene")
def _(f, g):
    return _crosscell(f, g).select("gene_id", "prior", "cell", "idx", "other_cell", "other_idx", "note", "nsnps", r6("pp_h3"), r6("pp_h4"))


_SHARED = """, te AS (SELECT gene_id, prior, cell, idx, COUNT(DISTINCT other_cell) AS n, MAX(p4) AS mx FROM xc WHERE note IS NULL GROUP BY ALL),
 cs AS (SELECT x.gene_id, x.prior, x.cell, x.idx, COALESCE(n, 0) AS n, mx, COALESCE(CAST(mx > 0.01 AS INT), 0) AS shared FROM xc x LEFT JOIN te USING (gene_id, prior, cell, idx) WHERE note = 'focal credible set')"""


@query("A19_crosscell_from_fits", f"""WITH {_FITS}{_SHARED}, q AS (SELECT prior, cell, COUNT(*) AS n_cs, CAST(SUM(shared) AS BIGINT) AS n_cs_shared, COUNT(*) FILTER (n > 0) AS n_cs_with_partner, COUNT(DISTINCT gene_id) AS n_egenes_with_cs,
 COUNT(DISTINCT CASE WHEN shared = 1 THEN gene_id END) AS n_egenes_shared FROM cs GROUP BY ALL),
 ft AS (SELECT prior, cell, COUNT(DISTINCT gene_id) AS n_egenes_fit FROM xc WHERE note IN ('focal credible set', 'no credible set') GROUP BY ALL),
 rf AS (SELECT prior, cell, COUNT(DISTINCT (gene_id, idx)) AS n_cs_ref FROM mem JOIN st USING (gene_id, prior, cell) WHERE status = 'ok' GROUP BY ALL)
SELECT q.*, n_egenes_fit, ROUND(100 * n_cs_shared / CAST(n_cs AS DOUBLE), 1) AS pct_cs_shared, ROUND(100 * n_cs_shared / CAST(NULLIF(n_cs_with_partner, 0) AS DOUBLE), 1) AS pct_cs_shared_with_partner, ROUND(100 * n_egenes_shared / CAST(n_egenes_with_cs AS DOUBLE), 1) AS pct_egenes_shared,
 n_cs_ref FROM q JOIN ft USING (prior, cell) JOIN rf USING (prior, cell)""", "fx_fit", "fx_gene")  # fmt: skip
def _(f, g):
    """From fits to the sharing of credible sets: A28 and A14, then A29, then A19, and the set counts that must agree."""
    fits, members = _fitted(f)
    members = members.withColumnRenamed("effect", "idx")
    rows = X.crosscell_rows(g, fits, members, PRIORS, CELLS).withColumnRenamed("pp_h4", "h4")
    summary = S.crosscell_summary(rows, 0.01, ["prior", "cell"])
    usable = X.fit_status(g, fits, members, PRIORS, CELLS).where("status = 'ok'")
    sets = A.set_table(members, ["gene_id", "prior", "cell", "idx"]).join(usable, X.FIT, "left_semi")
    return summary.join(sets.groupBy("prior", "cell").agg(F.count("*").alias("n_cs_ref")), ["prior", "cell"])


@query("A19_crosscell_sets_from_fits", f"""WITH {_FITS}{_SHARED}, z AS (SELECT gene_id, prior, cell, idx, COUNT(*) AS size, MAX(alpha) AS top_pip FROM mem GROUP BY ALL)
SELECT gene_id, prior, cell, idx, n AS n_other_tested, ROUND(mx, 6) AS max_h4, shared, size AS cs_size, ROUND(top_pip, 6) AS top_pip FROM cs JOIN z USING (gene_id, prior, cell, idx)""", "fx_fit", "fx_gene")
def _(f, g):
    fits, members = _fitted(f)
    members = members.withColumnRenamed("effect", "idx")
    rows = X.crosscell_rows(g, fits, members, PRIORS, CELLS).withColumnRenamed("pp_h4", "h4")
    key = ["gene_id", "prior", "cell", "idx"]
    out = S.crosscell_sets(rows, 0.01, ["prior", "cell"]).join(A.set_table(members, key).withColumnRenamed("size", "cs_size"), key)
    return out.select(*key, "n_other_tested", r6("max_h4"), "shared", "cs_size", r6("top_pip"))


# --- linkage by blocks -----------------------------------------------------------------------------------------------

#: Variants of three chromosomes in runs of five (the fixture correlates those), 500 bases apart.
_GENO = "gn AS (SELECT sample_id, variant_key, dosage, CONCAT('chr', CAST(CAST(FLOOR(variant_key / 5) AS BIGINT) % 3 + 1 AS STRING)) AS chr, variant_key * 500 + 1000 AS pos FROM fx_geno)"
_LD = _GENO + """, p AS (SELECT a.chr, a.variant_key AS key1, b.variant_key AS key2, a.pos AS pos1, b.pos AS pos2, COUNT(*) AS n, SUM(a.dosage) AS sx, SUM(b.dosage) AS sy, SUM(a.dosage * b.dosage) AS sxy, SUM(a.dosage * a.dosage) AS sxx, SUM(b.dosage * b.dosage) AS syy
  FROM gn a JOIN gn b ON a.dosage IS NOT NULL AND b.dosage IS NOT NULL AND a.sample_id = b.sample_id AND a.chr = b.chr AND a.variant_key < b.variant_key AND b.variant_key <= a.variant_key + 60 GROUP BY ALL),
 r AS (SELECT chr, key1, key2, pos1, pos2, CASE WHEN n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN CAST(n * sxy - sx * sy AS DOUBLE) / SQRT(CAST(n * sxx - sx * sx AS DOUBLE) * CAST(n * syy - sy * sy AS DOUBLE)) ELSE 0 END AS r FROM p)"""


def _placed(g):
    return g.select("sample_id", "variant_key", "dosage", F.concat(F.lit("chr"), (F.floor(F.col("variant_key") / 5) % 3 + 1).cast("string")).alias("chr"), (F.col("variant_key") * 500 + 1000).alias("pos"))


@query("A31_ld_pairs", f"WITH {_LD} SELECT chr, key1, key2, pos1, pos2, ROUND(r, 6) AS r FROM r WHERE r * r >= 0.001", "fx_geno")
def _(g):
    return L.ld_pairs(_placed(g), 30_000).select("chr", "key1", "key2", "pos1", "pos2", r6("r"))


@query("A32_ld_scores", f"""WITH {_LD}, b AS (SELECT chr, key1, key2 AS key, r FROM r WHERE r * r >= 0.001 UNION ALL SELECT chr, key2, key1, r FROM r WHERE r * r >= 0.001 UNION ALL SELECT DISTINCT chr, variant_key, variant_key, 1.0 FROM gn)
SELECT chr, key1, CONCAT('a', CAST(key % 3 AS STRING)) AS annotation, ROUND(SUM(r * r), 5) AS ld_score FROM b GROUP BY ALL""", "fx_geno")
def _(g):
    g = _placed(g)
    notes = g.select("chr", F.col("variant_key").alias("key"), F.concat(F.lit("a"), (F.col("variant_key") % 3).cast("string")).alias("annotation")).distinct()
    return L.ld_scores(L.ld_pairs(g, 30_000), notes).select("chr", "key1", "annotation", F.round("ld_score", 5).alias("ld_score"))


@query("A28_pure_sets", f"""WITH {_LD}, f AS (SELECT CONCAT('L', CAST(CAST(FLOOR(variant_key / 5) AS BIGINT) AS STRING)) AS gene_id, cell, variant_key, MAX(lbf) AS lbf FROM fx_fit GROUP BY ALL),
 m AS (SELECT *, MAX(lbf) OVER (PARTITION BY gene_id, cell) AS mx FROM f), al AS (SELECT *, EXP(lbf - mx) / SUM(EXP(lbf - mx)) OVER (PARTITION BY gene_id, cell) AS alpha FROM m),
 cu AS (SELECT *, COALESCE(SUM(alpha) OVER (PARTITION BY gene_id, cell ORDER BY alpha DESC, variant_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM al), c AS (SELECT * FROM cu WHERE b < 0.95),
 z AS (SELECT gene_id, cell, COUNT(*) AS size, SUM(alpha) AS coverage FROM c GROUP BY ALL),
 k AS (SELECT a.gene_id, a.cell, COUNT(r) AS n, COUNT(*) AS wanted, MIN(ABS(COALESCE(r, 0))) AS least FROM c a JOIN c b ON a.gene_id = b.gene_id AND a.cell = b.cell AND a.variant_key < b.variant_key LEFT JOIN r ON r.key1 = a.variant_key AND r.key2 = b.variant_key AND r.r * r.r >= 0.001 GROUP BY ALL)
SELECT gene_id, cell, size, ROUND(coverage, 6) AS coverage, ROUND(CASE WHEN size = 1 THEN 1 ELSE least END, 6) AS purity FROM z LEFT JOIN k USING (gene_id, cell) WHERE size = 1 OR least >= 0.5""", "fx_fit", "fx_geno")  # fmt: skip
def _(f, g):
    """Single-effect fits of neighbouring variants, their 0.95 sets, and the sets' purity from the sparse LD pairs of the same variants."""
    local = f.groupBy(F.concat(F.lit("L"), F.floor(F.col("variant_key") / 5).cast("string")).alias("gene_id"), "cell", "variant_key").agg(F.max("lbf").alias("lbf"))
    fit = A.softmax(local, ["gene_id", "cell"], "lbf")
    out = I.pure_sets(fit, ["gene_id", "cell"], L.ld_pairs(_placed(g), 30_000))
    return out.select("gene_id", "cell", "size", r6("coverage"), r6("purity"))


_REG = f"""ch AS (SELECT DISTINCT cell, sample_id FROM fx_expr_cell), cz AS (SELECT cell, COUNT(*) AS size FROM ch GROUP BY 1),
 ty AS (SELECT cell, variant_key FROM fx_geno JOIN ch USING (sample_id) JOIN cz USING (cell) WHERE dosage IS NOT NULL GROUP BY cell, variant_key, size HAVING LEAST(SUM(dosage), 2 * COUNT(*) - SUM(dosage)) >= GREATEST(10, 0.001 * 2 * COUNT(*)) AND 1 - COUNT(*) / CAST(size AS DOUBLE) <= 0.1),
 pa AS (SELECT DISTINCT gene_id, CAST((pos - 1000) / 500 AS BIGINT) AS variant_key FROM fx_pip),
 s AS (SELECT cell, gene_id, variant_key, REGR_SLOPE(y, dosage) AS slope, REGR_SXX(y, dosage) AS sxx, REGR_SYY(y, dosage) AS syy, COUNT(*) AS n FROM pa JOIN ty USING (variant_key) JOIN fx_expr_cell USING (cell, gene_id) JOIN fx_geno USING (variant_key, sample_id) WHERE dosage IS NOT NULL GROUP BY ALL),
 q AS (SELECT *, SQRT(GREATEST(syy - slope * slope * sxx, 0) / (n - 2) / sxx) AS se FROM s WHERE sxx > 0 AND n > 2), q2 AS (SELECT *, CASE WHEN se > 0 THEN slope / se END AS z FROM q)"""


@query("A30_marginal_regression", f"WITH {_REG} SELECT cell, gene_id, variant_key, ROUND(slope + 0.0137, 1) AS slope, ROUND(se, 1) AS se, ROUND(z, 4) AS z, ROUND(CAST({NLP} AS DOUBLE), 4) AS neglog10p, n FROM q2", "fx_geno", "fx_expr_cell", "fx_pip")
def _(g, e, d):
    pairs = d.select("gene_id", ((F.col("pos") - 1000) / 500).cast("bigint").alias("variant_key"))
    out = L.marginal_regression(g, e, pairs)
    # Slopes of few samples are short decimals: the shift keeps them off the ties of rounding.
    return out.select("cell", "gene_id", "variant_key", F.round(F.col("slope") + 0.0137, 1).alias("slope"), F.round("se", 1).alias("se"), F.round("z", 4).alias("z"), F.round("neglog10p", 4).alias("neglog10p"), "n")


# --- resampling ------------------------------------------------------------------------------------------------------


@query("A21_paired_bootstrap", None, "fx_scored")
def _(d):
    return I.paired_bootstrap(I.with_arm(d, F.col("l_linenumber") < 5, "snv"), ["arm"], "y_true", "pred_a", "pred_b", replicates=2000)


def fixed_draws(seeds, counts, replicates):
    """Weights from a formula, so that SQL can draw the same: counts times 0, 1 or 2 by group and replicate."""
    s, r = seeds[:, None].astype(np.int64), np.arange(1, replicates + 1, dtype=np.int64)[None]
    return counts[:, None] * ((s * 31 + r * 17 + s * r) % 7 % 3).astype(float)


_BOOT = """{n}s AS (SELECT arm, r, {s} AS sc, SUM(w * y_true) AS tp, SUM(w) AS n FROM w GROUP BY ALL), {n}c AS (SELECT *, SUM(tp) OVER o AS ctp, SUM(n) OVER o AS cn FROM {n}s WINDOW o AS (PARTITION BY arm, r ORDER BY sc DESC ROWS UNBOUNDED PRECEDING)),
 {n}p AS (SELECT arm, r, CASE WHEN SUM(tp) > 0 AND SUM(tp) < SUM(n) THEN SUM(CASE WHEN cn > 0 THEN CAST(tp AS DOUBLE) * ctp / cn ELSE 0 END) / SUM(tp) END AS ap FROM {n}c GROUP BY ALL)"""


@query("A21_bootstrap_fixed_weights", f"""WITH m AS (SELECT 'overall' AS arm, y_true, pred_a, pred_b FROM fx_scored UNION ALL SELECT 'snv', y_true, pred_a, pred_b FROM fx_scored WHERE l_linenumber < 5),
 g AS (SELECT arm, y_true, pred_a, pred_b, COUNT(*) AS k, y_true + 2 * CAST(ROUND(pred_a * 100) AS BIGINT) + 40 * CAST(ROUND(pred_b * 100) AS BIGINT) AS s FROM m GROUP BY ALL),
 w AS (SELECT g.*, r, k * ((s * 31 + r * 17 + s * r) % 7 % 3) AS w FROM g, (SELECT UNNEST(RANGE(1, 501)) AS r) t), {_BOOT.format(n="x", s="pred_a")}, {_BOOT.format(n="y", s="pred_b")},
 d AS (SELECT arm, xp.ap - yp.ap AS x FROM xp JOIN yp USING (arm, r) WHERE xp.ap IS NOT NULL AND yp.ap IS NOT NULL)
SELECT arm, ROUND(AVG(x), 9) AS delta, ROUND(QUANTILE_CONT(x, 0.025), 9) AS lo, ROUND(QUANTILE_CONT(x, 0.975), 9) AS hi, QUANTILE_CONT(x, 0.025) > 0 OR QUANTILE_CONT(x, 0.975) < 0 AS significant, COUNT(*) AS n_replicates FROM d GROUP BY arm""", "fx_scored")  # fmt: skip
def _(d):
    seed = F.col("y_true") + 2 * F.round(F.col("pred_a") * 100).cast("bigint") + 40 * F.round(F.col("pred_b") * 100).cast("bigint")
    out = I.paired_bootstrap(I.with_arm(d, F.col("l_linenumber") < 5, "snv"), ["arm"], "y_true", "pred_a", "pred_b", 500, seed, fixed_draws)
    return out.select("arm", *[F.round(c, 9).alias(c) for c in ("delta", "lo", "hi")], "significant", "n_replicates")


# --- releases --------------------------------------------------------------------------------------------------------

_SETKEY = ["cell", "gene_id", "cs_idx"]


def _release(d, shift):
    """Variant rows and set rows of a release; `shift` moves the values, as a rerun would."""
    v = d.where("cs95 > 0 and pip > 0.3").groupBy("cell", "gene_id", F.col("cs95").alias("cs_idx"), *ALLELES).agg(F.max("pip").alias("pip"))
    v = v.withColumns({"pip": F.col("pip") + shift, "alpha": F.col("pip") / 2, "lbf_variable": F.log(F.col("pip")), "prior_weight": F.lit(0.5)})
    s = v.groupBy(*_SETKEY).agg(F.count("*").alias("cs_size"), F.min("pip").alias("min_abs_corr"), F.max("pip").alias("coverage"), F.count("*").cast("double").alias("lbf"))
    return I.release_sets(v, s, ["cell"])


@query("S10_release_upsert", f"""WITH v AS (SELECT cell, gene_id, cs95, {AL}, MAX(pip) + MAX(CASE WHEN cell = 'cell1' THEN 1 ELSE 0 END) AS p, MAX(pip) AS q FROM fx_pip WHERE cs95 > 0 AND pip > 0.3 GROUP BY ALL)
SELECT cell, SUBSTR(chr, 4) AS "CHROM", pos AS "POS", {VID} AS "ID", ref AS "REF", alt AS "ALT", gene_id AS "GENE_ID", cs95 AS "CS_INDEX", COUNT(*) OVER s AS "CS_SIZE", ROUND(MIN(p) OVER s, 6) AS "CS_PURITY", ROUND(MAX(p) OVER s, 6) AS "CS_COVERAGE", ROUND(p, 6) AS "PIP", ROUND(q / 2, 6) AS "ALPHA"
FROM v WINDOW s AS (PARTITION BY cell, gene_id, cs95)""", "fx_pip")  # fmt: skip
def _(d):
    """A whole release, then a rerun of one cell with other values: only that cell's partitions are replaced."""
    at = shared_folder(d.sparkSession, "release-sets")
    files.write_release(_release(d, 0.0), at, ["cell"])
    files.write_release(_release(d, 1.0).where("cell = 'cell1'"), at, ["cell"])
    out = d.sparkSession.read.parquet(at).withColumn("CHROM", F.col("CHROM").cast("string"))
    return out.select("cell", "CHROM", "POS", "ID", "REF", "ALT", "GENE_ID", "CS_INDEX", "CS_SIZE", r6("CS_PURITY"), r6("CS_COVERAGE"), r6("PIP"), r6("ALPHA"))


@query("S10_release_count_upsert", """WITH v AS (SELECT DISTINCT cell, gene_id, cs95, chr, pos, ref, alt FROM fx_pip WHERE cs95 > 0 AND pip > 0.3), w AS (SELECT * FROM v WHERE cell <> 'cell1' OR cs95 = 1)
SELECT cell, COUNT(DISTINCT gene_id) AS genes, COUNT(DISTINCT (gene_id, cs95)) AS sets, COUNT(*) AS n_rows, COUNT(DISTINCT (chr, pos, ref, alt)) AS variants FROM w GROUP BY cell""", "fx_pip")
def _(d):
    at = shared_folder(d.sparkSession, "release-counts")
    released = _release(d, 0.0)
    files.write_counts(I.release_counts(released, ["cell"]), at, ["cell"])
    files.write_counts(I.release_counts(released.where("cell = 'cell1' and CS_INDEX = 1"), ["cell"]), at, ["cell"])
    return d.sparkSession.read.parquet(at).select("cell", "genes", "sets", "n_rows", "variants")


# --- held-out trees --------------------------------------------------------------------------------------------------


def _folded(d):
    d = d.withColumn("fold", F.substring("chrom", 4, 2).cast("int") % 4).withColumn("w", 1.0 + F.col("l_linenumber") % 2)
    return folds.assembled(d, ["pred_a", "pred_b"])


_SPLIT = """c AS (SELECT CAST(SUBSTR(chrom, 4) AS INT) % 4 AS fold, l_orderkey, l_linenumber, y_true, 1.0 + l_linenumber % 2 AS w, pred_a, pred_b FROM fx_scored), f AS (SELECT UNNEST([0, 1, 2, 3]) AS hold),
 tr AS (SELECT hold, w, (2 * y_true - 1) * w AS wy, pred_a, pred_b FROM c, f WHERE fold <> hold),
 v AS (SELECT hold, 0 AS feature, pred_a AS x, SUM(w) AS w, SUM(wy) AS wy FROM tr GROUP BY ALL UNION ALL SELECT hold, 1, pred_b, SUM(w), SUM(wy) FROM tr GROUP BY ALL),
 cu AS (SELECT hold, feature, (x + LEAD(x) OVER o) / 2 AS cut, SUM(w) OVER o AS lw, SUM(wy) OVER o AS ls, SUM(w) OVER p AS tw, SUM(wy) OVER p AS ts FROM v WINDOW o AS (PARTITION BY hold, feature ORDER BY x), p AS (PARTITION BY hold, feature)),
 b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY hold ORDER BY CAST(ls * ls / lw + (ts - ls) * (ts - ls) / (tw - lw) AS DOUBLE) DESC, feature, cut) AS k FROM cu WHERE cut IS NOT NULL),
 st AS (SELECT hold, feature, cut, CAST(ls AS DOUBLE) / lw AS lo, CAST(ts - ls AS DOUBLE) / (tw - lw) AS hi FROM b WHERE k = 1)"""


@query("M6_train_folds", f"""WITH {_SPLIT} SELECT hold AS fold, feature, ROUND(cut, 6) AS threshold, ROUND(lo, 6) AS low_side, ROUND(hi, 6) AS high_side FROM st""", "fx_scored")
def _(d):
    """The trees themselves, of one split so that SQL can find the same: weighted variance of the labels -1 and 1, over all cuts between neighbouring values."""
    models = folds.train_folds(_folded(d), "fold", [0, 1, 2, 3], "y_true", "w", maxIter=1, maxDepth=1)
    n = folds.node_table(d.sparkSession, models)
    leaf = n.where("left < 0").select("fold", F.col("node").alias("leaf"), F.col("prediction").alias("p"))
    side = lambda c, name: leaf.select("fold", F.col("leaf").alias(c), r6("p", name))
    return n.where("left >= 0").join(side("left", "low_side"), ["fold", "left"]).join(side("right", "high_side"), ["fold", "right"]).select("fold", "feature", r6("threshold"), "low_side", "high_side")


@query("M7_score_folds_by_node", f"""WITH {_SPLIT} SELECT l_orderkey, l_linenumber, c.fold, ROUND(1 / (1 + EXP(-2 * CASE WHEN CASE feature WHEN 0 THEN pred_a ELSE pred_b END <= cut THEN lo ELSE hi END)), 6) AS pred_prob FROM c JOIN st ON st.hold = c.fold""", "fx_scored")
def _(d):
    """Scores of the one-split trees, by the models of the held-out folds."""
    d = _folded(d)
    models = folds.train_folds(d, "fold", [0, 1, 2, 3], "y_true", "w", maxIter=1, maxDepth=1)
    return folds.score_folds(d, "fold", models, ["l_orderkey", "l_linenumber", "fold"]).select("l_orderkey", "l_linenumber", "fold", r6("pred_prob"))
