"""Registered queries of operators/features.py and operators/inference.py, with independent SQL; importing this module adds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.operators import aggregates as A
from locusframe.operators import assemblies as M
from locusframe.operators import features as X
from locusframe.operators import folds
from locusframe.operators import inference as I
from locusframe.plans.registry import AL, ALLELES, VID, query, r6, vid
from locusframe.sources.shared import written

WIDTH = 32  # of the fixture's tiles
#: One base of the fixture's genome in SQL, and the tiles joined as one long text.
LONG = "long AS MATERIALIZED (SELECT chr, tile, seq || CASE WHEN LEAD(tile) OVER w = tile + 1 THEN LEAD(seq) OVER w ELSE '' END AS s FROM fx_tile WINDOW w AS (PARTITION BY chr ORDER BY tile))"
ALL_NAMES = X.VARIANT_FEATURES + X.NOT_FEATURES


@query("P7_orient_to_reference", f"""WITH {LONG}, v AS (SELECT {AL}, COUNT(*) AS n, CAST(FLOOR((pos - 1) / 32) AS BIGINT) AS at FROM fx_pip GROUP BY ALL),
 o AS (SELECT v.*, CASE WHEN SUBSTRING(s, pos - tile * 32, LENGTH(ref)) = ref THEN 'ref' WHEN SUBSTRING(s, pos - tile * 32, LENGTH(alt)) = alt THEN 'swap' ELSE 'none' END AS orient
 FROM v LEFT JOIN long ON v.chr = long.chr AND long.tile = v.at)
SELECT chr, pos, CASE WHEN orient = 'swap' THEN alt ELSE ref END AS ref, CASE WHEN orient = 'swap' THEN ref ELSE alt END AS alt, n, orient FROM o""", "fx_pip", "fx_tile")  # fmt: skip
def _(d, tiles):
    return X.orient_to_reference(d.groupBy(*ALLELES).agg(F.count("*").alias("n")), tiles, WIDTH)


@query("J9_llr_lookup", f"""WITH {LONG}, v AS (SELECT DISTINCT {AL} FROM fx_pip), t AS (SELECT chr, pos, ref, alt, MIN(ROUND(z, 6)) AS llr FROM fx_gwas GROUP BY ALL),
 s AS (SELECT {AL}, MIN(pip) AS llr FROM fx_pip WHERE src_line = 1 GROUP BY ALL),
 n AS (SELECT SUBSTRING(seq, 14, 5) || '_C' AS context, CAST(MIN(tile) AS DOUBLE) AS llr FROM fx_tile GROUP BY 1),
 j AS (SELECT v.*, COALESCE(t1.llr, -t2.llr) AS t, s.llr + n.llr AS u, LENGTH(v.ref) = 1 AND LENGTH(v.alt) = 1 AS snv FROM v
  LEFT JOIN t t1 ON v.chr = t1.chr AND v.pos = t1.pos AND v.ref = t1.ref AND v.alt = t1.alt LEFT JOIN t t2 ON v.chr = t2.chr AND v.pos = t2.pos AND v.ref = t2.alt AND v.alt = t2.ref
  LEFT JOIN s ON v.chr = s.chr AND v.pos = s.pos AND v.ref = s.ref AND v.alt = s.alt
  LEFT JOIN long g ON v.chr = g.chr AND g.tile = CAST(FLOOR((v.pos - 3) / 32) AS BIGINT) LEFT JOIN n ON n.context = SUBSTRING(g.s, v.pos - 2 - g.tile * 32, 5) || '_' || v.alt)
SELECT {AL}, ROUND(CASE WHEN snv THEN COALESCE(t, u) END, 6) AS gpn_star_llr, CASE WHEN snv AND t IS NOT NULL THEN 'training' WHEN snv AND u IS NOT NULL THEN 'scores' ELSE 'none' END AS source FROM j""",
       "fx_pip", "fx_gwas", "fx_tile")
def _(d, g, tiles):
    tiles = written(tiles, "tiles")  # read for both halves of a sequence and for the contexts
    scores = d.where("src_line = 1").select(*ALLELES, F.col("pip").alias("llr"))
    neutral = tiles.select(F.concat(F.substring("seq", 14, 5), F.lit("_C")).alias("context"), F.col("tile").cast("double").alias("llr"))
    out = X.llr_lookup(d.select(*ALLELES).distinct(), g.select(*ALLELES, r6("z", "llr")), scores, neutral, tiles, WIDTH)
    return out.withColumn("gpn_star_llr", F.round("gpn_star_llr", 6))


def _present(d):
    extra = d.sparkSession.createDataFrame([(x,) for x in ALL_NAMES], "feature string")
    return d.select("feature").union(extra)


_GRP = "CASE grp WHEN 'distance' THEN 0 WHEN 'ABC' THEN 1 WHEN 'celltype' THEN 2 WHEN 'baseline' THEN 3 WHEN 'chrombpnet_positive' THEN 4 WHEN 'diff' THEN 5 WHEN 'tf_positive' THEN 6 END"
_VALUES = "('length_diff', 1), ('is_SNP', 2), ('is_indel', 3), ('is_insertion', 4), ('is_deletion', 5), ('gene_lof', 6), ('gnomad_MAF', 7)"


@query("P12_select_features", f"""WITH d AS (SELECT feature, MIN({_GRP} * 1000000 + position) AS p, BOOL_OR(grp IN ('diff', 'tf_positive', 'chrombpnet_positive')) AS is_abs FROM fx_dictionary GROUP BY 1
 UNION ALL SELECT name, 7000000 + p, false FROM (VALUES {_VALUES}) t(name, p))
SELECT feature, CAST(ROW_NUMBER() OVER (ORDER BY p) AS INT) AS place, is_abs FROM d""", "fx_dictionary")  # fmt: skip
def _(d):
    return X.select_features(d, _present(d))


_CAT = f"""c AS (SELECT feature, MAX(CASE grp WHEN 'distance' THEN 1 WHEN 'baseline' THEN 2 WHEN 'celltype' THEN 3 WHEN 'diff' THEN 4 WHEN 'chrombpnet_positive' THEN 5 WHEN 'ABC' THEN 6 ELSE 7 END) AS p
 FROM fx_dictionary GROUP BY 1), cat AS (SELECT feature, CASE p WHEN 1 THEN 'distance' WHEN 2 THEN 'baseline' WHEN 3 THEN 'CRE' WHEN 4 THEN 'Enformer' WHEN 5 THEN 'chromBPNet' WHEN 6 THEN 'ABC' ELSE 'TF' END AS category FROM c)"""


@query("P14_category_of", f"""WITH {_CAT} SELECT feature, category FROM cat UNION ALL SELECT name, CASE WHEN name IN ('gene_lof', 'gnomad_MAF') THEN name
 WHEN name LIKE '%distance_TSS' THEN 'other' ELSE 'variant_type' END FROM (VALUES {_VALUES}, ('abs_distance_TSS', 8), ('distance_TSS', 9)) t(name, p)""", "fx_dictionary")  # fmt: skip
def _(d):
    return X.category_of(_present(d), d)


@query("M10_category_attribution", f"""WITH {_CAT} SELECT gene_id, {AL}, category, ROUND(SUM(ABS(src_line - CAST(3.5 AS DOUBLE))), 6) AS attribution FROM fx_pip
 JOIN fx_dictionary f ON f.position * 500 + 1000 = pos JOIN cat ON cat.feature = f.feature WHERE pip > 0.1 GROUP BY ALL""", "fx_pip", "fx_dictionary")  # fmt: skip
def _(d, f):
    long = d.join(f.select("feature", (F.col("position") * 500 + 1000).alias("pos")), "pos").select("gene_id", *ALLELES, F.col("pip").alias("score"), "feature", (F.col("src_line") - 3.5).alias("attribution"))
    return X.category_attribution(long, X.category_of(f, f), ["gene_id", *ALLELES], 0.1).withColumn("attribution", F.round("attribution", 6))


_EMS = f"""e AS (SELECT variant_id, gene_id, ems, norm FROM (SELECT {VID} AS variant_id, gene_id, pip + 0.01 AS ems, (pip + 0.01) * (1 + src_line) AS norm,
 ROW_NUMBER() OVER (PARTITION BY {AL}, gene_id ORDER BY src_order, src_line) AS k FROM fx_pip WHERE cs95 = 0) t WHERE k = 1)"""


def _ems(d):
    e = d.where("cs95 = 0").select(vid().alias("variant_id"), "gene_id", (F.col("pip") + 0.01).alias("ems"), ((F.col("pip") + 0.01) * (1 + F.col("src_line"))).alias("ems_normalized"), "src_order", "src_line")
    return X.ems_rows(e, [F.col("src_order"), F.col("src_line")])


@query("J19_ems_baseline", f"WITH {_EMS} SELECT ROUND(AVG(ems / norm), 9) AS p_random FROM e", "fx_pip")
def _(d):
    return X.ems_baseline(_ems(d)).select(F.round("p_random", 9).alias("p_random"))


@query("J19_ems_coverage", f"""WITH {_EMS} SELECT w.gene_id, COUNT(*) AS n_in_window, COUNT(ems) AS n_with_ems, ROUND(COUNT(ems) / COUNT(*), 6) AS coverage
 FROM (SELECT DISTINCT gene_id, {VID} AS variant_id FROM fx_pip) w LEFT JOIN e ON w.gene_id = e.gene_id AND w.variant_id = e.variant_id GROUP BY 1""", "fx_pip")  # fmt: skip
def _(d):
    return X.ems_coverage(_ems(d), d.select("gene_id", vid().alias("variant_id"))).withColumn("coverage", F.round("coverage", 6))


_FIT = """b AS (SELECT gene_id, cell, variant_key, lbf / 2 AS z, 0.1 + variant_key % 5 * 0.02 AS se FROM fx_fit WHERE effect = 1),
 l AS (SELECT *, 0.5 * (LN(1 - 0.04 / (0.04 + se * se)) + z * z * 0.04 / (0.04 + se * se)) AS lbf FROM b),
 f AS (SELECT *, EXP(lbf - MAX(lbf) OVER w) / SUM(EXP(lbf)) OVER w * EXP(MAX(lbf) OVER w) AS alpha FROM l WINDOW w AS (PARTITION BY gene_id, cell))"""
_KEYS = ["gene_id", "cell"]


def _fit(f):
    b = f.where("effect = 1").select(*_KEYS, "variant_key", (F.col("lbf") / 2).alias("z"), (0.1 + F.col("variant_key") % 5 * 0.02).alias("se"))
    return I.single_effect(b, _KEYS, "z", "se")


@query("A28_single_effect", f"WITH {_FIT} SELECT gene_id, cell, variant_key, ROUND(lbf, 6) AS lbf, ROUND(alpha, 6) AS alpha FROM f", "fx_fit")
def _(f):
    return _fit(f).select(*_KEYS, "variant_key", r6("lbf"), r6("alpha"))


@query("A33_block_jackknife", """WITH m AS (SELECT cell, CAST(src_order % 50 AS BIGINT) AS block, SUM(1.0 + src_line) AS w, SUM((1.0 + src_line) * cs95) AS x, SUM((1.0 + src_line) * cs95 * cs95) AS xx,
 SUM((1.0 + src_line) * pip) AS y, SUM((1.0 + src_line) * cs95 * pip) AS xy FROM fx_pip GROUP BY 1, 2),
 t AS (SELECT cell, SUM(w) AS w, SUM(x) AS x, SUM(xx) AS xx, SUM(y) AS y, SUM(xy) AS xy FROM m GROUP BY 1),
 d AS (SELECT cell, NULL AS block, w, x, xx, y, xy FROM t UNION ALL SELECT m.cell, block, t.w - m.w, t.x - m.x, t.xx - m.xx, t.y - m.y, t.xy - m.xy FROM m JOIN t ON m.cell = t.cell),
 s AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS slope FROM d)
SELECT cell, block, 'cs95' AS term, ROUND(slope, 8) AS coefficient FROM s UNION ALL SELECT cell, block, 'constant', ROUND((y - slope * x) / w, 8) FROM s""", "fx_pip")  # fmt: skip
def _(d):
    d = d.select("cell", (F.col("src_order") % 50).alias("block"), "pip", "cs95", (1.0 + F.col("src_line")).alias("w"))
    return I.block_jackknife(d, ["cell"], "block", "pip", ["cs95"], "w").withColumn("coefficient", F.round("coefficient", 8))


_RUN = r"^(cell\d+)_(ems|uniform)_pip(0\.\d)_(f|o)$"
_PARTS = ["cell", "prior", "threshold", "label"]


@query("A24_label_runs", f"""SELECT {", ".join(f"NULLIF(REGEXP_EXTRACT(run, '{_RUN}', {k + 1}), '') AS {p}" for k, p in enumerate(_PARTS))}, COUNT(*) AS n, ROUND(SUM(enrichment), 2) AS total FROM fx_run GROUP BY 1, 2, 3, 4""", "fx_run")
def _(d):
    return I.label_runs(d, "run", _RUN, _PARTS).groupBy(*_PARTS).agg(F.count("*").alias("n"), F.round(F.sum("enrichment"), 2).alias("total"))


@query("W5_best_for_both", """WITH p AS (SELECT gene_id, src_line, cs95, COUNT(*) AS n FROM fx_pip GROUP BY ALL),
 m AS (SELECT *, MAX(n) OVER (PARTITION BY gene_id, src_line) AS a, MAX(n) OVER (PARTITION BY gene_id, cs95) AS b FROM p),
 q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY gene_id, src_line ORDER BY cs95) AS k FROM m WHERE n = a AND n = b), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY gene_id, cs95 ORDER BY src_line) AS i FROM q WHERE k = 1)
SELECT gene_id, src_line, cs95, n FROM r WHERE i = 1""", "fx_pip")  # fmt: skip
def _(d):
    return I.best_for_both(d.groupBy("gene_id", "src_line", "cs95").agg(F.count("*").alias("n")), ["gene_id"], ["src_line"], ["cs95"], "n")


def _released(d):
    v = d.where("cs95 > 0").select("gene_id", F.col("cs95").alias("cs_idx"), *ALLELES, "pip", F.col("pip").alias("alpha"), F.col("src_line").alias("lbf_variable"), F.lit(1.0).alias("prior_weight"))
    s = v.groupBy("gene_id", "cs_idx").agg(F.count("*").alias("cs_size"), F.min("pip").alias("min_abs_corr"), F.max("pip").alias("coverage"), F.max("lbf_variable").alias("lbf"))
    return I.release_sets(v, s)


@query("S10_release_sets", f"""WITH s AS (SELECT gene_id, cs95, COUNT(*) AS n, MIN(pip) AS lo, MAX(pip) AS hi, MAX(src_line) AS l FROM fx_pip WHERE cs95 > 0 GROUP BY 1, 2)
SELECT REPLACE(chr, 'chr', '') AS "CHROM", pos AS "POS", {VID} AS "ID", ref AS "REF", alt AS "ALT", p.gene_id AS "GENE_ID", p.cs95 AS "CS_INDEX", n AS "CS_SIZE", lo AS "CS_PURITY", hi AS "CS_COVERAGE", l AS "CS_LBF",
 pip AS "PIP", pip AS "ALPHA", src_line AS "VARIANT_LBF", CAST(1 AS DOUBLE) AS "PRIOR_WEIGHT" FROM fx_pip p JOIN s ON p.gene_id = s.gene_id AND p.cs95 = s.cs95""", "fx_pip")  # fmt: skip
def _(d):
    return _released(d)


@query("S10_release_counts", f"""SELECT REPLACE(chr, 'chr', '') AS "CHROM", COUNT(DISTINCT gene_id) AS genes, COUNT(DISTINCT CONCAT(gene_id, '/', CAST(cs95 AS STRING))) AS sets, COUNT(*) AS n_rows,
 COUNT(DISTINCT {VID}) AS variants FROM fx_pip WHERE cs95 > 0 GROUP BY chr""", "fx_pip")  # fmt: skip
def _(d):
    return I.release_counts(_released(d), ["CHROM"])
