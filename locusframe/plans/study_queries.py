"""Registered queries of operators/study.py, with independent SQL; importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.operators import aggregates as A
from locusframe.operators import study as S
from locusframe.plans.registry import AL, ALLELES, EFF, SETS, _sets, query, r6

V = ", ".join("v." + c for c in ALLELES)
ASSAYS = ["click", "purchase", "view", "absent"]


@query("J6_pair_peaks", f"""SELECT {V}, annotation, c AS centre, v.pos - c AS distance FROM (SELECT DISTINCT {AL} FROM fx_pip) v
 JOIN (SELECT annotation, chr, start_pos + (end_pos - start_pos) // 2 AS c FROM fx_interval) i ON v.chr = i.chr AND ABS(v.pos - c) <= 1024""", "fx_pip", "fx_interval")
def _(d, i):
    return S.pair_peaks(d, i).select(*ALLELES, "annotation", "centre", "distance")


@query("J10_allele_frequency", f"""WITH s AS (SELECT chr, pos, CASE WHEN n % 2 = 0 THEN 'A' ELSE 'C' END AS r, CASE WHEN n % 2 = 0 THEN 'C' ELSE 'A' END AS a, n,
  CASE WHEN n % 5 <> 0 THEN n / CAST(1000000 AS DOUBLE) ELSE 0 END AS af FROM fx_gwas),
 j AS (SELECT {V}, af, ROW_NUMBER() OVER (PARTITION BY {V} ORDER BY CASE WHEN s.r = v.ref AND s.a = v.alt THEN 0 ELSE 1 END, n) AS k FROM (SELECT DISTINCT {AL} FROM fx_pip) v
  JOIN s ON s.chr = v.chr AND s.pos = v.pos AND (s.r = v.ref AND s.a = v.alt OR s.r = v.alt AND s.a = v.ref))
SELECT {AL}, af FROM j WHERE k = 1""", "fx_pip", "fx_gwas")
def _(d, g):
    even = F.col("n") % 2 == 0
    sites = g.select("chr", "pos", F.when(even, "A").otherwise("C").alias("ref"), F.when(even, "C").otherwise("A").alias("alt"),
                     F.when(F.col("n") % 5 != 0, F.col("n") / F.lit(1000000.0)).alias("af"), F.col("n").alias("record_no"))
    return S.allele_frequency(d, sites)


CROSS = """t AS (SELECT gene_id, cell, cs95 AS idx, CONCAT('o', CAST(src_line % 4 AS STRING)) AS other_cell, pip AS h4,
  CASE WHEN src_order % 10 = 0 THEN 'focal credible set' WHEN src_order % 10 = 1 THEN 'no credible set' END AS note FROM fx_pip),
 fc AS (SELECT DISTINCT gene_id, cell, idx FROM t WHERE note = 'focal credible set'),
 te AS (SELECT gene_id, cell, idx, COUNT(DISTINCT other_cell) AS n, MAX(h4) AS mx, STRING_AGG(DISTINCT CASE WHEN h4 > 0.8 THEN other_cell END, ',' ORDER BY CASE WHEN h4 > 0.8 THEN other_cell END) AS sw
  FROM t WHERE note IS NULL GROUP BY ALL),
 cs AS (SELECT fc.*, COALESCE(n, 0) AS n_other_tested, mx, COALESCE(sw, '') AS shared_with, COALESCE(CAST(mx > 0.8 AS INT), 0) AS shared FROM fc LEFT JOIN te USING (gene_id, cell, idx))"""


def _crossed(d):
    o = F.col("src_order") % 10
    return d.select("gene_id", "cell", F.col("cs95").alias("idx"), F.concat(F.lit("o"), (F.col("src_line") % 4).cast("string")).alias("other_cell"), F.col("pip").alias("h4"),
                    F.when(o == 0, "focal credible set").when(o == 1, "no credible set").alias("note"))


@query("A19_crosscell_sets", f"WITH {CROSS} SELECT gene_id, cell, idx, n_other_tested, ROUND(mx, 6) AS max_h4, shared_with, shared FROM cs", "fx_pip")
def _(d):
    return S.crosscell_sets(_crossed(d)).select("gene_id", "cell", "idx", "n_other_tested", r6("max_h4"), "shared_with", "shared")


@query("A23_select_tau", """WITH s AS (SELECT gene_id, src_line AS cut, MAX(pip) AS tau FROM fx_pip GROUP BY ALL), k AS (SELECT *, COUNT(*) OVER (PARTITION BY gene_id) AS n,
 ROW_NUMBER() OVER (PARTITION BY gene_id ORDER BY tau DESC, cut) AS r FROM s) SELECT gene_id, cut AS selected, tau FROM k WHERE n = 7 AND r = 1""", "fx_pip")
def _(d):
    sweep = d.groupBy("gene_id", F.col("src_line").alias("cut")).agg(F.max("pip").alias("tau"))
    return S.select_tau(sweep, "gene_id", "cut", "tau", 7)


@query("A25_size_match", """SELECT cell, MIN(n) AS least, MAX(n) AS most, COUNT(DISTINCT n) AS n_sizes FROM (SELECT cell, gene_id, COUNT(*) AS n FROM fx_pip GROUP BY ALL) GROUP BY cell""", "fx_pip")
def _(d):
    return S.size_match(d.groupBy("cell", "gene_id").agg(F.count("*").alias("n")), "cell", "n")


@query("A26_bin_sum_difference", """SELECT gene_id, cell, ROUND(SUM(CASE WHEN src_line % 2 = 0 THEN pip ELSE -pip END), 6) AS difference FROM fx_pip WHERE src_order % 896 BETWEEN 432 AND 463 GROUP BY ALL""", "fx_pip")
def _(d):
    x = d.select("gene_id", "cell", F.when(F.col("src_line") % 2 == 0, "ref").otherwise("alt").alias("allele"), (F.col("src_order") % 896).alias("bin"), F.col("pip").alias("value"))
    return S.bin_sum_difference(x, ["gene_id", "cell"]).select("gene_id", "cell", r6("difference"))


@query("A27_profile_divergence", """WITH w AS (SELECT gene_id, cs95 AS fold, (pip + 0.001) / SUM(pip + 0.001) OVER g AS p, (1.001 - pip) / SUM(1.001 - pip) OVER g AS q, COUNT(*) FILTER (pip <= 0.2) OVER g AS rc,
  COUNT(*) FILTER (pip > 0.2) OVER g AS ac FROM fx_pip WINDOW g AS (PARTITION BY gene_id, cs95)),
 f AS (SELECT gene_id, fold, MAX(ac) - MAX(rc) AS c, SUM(ABS(LN(q) - LN(p))) AS l, SQRT(GREATEST(SUM((p * LN(2 * p / (p + q)) + q * LN(2 * q / (p + q))) / 2), 0)) AS js FROM w GROUP BY ALL)
SELECT gene_id, ROUND(AVG(c), 6) AS counts, ROUND(AVG(l * SIGN(c)), 4) AS probs, ROUND(AVG(js * SIGN(c)), 6) AS jsd FROM f GROUP BY gene_id""", "fx_pip")
def _(d):
    g = Window.partitionBy("gene_id", "fold")
    x = d.select("gene_id", F.col("cs95").alias("fold"), "pip")
    share = lambda c: c / F.sum(c).over(g)
    x = x.select("gene_id", "fold", share(F.col("pip") + 0.001).alias("ref_p"), share(1.001 - F.col("pip")).alias("alt_p"), F.count_if(F.col("pip") <= 0.2).over(g).alias("ref_count"), F.count_if(F.col("pip") > 0.2).over(g).alias("alt_count"))
    return S.profile_divergence(x, ["gene_id"]).select("gene_id", r6("counts"), F.round("probs", 4).alias("probs"), r6("jsd"))


@query("W4_share_of_total", "SELECT gene_id, cell, n, ROUND(n / CAST(SUM(n) OVER (PARTITION BY cell) AS DOUBLE), 8) AS share FROM (SELECT gene_id, cell, COUNT(*) AS n FROM fx_pip GROUP BY ALL)", "fx_pip")
def _(d):
    return S.share_of_total(d.groupBy("gene_id", "cell").agg(F.count("*").alias("n")), ["cell"], "n").select("gene_id", "cell", "n", F.round("share", 8).alias("share"))


CELLS = ["cell0", "cell1", "cell2"]


@query("U5_gwas_gene_list", "SELECT gene_id, MIN(chr) AS chr FROM fx_pip WHERE pip > 0.97 AND gene_id IN (SELECT gene_id FROM fx_gene WHERE post_mean > 0) GROUP BY gene_id", "fx_pip", "fx_gene")
def _(d, g):
    d = d.where("pip > 0.97")
    return S.gwas_gene_list([d.where(F.col("cell") == c) for c in CELLS], g.where("post_mean > 0"))
