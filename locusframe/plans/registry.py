"""Registered queries: each operator of the inventory over the whole of its fixture tables, with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.functions import keys as K
from locusframe.operators import aggregates as A
from locusframe.operators import joins as J
from locusframe.sources.fixtures import fixture, with_fixtures

QUERIES: dict = {}
ORACLE_SQL: dict = {}
ALLELES = ["chr", "pos", "ref", "alt"]
AL = "chr, pos, ref, alt"


def query(name: str, sql: str | None, *tables: str):
    """Register f(frames...) -> DataFrame under `name`; sql may use the fixtures' names."""

    def wrap(f):
        def run(spark, sf_dir):
            return f(*[fixture(spark, sf_dir, t) for t in tables])

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = with_fixtures(sql)
        return f

    return wrap


r6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)
vid = lambda: K.variant_id(*[F.col(c) for c in ALLELES])
VID = "CONCAT(chr, ':', CAST(pos AS STRING), ':', ref, ':', alt)"

# --- keys and scalar functions ---------------------------------------------------------------------------------------


@query("P1_parse_variant", f"SELECT {VID} AS variant_id, {AL}, COUNT(*) AS n FROM fx_pip GROUP BY ALL", "fx_pip")
def _(d):
    return K.parse_variant(d.select(vid().alias("variant_id"))).groupBy("variant_id", *ALLELES).agg(F.count("*").alias("n"))


@query("P5_translate_id", f"SELECT {VID} AS variant_id, gene_id, COUNT(*) AS n FROM fx_pip GROUP BY ALL", "fx_pip")
def _(d):
    old = F.concat(F.concat_ws("_", *[F.col(c).cast("string") for c in ALLELES]), F.lit("_b38"))
    return d.groupBy(K.translate_id(old).alias("variant_id"), K.strip_version(F.concat("gene_id", F.lit(".12"))).alias("gene_id")).agg(F.count("*").alias("n"))


TSS = "SELECT gene_id, AVG(gene_tss) AS tss FROM fx_gene GROUP BY gene_id"


@query("P10_recalibrate", """SELECT gene_id, chr, pos, src_order, src_line, ROUND(CASE WHEN pip >= 1 THEN 1 WHEN pip <= 0 THEN 0 ELSE (pip / (1 - pip) * (q / (1 - q))) / (1 + pip / (1 - pip) * (q / (1 - q))) END, 9) AS p
 FROM (SELECT *, CAST(1.8 AS DOUBLE) / 14716 AS q FROM fx_pip)""", "fx_pip")  # fmt: skip
def _(d):
    return d.select("gene_id", "chr", "pos", "src_order", "src_line", F.round(K.recalibrate(F.col("pip")), 9).alias("p"))


@query("J2_annotate_intervals", f"""SELECT DISTINCT {", ".join("v." + c for c in ALLELES)}, annotation FROM (SELECT DISTINCT {AL} FROM fx_pip) v
 JOIN fx_interval i ON v.chr = i.chr AND i.start_pos <= v.pos - 1 AND i.end_pos >= v.pos""", "fx_pip", "fx_interval")
def _(d, i):
    return J.annotate_intervals(d, i)


@query("J11_flag_baseline", f"""SELECT b.*, CAST(EXISTS (SELECT 1 FROM fx_pip q WHERE q.pip > 0.9 AND q.chr = b.chr AND q.pos = b.pos AND q.ref = b.ref AND q.alt = b.alt) AS INT) AS flag
 FROM (SELECT DISTINCT {AL} FROM fx_pip) b""", "fx_pip")
def _(d):
    return J.flag_keys(d.select(*ALLELES).distinct(), d.where("pip > 0.9"), "flag")


@query("J12_match_panel", """WITH panel AS (SELECT DISTINCT CONCAT(chr, ':', CAST(pos AS STRING), ':', LEAST(ref, alt), ':', GREATEST(ref, alt)) AS key, ref AS p_ref, alt AS p_alt FROM fx_pip),
 j AS (SELECT panel.key, CASE WHEN ref = p_ref AND alt = p_alt THEN 'keep' ELSE 'flip' END AS orient, CASE WHEN ref = p_ref AND alt = p_alt THEN z ELSE -z END AS z_panel, n, pos, p_ref
  FROM (SELECT chr, pos, ref, alt, n, CASE WHEN n % 4 <> 0 THEN z END AS z FROM fx_gwas) g JOIN panel ON panel.key = CONCAT(g.chr, ':', CAST(g.pos AS STRING), ':', LEAST(g.ref, g.alt), ':', GREATEST(g.ref, g.alt)) WHERE z IS NOT NULL)
SELECT key, orient, ROUND(z_panel, 6) AS z_panel, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY CASE WHEN orient = 'keep' THEN 0 ELSE 1 END, pos, z_panel, n, p_ref) AS r FROM j) WHERE r = 1""",
       "fx_gwas", "fx_pip")
def _(g, d):
    """A quarter of the associations has no z: such a row must not stand for its key."""
    g = g.withColumn("z", F.when(F.col("n") % 4 != 0, F.col("z")))
    return J.match_panel(g, d).select("key", "orient", r6("z_panel"), "n")


@query("J12_enough_matched", """WITH panel AS (SELECT DISTINCT CONCAT(chr, ':', CAST(pos AS STRING), ':', LEAST(ref, alt), ':', GREATEST(ref, alt)) AS key FROM fx_pip),
 j AS (SELECT DISTINCT chr, pos, panel.key FROM fx_gwas g JOIN panel ON panel.key = CONCAT(g.chr, ':', CAST(g.pos AS STRING), ':', LEAST(g.ref, g.alt), ':', GREATEST(g.ref, g.alt)) WHERE z IS NOT NULL),
 w AS (SELECT gene_id, j.chr, j.pos, j.key FROM fx_gene g JOIN j ON j.chr = g.chr AND j.pos BETWEEN g.gene_tss - 100000 AND g.gene_tss + 100000)
SELECT * FROM w WHERE gene_id IN (SELECT gene_id FROM w GROUP BY 1 HAVING COUNT(*) >= 10)""", "fx_gwas", "fx_pip", "fx_gene")
def _(g, d, genes):
    w = genes.select("gene_id", "chr", (F.col("gene_tss") - 100_000).alias("start_pos"), (F.col("gene_tss") + 100_000).alias("end_pos"))
    return J.enough_matched(J.match_panel(g, d), w).select("gene_id", "chr", "pos", "key")


@query("J13_missing_outputs", """SELECT DISTINCT gene_id FROM fx_pip WHERE gene_id NOT IN (
 SELECT gene_id FROM fx_pip WHERE pip > 0.985 GROUP BY gene_id HAVING COUNT(DISTINCT cell) >= 3)""", "fx_pip")
def _(d):
    return J.missing_outputs(d, d.where("pip > 0.985").select("gene_id", F.col("cell").alias("model")), 3)


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("A1_max_over_genes", f"SELECT {AL}, MAX(pip) AS pip FROM fx_pip GROUP BY ALL", "fx_pip")
def _(d):
    return A.max_over_genes(d, "pip")


@query("A2_best_pip_row", f"""SELECT gene_id, {AL}, pip, cs95, cell, src_order, src_line FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY gene_id, {AL} ORDER BY pip DESC, src_order, src_line) AS r
 FROM fx_pip) WHERE r = 1""", "fx_pip")
def _(d):
    return A.best_pip_row(d, [F.col("src_order"), F.col("src_line")]).select("gene_id", *ALLELES, "pip", "cs95", "cell", "src_order", "src_line")


@query("A5_median_fill", """WITH x AS (SELECT gene_id, src_order, src_line, CASE WHEN src_order % 5 <> 0 THEN pip END AS v FROM fx_pip)
SELECT x.gene_id, src_order, src_line, ROUND(COALESCE(v, m), 8) AS v FROM x JOIN (SELECT gene_id, MEDIAN(v) AS m FROM x GROUP BY 1) t ON x.gene_id = t.gene_id""", "fx_pip")
def _(d):
    x = d.select("gene_id", "src_order", "src_line", F.when(F.col("src_order") % 5 != 0, F.col("pip")).alias("v"))
    return A.median_fill(x, ["v"], ["gene_id"]).select("gene_id", "src_order", "src_line", F.round("v", 8).alias("v"))


@query("A6_sample_weights", """SELECT cell, src_order, src_line, ROUND(CASE WHEN pip > 0.9 THEN pip * n / s ELSE 1 END, 6) AS weight FROM (SELECT *, COUNT(*) FILTER (pip <= 0.9) OVER w AS n,
 SUM(CASE WHEN pip > 0.9 THEN pip END) OVER w AS s FROM fx_pip WINDOW w AS (PARTITION BY cell))""", "fx_pip")
def _(d):
    return A.sample_weights(d.withColumn("label", (F.col("pip") > 0.9).cast("int")), "label", "pip", ["cell"]).select("cell", "src_order", "src_line", r6("weight"))


FIT = "m AS (SELECT *, MAX(lbf) OVER (PARTITION BY gene_id, cell, effect) AS mx FROM fx_fit), al AS (SELECT gene_id, cell, effect, variant_key, lbf, EXP(lbf - mx) / SUM(EXP(lbf - mx)) OVER (PARTITION BY gene_id, cell, effect) AS alpha FROM m)"
CS = FIT + """, cum AS (SELECT *, COALESCE(SUM(alpha) OVER (PARTITION BY gene_id, cell, effect ORDER BY alpha DESC, variant_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM al),
 cs AS (SELECT * FROM cum WHERE b < 0.90)"""
SETS = CS + """, st AS (SELECT gene_id, cell, effect, COUNT(*) AS size, MAX(alpha) AS top_pip, SUM(alpha) AS sum_pip, ARG_MAX(variant_key, alpha * 1e6 - variant_key * 1e-9) AS approx_top FROM cs GROUP BY ALL)"""
EFF = ["gene_id", "cell", "effect"]


def _alpha(f):
    return A.softmax(f, EFF, "lbf")


def _sets(f):
    return A.set_table(A.credible_set(_alpha(f), EFF, 0.90))


@query("A12_pip_from_alpha", f"WITH {FIT} SELECT gene_id, cell, variant_key, ROUND(1 - EXP(SUM(LN(1 - alpha))), 6) AS pip FROM (SELECT *, LEAST(alpha, 1 - 1e-15) AS a2 FROM al) GROUP BY ALL", "fx_fit")
def _(f):
    return A.pip_from_alpha(_alpha(f)).select("gene_id", "cell", "variant_key", r6("pip"))


@query("W1_cs_rank", f"WITH {SETS} SELECT gene_id, cell, effect, ROW_NUMBER() OVER (PARTITION BY cell, gene_id ORDER BY ROUND(top_pip, 9) DESC, effect) AS cs_rank FROM st", "fx_fit")
def _(f):
    return A.cs_rank(_sets(f).withColumn("top_pip", F.round("top_pip", 9))).select(*EFF, "cs_rank")


# --- top-k, sampling, sets, assemblies -------------------------------------------------------------------------------


@query("M9_pip_annotation", f"SELECT {AL}, CAST(MAX(pip) > 0.10 AS INT) AS flag FROM fx_pip GROUP BY ALL", "fx_pip")
def _(d):
    return J.flag_keys(d.select(*ALLELES).distinct(), A.max_over_genes(d, "pip").where("pip > 0.10"), "flag")
