"""Adapters that project the driver's tables onto the shapes of a variant study; the same SQL serves Spark and the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FX = {
    "fx_pip": """SELECT CONCAT('G', CAST(l_suppkey AS STRING)) AS gene_id, CONCAT('chr', CAST(l_suppkey % 22 + 1 AS STRING)) AS chr,
 l_partkey * 500 + 1000 AS pos, CASE WHEN l_partkey % 10 = 0 THEN 'AT' ELSE 'A' END AS ref, CASE WHEN l_partkey % 10 = 1 THEN 'CGT' ELSE 'C' END AS alt,
 u * u * u * u AS pip, CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE l_linenumber % 3 END AS cs95, l_orderkey AS src_order, l_linenumber AS src_line,
 CONCAT('cell', CAST(l_orderkey % 3 AS STRING)) AS cell
FROM (SELECT *, CAST((l_orderkey * 7919 + l_linenumber * 104729) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS u FROM lineitem) t""",
    "fx_interval": """SELECT p_type AS annotation, CONCAT('chr', CAST(p_partkey % 22 + 1 AS STRING)) AS chr,
 p_partkey * 500 + CASE WHEN p_partkey % 10 = 3 THEN 1000 ELSE 900 END AS start_pos, p_partkey * 500 + 1000 + p_size * 20 AS end_pos FROM part""",
    "fx_gene_link": """SELECT CONCAT('G', CAST(CAST((o_custkey - o_custkey % 15) / 15 AS BIGINT) AS STRING)) AS gene_id, CONCAT('chr', CAST(CAST((o_custkey - o_custkey % 15) / 15 AS BIGINT) % 22 + 1 AS STRING)) AS chr,
 o_orderpriority AS cell, (o_orderkey % 2000) * 500 AS start_pos, (o_orderkey % 2000) * 500 + 700 AS end_pos, o_totalprice / CAST(500000 AS DOUBLE) AS abc_score FROM orders""",
    "fx_gene": """SELECT CONCAT('G', CAST(s_suppkey AS STRING)) AS gene_id, s_name AS gene_name, CONCAT('chr', CAST(s_suppkey % 22 + 1 AS STRING)) AS chr,
 CAST(s_suppkey * 9973 % 1000000 AS BIGINT) AS gene_tss, s_acctbal AS post_mean FROM supplier""",
    "fx_gwas": """SELECT CONCAT('chr', CAST(o_orderkey % 22 + 1 AS STRING)) AS chr, (o_orderkey % 2000) * 500 + 1000 AS pos, 'C' AS ref, 'A' AS alt,
 (o_totalprice - CAST(250000 AS DOUBLE)) / CAST(50000 AS DOUBLE) AS z, o_custkey + 1000 AS n FROM orders""",
    "fx_fit": """SELECT CONCAT('G', CAST(l_suppkey AS STRING)) AS gene_id, CONCAT('cell', CAST(l_orderkey % 3 AS STRING)) AS cell,
 l_linenumber % 3 + 1 AS effect, l_partkey AS variant_key, MAX((l_quantity - CAST(25 AS DOUBLE)) / CAST(5 AS DOUBLE)) AS lbf FROM lineitem GROUP BY 1, 2, 3, 4""",
    "fx_scored": """SELECT CONCAT('chr', CAST(l_suppkey % 22 + 1 AS STRING)) AS chrom, l_orderkey, l_linenumber,
 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true, l_discount AS pred_a, l_tax AS pred_b FROM lineitem""",
    "fx_peak_score": "SELECT CONCAT('v', CAST(user_id AS STRING)) AS variant_id, event_type AS assay, value - CAST(50 AS DOUBLE) AS score FROM events",
    "fx_geno": """SELECT sample_id, p_partkey AS variant_key, CASE WHEN (p_partkey * 29 + sample_id * 31) % 23 <> 0 THEN
 CAST(((p_partkey - p_partkey % 5) * 31 + sample_id * 7919 + CASE WHEN (p_partkey * 17 + sample_id * 13) % 7 = 0 THEN 1 ELSE 0 END) % 101 % 3 AS INT) END AS dosage
FROM part CROSS JOIN (SELECT DISTINCT CAST(o_orderkey % 64 AS INT) AS sample_id FROM orders) s""",
    "fx_tile": """SELECT DISTINCT chr, tile, TRANSLATE(MD5(CONCAT(chr, '-', CAST(tile AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM (
 SELECT CONCAT('chr', CAST(l_suppkey % 22 + 1 AS STRING)) AS chr, CAST(FLOOR((l_partkey * 500 + 999) / 32) AS BIGINT) + l_linenumber % 3 - 1 AS tile FROM lineitem) t""",
    "fx_dictionary": """SELECT CONCAT(p_type, '_', CAST(p_partkey % 97 AS STRING)) AS feature, CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'distance' WHEN 1 THEN 'ABC' WHEN 2 THEN 'celltype' WHEN 3 THEN 'baseline'
 WHEN 4 THEN 'chrombpnet_positive' WHEN 5 THEN 'diff' ELSE 'tf_positive' END AS grp, MIN(p_partkey) AS position FROM part GROUP BY 1, 2""",
    "fx_run": """SELECT CONCAT('cell', CAST(o_custkey % 3 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '_ems' ELSE '_uniform' END, '_pip0.', CAST(o_orderkey % 9 AS STRING), '_', LOWER(o_orderstatus)) AS run,
 o_orderkey AS row_id, o_totalprice AS enrichment FROM orders""",
    "fx_expr": """SELECT CONCAT('G', CAST(CAST((o_custkey - o_custkey % 15) / 15 AS BIGINT) AS STRING)) AS gene_id, CAST(o_orderkey % 64 AS INT) AS sample_id, AVG(o_totalprice) AS y
FROM orders GROUP BY 1, 2""",
    "fx_expr_cell": """SELECT CONCAT('cell', CAST(o_custkey % 3 AS STRING)) AS cell, CONCAT('G', CAST(CAST((o_custkey - o_custkey % 15) / 15 AS BIGINT) AS STRING)) AS gene_id, CAST(o_orderkey % 64 AS INT) AS sample_id, AVG(o_totalprice) AS y
FROM orders WHERE (o_orderkey % 64) % 7 <> o_custkey % 3 GROUP BY 1, 2, 3""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FX[name]
    tables = sorted(set(re.findall(r"FROM (\w+)", sql)))
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if name == "fx_geno":  # the few samples go to the variants, not all variants through the driver to the samples; the rows of a variant lie in one task
        tasks = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a fixed number: small rows become 64 each
        frames |= {"part": frames["part"].repartition(tasks, "p_partkey"), "orders": frames["orders"].hint("broadcast")}
    return spark.sql(re.sub(r"FROM (\w+)", r"FROM {\1}", sql), **frames)


def with_fixtures(body: str) -> str:
    """Oracle SQL: the adapters that the body names, as common table expressions in front of it."""
    used = [n for n in FX if re.search(rf"\b{n}\b", body)]
    body = body.strip()
    ctes = ",\n".join(f"{n} AS ({FX[n]})" for n in used)
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"
