"""Every registered query of the variant library against its SQL in DuckDB, and edge rows that the fixtures lack."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from locusframe.functions import keys as K
from locusframe.operators import aggregates as A
from locusframe.operators import joins as J
from locusframe.plans import block_queries, feature_queries, registry, source_queries, study_queries, table_queries  # noqa: F401 (the import registers its queries)

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def norm(v):
    return (None if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, D)
    cols = sorted(got.columns)
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    key = lambda r: [(x is None, str(x)) for x in r]
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=key)
    assert mine == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=key)


def test_interval_bounds(spark):
    i = spark.createDataFrame([("a", "chr1", 99, 100), ("b", "chr1", 100, 300)], "annotation string, chr string, start_pos long, end_pos long")
    v = spark.createDataFrame([("chr1", p, "A", "C") for p in (98, 99, 100, 101, 300, 301)], "chr string, pos long, ref string, alt string")
    got = {(r.pos, r.annotation) for r in J.annotate_intervals(v, i, width=10).collect()}
    assert got == {(100, "a"), (101, "b"), (300, "b")}


def test_neglog10p_does_not_underflow(spark):
    z = spark.createDataFrame([(0.0,), (1.96,), (-40.0,)], "z double").select(K.neglog10p(F.col("z")).alias("p")).collect()
    assert abs(z[0].p) < 1e-6 and abs(z[1].p - 1.30103) < 1e-3 and 348 < z[2].p < 351


def test_average_precision_of_one_class_and_ties(spark):
    d = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.5), ("b", 1, 0.5), ("b", 0, 0.5), ("c", 0, None)], "k string, y int, s double")
    got = {r.k: r.ap for r in A.average_precision(d, ["k"], "y", "s").collect()}
    assert got == {"a": None, "b": 0.5}


def test_genes_given_and_found(spark):
    v = spark.createDataFrame([("chr1", 100, "A", "C", "g1"), ("chr1", 100, "A", "C", None), ("chr1", 200, "A", "C", ""), ("chr1", 300, "A", "C", "g3"), ("chr1", 400, "A", "C", "nobody")], "chr string, pos long, ref string, alt string, gene_id string")
    g = spark.createDataFrame([("g1", "chr1", 9000), ("g2", "chr1", 250), ("g3", "chr2", 300)], "gene_id string, chr string, gene_tss long")
    assert {(r.pos, r.gene_id) for r in J.pair_genes(v, g, 50).collect()} == {(100, "g1"), (200, "g2")}
    assert {(r.pos, r.gene_id) for r in J.pair_genes(v.drop("gene_id"), g, 50).collect()} == {(200, "g2"), (300, "g2")}


def test_short_strata_are_drawn_with_replacement(spark):
    order = [F.col("k")]
    pos = spark.createDataFrame([(f"g{g}",) for g in range(30) for _ in range(20)], "gene_id string")
    neg = spark.createDataFrame([(f"g{g}", k, "x") for g in range(30) for k in range(100)], "gene_id string, k long, _note string")
    got = A.sample_negatives(pos, neg, ["gene_id"], order, per=10)
    assert got.columns == neg.columns and got.count() == got.distinct().count()
    # 200 draws of 100 rows leave about 100 (1 - 1/e^2) = 86.5 of them, not all; strata draw differently.
    n = [r["count"] for r in got.groupBy("gene_id").count().collect()]
    assert len(n) == 30 and 84 < sum(n) / 30 < 89 and max(n) < 100 and len(set(n)) > 3
    assert A.sample_negatives(pos, neg, ["gene_id"], order, per=3).groupBy("gene_id").count().where("count = 60").count() == 30
    for per, want in ((10, {(s * s) % 2147483647 % 7 for s in (i * 48271 % 2147483647 for i in range(1, 21))}), (3, set(range(6)))):
        one = A.sample_negatives(pos.where("gene_id = 'g0'").limit(2), neg.where("gene_id = 'g0' and k < 7"), ["gene_id"], order, per, table_queries.slot)
        assert {r.k for r in one.collect()} == want
