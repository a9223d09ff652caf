"""Colocalization between the cells of a study (A29): every pair of fits is either tested or has exactly one reason why not.

Rows have one shape for tests and notes: gene_id, prior, cell, idx, other_cell, other_idx, note, nsnps, hit1, hit2, pp_h0 .. pp_h4. `note` is
null for a test. The table is what the sharing summaries (A19) read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.aggregates import coloc_pp
from locusframe.sources.shared import written

#: The notes that the sharing summaries and their readers know.
NO_FIT, UNREADABLE, NO_SET, FOCAL = "no fit", "unreadable fit", "no credible set", "focal credible set"
ELSEWHERE, FEW, NOTHING_SHARED, NO_RESULT = "{} in other cell", "fewer than {} shared variants", "credible set has no shared variants", "coloc returned no result"

FIT = ["gene_id", "prior", "cell"]
PAIR = [*FIT, "other_cell"]
PP = [f"pp_h{k}" for k in range(5)]
COLUMNS = [*FIT, "idx", "other_cell", "other_idx", "note", "nsnps", "hit1", "hit2", *PP]


def fit_status(genes: DataFrame, fits: DataFrame, members: DataFrame, priors: list[str], cells: list[str]) -> DataFrame:
    """One row per gene of `genes`, prior and cell: status `ok`, `no fit`, `unreadable fit` (a log Bayes factor is null or not a number) or `no credible set`."""
    every = genes.select("gene_id").distinct().withColumn("prior", F.explode(F.array(*map(F.lit, priors)))).withColumn("cell", F.explode(F.array(*map(F.lit, cells))))
    broken = F.col("lbf").isNull() | F.isnan("lbf")
    seen = fits.groupBy(*FIT).agg(F.max(broken).alias("_broken"))
    sets = members.groupBy(*FIT).agg(F.lit(True).alias("_set"))
    d = every.join(seen, FIT, "left").join(sets, FIT, "left")
    status = F.when(F.col("_broken").isNull(), NO_FIT).when(F.col("_broken"), UNREADABLE).when(F.col("_set").isNull(), NO_SET).otherwise("ok")
    return d.select(*FIT, status.alias("status"))


def _bits(cells: list[str]) -> list[tuple[str, list[str]]]:
    """The cells in runs of at most 60: each run's column of one bit a cell."""
    return [(f"_in{k}", cells[k : k + 60]) for k in range(0, len(cells), 60)]


def shared_variants(fits: DataFrame, cells: list[str]) -> DataFrame:
    """One row per gene, prior and variant that at least two cells' fits have, with the cells as bits: one hash aggregate, no row or list a pair of rows."""
    bit = lambda of: F.coalesce(*[F.when(F.col("cell") == c, F.lit(1 << k).cast("bigint")) for k, c in enumerate(of)], F.lit(0).cast("bigint"))
    at = fits.groupBy("gene_id", "prior", "variant_key").agg(*[F.bit_or(bit(of)).alias(n) for n, of in _bits(cells)])
    return at.where(sum((F.bit_count(n) for n, _ in _bits(cells)), F.lit(0)) > 1)


def _cells_of(cells: list[str]):
    """The cells whose bits are set, as an array."""
    return F.array_compact(F.array(*[F.when(F.col(n).bitwiseAND(F.lit(1 << k).cast("bigint")) != 0, c) for n, of in _bits(cells) for k, c in enumerate(of)]))


def shared_counts(shared: DataFrame, cells: list[str]) -> DataFrame:
    """Variants that two cells' fits of a gene and prior share, for both directions: variants of the same cells are counted before they meet the pairs. shared: of shared_variants."""
    n = shared.groupBy("gene_id", "prior", *[n for n, _ in _bits(cells)]).agg(F.count("*").alias("_n")).withColumn("_cells", _cells_of(cells))
    one = n.select("gene_id", "prior", "_n", "_cells", F.explode("_cells").alias("cell"))
    two = one.select(*FIT, "_n", F.explode(F.array_remove("_cells", F.col("cell"))).alias("other_cell"))
    return two.groupBy(*PAIR).agg(F.sum("_n").alias("n_shared"))


def sets_left(shared: DataFrame, members: DataFrame, cells: list[str]) -> DataFrame:
    """(pair, idx): the sets of a cell that have a member among the variants the other cell's fit has too. shared: of shared_variants."""
    j = members.select(*FIT, "idx", "variant_key").join(shared, ["gene_id", "prior", "variant_key"])
    return j.select(*FIT, "idx", F.explode(F.array_remove(_cells_of(cells), F.col("cell"))).alias("other_cell")).select(*PAIR, "idx").distinct()


def pair_status(status: DataFrame, shared: DataFrame, left: DataFrame, cells: list[str], least: int = 10) -> DataFrame:
    """One row per usable focal fit and other cell: the note of the pair, or null where it can be tested. shared: of shared_variants, from fits of status ok; left: of sets_left."""
    pairs = status.where("status = 'ok'").select(*FIT, F.explode(F.array_remove(F.array(*map(F.lit, cells)), F.col("cell"))).alias("other_cell"))
    other = status.select("gene_id", "prior", F.col("cell").alias("other_cell"), F.col("status").alias("_other"))
    # A pair's own sets and, turned round, the other side's: one small table of two flags.
    one = left.select(*PAIR).distinct()
    flags = one.withColumn("_side", F.lit(1)).union(one.select("gene_id", "prior", F.col("other_cell").alias("cell"), F.col("cell").alias("other_cell"), F.lit(2))).groupBy(*PAIR).agg(F.countDistinct("_side").alias("_sides"))
    d = pairs.join(other, ["gene_id", "prior", "other_cell"], "left").join(shared_counts(shared, cells), PAIR, "left").join(flags, PAIR, "left")
    note = F.when(F.col("_other") != "ok", F.format_string(ELSEWHERE.format("%s"), F.col("_other")))
    note = note.when(F.coalesce("n_shared", F.lit(0)) < least, FEW.format(least)).when(F.coalesce("_sides", F.lit(0)) < 2, NOTHING_SHARED)
    return d.select(*PAIR, note.alias("note"))


def crosscell_rows(genes: DataFrame, fits: DataFrame, members: DataFrame, priors: list[str], cells: list[str], least: int = 10) -> DataFrame:
    """The whole table of tests and notes.

    genes: gene_id, every gene that was to be fitted; fits: gene_id, prior, cell, effect, variant_key, lbf; members: gene_id, prior,
    cell, idx, variant_key (rows of credible sets; idx is the effect). Both are read in several steps: pass them written (shared.written).
    Each pair of cells is computed once and mirrored. What several steps read (statuses, shared variants, pairs, tests) is written once.
    """
    status = written(fit_status(genes, fits, members, priors, cells), "crosscell-status")
    ok = status.where("status = 'ok'").select(*FIT)
    kept = members.join(ok, FIT, "left_semi")
    shared = written(shared_variants(fits.join(ok, FIT, "left_semi"), cells), "crosscell-shared")
    left = written(sets_left(shared, kept, cells), "crosscell-sets")
    pairs = written(pair_status(status, shared, left, cells, least), "crosscell-pairs")
    open_ = pairs.where("note is null").select(*PAIR)
    # Only effects whose set is still there meet; their Bayes factors at all shared variants count.
    side = fits.join(left.join(open_, PAIR, "left_semi").withColumnRenamed("idx", "effect"), [*FIT, "effect"]).select(*PAIR, "effect", "variant_key", "lbf")
    turned = side.where("cell > other_cell").select("gene_id", "prior", F.col("other_cell").alias("cell"), F.col("cell").alias("other_cell"), "effect", "variant_key", "lbf")
    pp = coloc_pp(side.where("cell < other_cell"), turned, least=1, scope=PAIR)  # the pair has enough; its effects may lie on fewer
    pp = written(pp.where(F.forall(F.array(*PP), lambda x: x.isNotNull() & ~F.isnan(x))), "crosscell-tests")
    here = {"cell": "cell", "other_cell": "other_cell", "idx": "effect1", "other_idx": "effect2", "hit1": "hit1", "hit2": "hit2", "pp_h1": "pp_h1", "pp_h2": "pp_h2"}
    there = {"cell": "other_cell", "other_cell": "cell", "idx": "effect2", "other_idx": "effect1", "hit1": "hit2", "hit2": "hit1", "pp_h1": "pp_h2", "pp_h2": "pp_h1"}
    both = F.explode(F.array(*[F.struct(*[F.col(c).alias(n) for n, c in way.items()]) for way in (here, there)]))
    tests = pp.select("gene_id", "prior", "nsnps", "pp_h0", "pp_h3", "pp_h4", both.alias("_t")).select("*", "_t.*").drop("_t")
    notes = [status.where("status <> 'ok'").select(*FIT, F.col("status").alias("note")), kept.select(*FIT, "idx").distinct().withColumn("note", F.lit(FOCAL)), pairs.where("note is not null"),
             open_.join(tests.select(*PAIR), PAIR, "left_anti").withColumn("note", F.lit(NO_RESULT))]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [tests, *notes])
    return rows.select(*COLUMNS)


def set_counts_check(summary: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """Where a summary's number of sets (n_cs) is not that of the set table: empty for a sound run. by: for instance prior and cell."""
    n = sets.groupBy(*by).agg(F.count("*").alias("n_cs_ref"))
    d = summary.select(*by, "n_cs").join(n, by, "full")
    return d.where("n_cs is distinct from n_cs_ref")
