"""Registered round trips of the readers and writers: a fixture is written to the shared folder, read back, and compared with SQL on the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.functions import keys as K
from locusframe.plans.registry import ALLELES, VID, query
from locusframe.plans.study_queries import CELLS
from locusframe.sources import files
from locusframe.sources.shared import shared_folder, write_named

vid = lambda: K.variant_id(*[F.col(c) for c in ALLELES])


@query("S1_read_pip_csv", "SELECT cell, chr, pos, ref, alt, CAST(src_line AS DOUBLE) AS betahat, pip, gene_id FROM fx_pip", "fx_pip")
def _(d):
    at = shared_folder(d.sparkSession, "pips")
    for c in CELLS:  # one folder a cell, as the files come
        d.where(F.col("cell") == c).select(*ALLELES, F.col("src_line").cast("double").alias("betahat"), F.lit(0.5).alias("sebetahat"), F.lit(0.1).alias("maf"), "pip", "gene_id").write.csv(f"{at}/{c}/PIP_all", sep=" ", header=True)
    return files.read_pip_csv(d.sparkSession, [f"{at}/{c}/PIP_all" for c in CELLS]).select("cell", *ALLELES, "betahat", "pip", "gene_id")


@query("S2_write_by_chr", "SELECT chr, gene_id, src_order, src_line, pip FROM fx_pip", "fx_pip")
def _(d):
    at = shared_folder(d.sparkSession, "by-chr")
    files.write_by_chr(d.select("chr", "gene_id", "src_order", "src_line", "pip"), at, part_bytes=1 << 20)
    return files.read_chr(d.sparkSession, at)


@query("S3_read_chr", "SELECT gene_id, src_order, src_line FROM fx_pip WHERE chr IN ('chr2', 'chr5', 'chr77') AND pip > 0.5", "fx_pip")
def _(d):
    at = shared_folder(d.sparkSession, "by-chr")
    files.write_by_chr(d, at)
    return files.read_chr(d.sparkSession, at, ["chr2", "chr5", "chr77"], ["gene_id", "src_order", "src_line"], F.col("pip") > 0.5)


@query("S4_read_bed", "SELECT chr, start_pos, end_pos, annotation FROM fx_interval WHERE annotation <> 'PROMO'", "fx_interval")
def _(d):
    at = shared_folder(d.sparkSession, "beds")
    line = F.concat_ws("\t", "chr", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), F.lit("x"))
    head = d.sparkSession.range(1).select(F.lit("# a comment").alias("value"))
    for a in ("ECONOMY", "STANDARD", "MEDIUM", "LARGE", "SMALL"):
        write_named(head.union(d.where(F.col("annotation") == a).select(line.alias("value"))), at, f"{a}.bed")
    write_named(d.where("annotation = 'PROMO'").select(line.alias("value")), at, "PROMO.unmapped.bed")
    return files.read_bed(d.sparkSession, at)


_RELEASE = f"SELECT {VID} AS variant_id, pos, ref, alt, pip, gene_id, pip / 3 AS pred_prob, chr FROM fx_pip"


@query("S5_import_predictions", _RELEASE, "fx_pip")
def _(d):
    at = shared_folder(d.sparkSession, "release")
    out = d.select(F.regexp_replace("chr", "chr", "").alias("#CHROM"), F.col("pos").alias("POS"), vid().alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), F.col("gene_id").alias("GENE_ID"), F.col("pip").alias("PIP"), (F.col("pip") / 3).alias("PRED_PROBABILITY"))
    out.write.option("comment", "\u0001").csv(at, sep="\t", header=True, compression="gzip")
    return files.import_predictions(d.sparkSession, f"{at}/*.csv.gz")


@query("S6_export_predictions", _RELEASE, "fx_pip")
def _(d):
    at = shared_folder(d.sparkSession, "release")
    files.export_predictions(d.select(vid().alias("variant_id"), "pos", "ref", "alt", "pip", "gene_id", (F.col("pip") / 3).alias("pred_prob"), "chr"), at)
    return files.import_predictions(d.sparkSession, f"{at}/*/*.csv.gz")


@query("S9_prep_snpvar", """SELECT CAST(SUBSTR(chr, 4) AS INT) AS "CHR", pos AS "BP", alt AS "A1", ref AS "A2", z * z AS "SNPVAR" FROM fx_gwas""", "fx_gwas")
def _(g):
    return files.prep_snpvar(g.select(F.substring("chr", 4, 2).cast("int").alias("CHR"), F.col("pos").alias("BP"), F.col("alt").alias("A1"), F.col("ref").alias("A2"), (F.col("z") * F.col("z")).alias("SNPVAR")))


@query("S11_protein_coding_genes", "SELECT DISTINCT gene_id FROM fx_gene WHERE post_mean > 0", "fx_gene")
def _(g):
    at = shared_folder(g.sparkSession, "gtf")
    kind = F.when(F.col("post_mean") > 0, "protein_coding").otherwise("lncRNA")
    line = lambda feature: F.format_string(f"%s\tX\t{feature}\t%d\t%d\t.\t+\t.\tgene_id \"%s.7\"; gene_type \"%s\";", "chr", "gene_tss", F.col("gene_tss") + 10, "gene_id", kind)
    g.select(F.lit("#comment").alias("value")).limit(1).union(g.select(line("gene"))).union(g.select(line("exon"))).write.text(at)
    return files.protein_coding_genes(g.sparkSession, at)


@query("S12_read_lane", "SELECT gene_id, src_order, src_line FROM fx_pip WHERE pip >= 0.9 AND chr IN ('chr2', 'chr3')", "fx_pip")
def _(d):
    at = shared_folder(d.sparkSession, "lanes")
    d.withColumn("lane", F.when(F.col("pip") >= 0.9, "test").otherwise("train")).write.partitionBy("lane", "chr").parquet(at)
    return files.read_lane(d.sparkSession, at, "test", ["chr2", "chr3", "chr99"]).select("gene_id", "src_order", "src_line")


@query("S13_split_by_chr", f"SELECT {VID} AS variant_id, pip, chr FROM fx_pip WHERE chr <> 'chr4'", "fx_pip")
def _(d):
    at = shared_folder(d.sparkSession, "scores")
    files.write_by_chr(files.with_chr(d.select(vid().alias("variant_id"), "pip")), at)
    return files.read_chr(d.sparkSession, at).where("chr <> 'chr4'")
