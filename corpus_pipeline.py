"""From raw documents to token digests, in five stages; each stage reads what its predecessor kept, as a written table.

quality classifier -> near-duplicates -> personal data -> mixing -> BPE. All but the last return the columns of documents.

In every stage null text counts as empty, null ids are kept as documents of their own, very long texts are used whole, columns beyond
the known ones are carried along whatever their names, an id with several texts is one document a text, and an empty table gives an empty one. Repeated
rows: the second stage leaves one of them; the others treat them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.bpe import encode_digests
from locusframe.llm.common import kept_whole, table, written
from locusframe.llm.mixing import mix
from locusframe.llm.near_dup import near_duplicates
from locusframe.llm.pii import find_pii, with_masked
from locusframe.llm.quality_model import quality_model


def _same(found: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(f"{found}_id")) & (F.col("text_hash") == F.col(f"{found}_hash"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (operator 9). Empty texts are scored too, and go if their score is low."""
    bad = quality_model(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    return kept_whole(docs).join(bad, _same("bad"), "left_anti").select("row.*")


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (operator 2: five words, similarity 0.8): of the smallest id, and of repeated rows one.

    Texts without words are nobody's duplicates, but a row repeated whole goes; rows without an id all stay.
    """
    found = near_duplicates(docs, n=5, percent=80).where("kept and doc_id is not null").groupBy(F.col("component_id").alias("one_id"), F.coalesce("component", F.col("text_hash").cast("string")).alias("component"))
    found = found.agg(F.min("text_hash").alias("one_hash"))
    d = kept_whole(docs)
    one = d.join(found, (F.col("doc_id") == F.col("one_id")) & (F.col("text_hash") == F.col("one_hash")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return one.select("row.*").unionByName(d.where("doc_id is null").select("row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets (operator 3); n_chars follows the text where it changed."""
    found = find_pii(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("pii_id"), F.col("text_hash").alias("pii_hash"), "spans").dropDuplicates(["pii_id", "pii_hash"])
    d = kept_whole(docs).join(found, _same("pii"), "left")
    hit = F.col("spans").isNotNull()
    d = with_masked(d, "text", "spans", "clean")
    new = {"text": F.col("clean"), "n_chars": F.when(hit, F.length("clean").cast("bigint")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("clean")}
    return d.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights meet the source, language and topic targets (operator 5)."""
    return mix(kept_whole(docs).select("row", "doc_id", "text", "row.source", "row.lang"), drop=("text",)).where("_in").select("row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as digests, and their decoding (operator 4)."""
    import public_tokenizers

    return encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_model", quality), ("near_dup", near_dup), ("personal_data", personal_data), ("mixing", mixing), ("bpe", bpe)]

#: No stage but the third can be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
