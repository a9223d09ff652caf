"""Registered queries of the numbered operators, each over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from locusframe.llm import sql
from locusframe.llm.common import table
from locusframe.llm.quality_rules import STOP_WORDS


def op1_ngram_lm(spark, sf_dir):
    from locusframe.llm.ngram_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op2_near_dup(spark, sf_dir):
    from locusframe.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op3_personal_data(spark, sf_dir):
    from locusframe.llm.pii import op3_personal_data as run

    return run(table(spark, sf_dir, "documents"))


def op4_bpe_codec(spark, sf_dir):
    import public_tokenizers

    from locusframe.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_mix_to_targets(spark, sf_dir):
    from locusframe.llm.mixing import op5_mix_to_targets as run

    return run(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    from locusframe.llm.quality_rules import op6_quality_rules as run

    return run(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    from locusframe.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_html_text(spark, sf_dir):
    from locusframe.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op9_quality_model(spark, sf_dir):
    from locusframe.llm.quality_model import quality_model

    return quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_topk(spark, sf_dir):
    from locusframe.llm.topk import topk

    return topk(table(spark, sf_dir, "embeddings"))


def op11_dialogue_repair(spark, sf_dir):
    from locusframe.llm.dialogue import op11_dialogue_repair as run

    return run(table(spark, sf_dir, "conversations"))


def op12_whitening(spark, sf_dir):
    from locusframe.llm.whitening import op12_whitening as run

    return run(table(spark, sf_dir, "embeddings"))


def op13_near_vectors(spark, sf_dir):
    from locusframe.llm.vector_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_ngram_lm, op2_near_dup, op3_personal_data, op4_bpe_codec, op5_mix_to_targets, op6_quality_rules, op7_suffix_dedup, op8_html_text, op9_quality_model, op10_exact_topk,
                                op11_dialogue_repair, op12_whitening, op13_near_vectors)}

ORACLE_SQL = {
    "op2_near_dup": sql.NEAR_DUP,
    "op7_suffix_dedup": sql.SUFFIX_DEDUP,
    "op11_dialogue_repair": sql.DIALOGUE_REPAIR,
    "op13_near_vectors": sql.NEAR_VECTORS,
    "op6_quality_rules": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS t FROM documents),
 w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
 o AS (SELECT rid, UNNEST(ws) AS x, UNNEST(RANGE(1, len(ws) + 1)) AS p FROM w WHERE len(ws) >= 5),
 g AS (SELECT rid, p, x || ' ' || LEAD(x) OVER q || ' ' || LEAD(x, 2) OVER q || ' ' || LEAD(x, 3) OVER q || ' ' || LEAD(x, 4) OVER q AS five FROM o WINDOW q AS (PARTITION BY rid ORDER BY p)),
 h AS (SELECT rid, p, COUNT(*) OVER (PARTITION BY rid, five) AS n FROM g WHERE five IS NOT NULL),
 r AS (SELECT rid, COUNT(DISTINCT p + k) AS n_rep FROM (SELECT rid, p, UNNEST([0, 1, 2, 3, 4]) AS k FROM h WHERE n > 1) x GROUP BY rid),
 c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(COALESCE(n_rep, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[^!]+', '', 'g')) AS bang, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS upper,
  length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS alpha, len(ls) AS n_lines, len(list_filter(ws, lambda x: lower(x) IN (STOPS))) AS stops FROM w LEFT JOIN r USING (rid)),
 b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars / CAST(n_words AS DOUBLE) BETWEEN 2 AND 16 AND n_symbols / CAST(n_words AS DOUBLE) <= 0.25 AND bang / CAST(n_words AS DOUBLE) <= 0.5
 AND stops / CAST(n_words AS DOUBLE) >= 0.02 AND COALESCE(n_dup_lines / CAST(NULLIF(n_lines, 0) AS DOUBLE), 0) <= 0.5 AND COALESCE(upper / CAST(NULLIF(alpha, 0) AS DOUBLE), 0) <= 0.7 AS kept FROM b
""".replace("STOPS", ", ".join(f"'{w}'" for w in STOP_WORDS)),
    "op10_exact_topk": """
WITH v AS (SELECT vec_id, embedding AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 w AS (SELECT vec_id, list_transform(e, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS z FROM v),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.z, c.z) AS BIGINT) AS score
  FROM w q JOIN w c ON c.vec_id <> q.vec_id AND len(c.z) = len(q.z) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t WHERE rank <= 10
""",
}
