"""Quality rules: a threshold table compiled into one Spark projection (operator 6; built-in functions only).

A rule is (name, metric, comparison, limit). Metrics are column expressions over one text; each rule becomes a boolean column
and `kept` is their conjunction, all inside one projection: no Python, no shuffle, no driver work, so cost is linear in the text.

Defined results: null text counts as empty; an empty text has every count 0 and fails `n_words`. Very long texts are treated
whole. Ties and repeated rows do not matter (rows are independent); an empty table gives an empty result; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import SPACE, WORD, texts

# Frequent function words of English, Spanish, French and German.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this or from at not but which have an "
    "de la el en y los se del las un por con una su para es al lo que no "
    "le les des et un une du dans qui au pour pas sur est par il plus ce ne "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er"
).split()

#: (rule, metric, comparison that a good text meets, limit). Shares are of words or of code points in words.
THRESHOLDS = (
    ("mean_word_low", "mean_word_chars", ">=", 2.0),
    ("mean_word_high", "mean_word_chars", "<=", 16.0),
    ("symbols", "symbols_per_word", "<=", 0.25),
    ("exclamations", "exclamations_per_word", "<=", 0.5),
    ("stop_words", "stop_word_share", ">=", 0.02),
    ("duplicate_lines", "dup_line_share", "<=", 0.5),
    ("upper_case", "upper_share", "<=", 0.7),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def windows_of(hashes: Column, n: int) -> Column:
    """64-bit hashes of all n-word windows, from the word hashes."""
    at = lambda a, i: F.get(a, i)
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[at(hashes, i + k) for k in range(n)]))
    return F.when(F.size(hashes) > n, windows).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id with the four base counts and every metric of the threshold table."""
    d = texts(docs).withColumn("ws", _words(F.col("text")))
    d = d.withColumn("n_words", F.size("ws").cast("bigint"))
    d = d.withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))  # a column of its own: inside a lambda it would be redone for each element
    d = d.withColumn("win", windows_of(F.col("hs"), window))
    has_repeat = F.size("win") > F.size(F.array_distinct("win"))
    pairs = F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("srt", F.when(has_repeat, pairs))
    same = lambda x, i, j: F.coalesce(F.get("srt", j)["h"] == x["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter("srt", lambda x, i: same(x, i, i + 1) | ((i > 0) & same(x, i, F.greatest(i - 1, F.lit(0))))), lambda x: x["i"]))
    d = d.withColumn("starts", starts)
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("end")),
        lambda acc, s: F.struct((acc["n"] + s + window - F.greatest(s.cast("bigint"), acc["end"])).alias("n"), (s + window).cast("bigint").alias("end")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD))
    d = d.withColumn("lines", lines)
    words = F.col("n_words").cast("double")
    per_word = lambda c: F.coalesce(F.try_divide(c.cast("double"), words), F.lit(0.0))
    only = lambda cls: F.length(F.regexp_replace("text", f"[^{cls}]+", ""))
    d = d.select(
        "doc_id", "n_words", F.length(F.regexp_replace("text", SPACE, "")).cast("bigint").alias("word_chars"),
        only(r"#*$%&|<>").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("srt").isNotNull(), covered), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), only("!").alias("n_exclaim"), only("A-Z").alias("n_upper"), only("A-Za-z").alias("n_alpha"),
        F.size(F.filter("ws", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
    )
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per_word(F.col("word_chars")).alias("mean_word_chars"), per_word(F.col("n_symbols")).alias("symbols_per_word"),
        per_word(F.col("n_exclaim")).alias("exclamations_per_word"), per_word(F.col("n_stop")).alias("stop_word_share"),
        F.coalesce(F.try_divide(F.col("n_dup_lines"), F.col("n_lines")), F.lit(0.0)).alias("dup_line_share"),
        F.coalesce(F.try_divide(F.col("n_upper"), F.col("n_alpha")), F.lit(0.0)).alias("upper_share"),
    )


def compiled(thresholds=THRESHOLDS) -> list[Column]:
    """The threshold table as boolean columns rule_<name> (true: met)."""
    ops = {">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, "<": lambda c, v: c < v}
    return [ops[op](F.col(metric), F.lit(limit)).alias(f"rule_{name}") for name, metric, op, limit in thresholds]


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Counts, metrics, rule columns, base_failed and kept, one row per document."""
    m = measured(docs)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    d = m.select("*", base.alias("base_failed"), *compiled(thresholds))
    good = ~F.col("base_failed")
    for name, *_ in thresholds:
        good = good & F.col(f"rule_{name}")
    return d.withColumn("kept", good)


def op6_quality_rules(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
