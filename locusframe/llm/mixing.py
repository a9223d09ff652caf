"""Mixing sources to target weights by iterative proportional fitting (operator 5).

One pass gives every document its tokens (words) and its topic, and writes them as a table; token totals are counted per (source,
language, topic) cell. The tokens to keep of each cell are raked in turn to the target shares of each dimension, and cut at
what the cell holds, until every marginal is within `tolerance` of its target: what a full cell cannot give, the other cells of its
source, language and topic make up. Where a value holds less than its share of the sample asked for, the sample's size is lowered to
what that value allows. Documents are then kept with probability kept tokens / tokens of their cell, decided by a hash of doc_id,
so a sample is the same on every run and on every executor.

Only the aggregated cells are iterated on, by window sums over a dimension's value (cells, not documents: a window holds sources times topics). The factors return to the
documents by a join on the cell key (no broadcast is forced; a cell may hold a third of the documents, which AQE splits on
the document side).

Topics come from content: words hashed to `BUCKETS`, square roots of their counts, as unit vectors, less the mean of the
document's language, so that a topic is no language; centroids are fitted by spherical k-means on all documents, and each document
takes its nearest. Vectors are written once (1 kB a document before compression); a step of the fit is one pass over them, and only
sums of a centroid's members, or one vector, come back. All products and sums are of whole numbers, exact in double precision, so neither the
order in which rows arrive nor the size of a batch can move a document to another topic. A corpus with a topic column passes it as `topic`.

Defined results: a null source, language or topic is a value of its own (shown as an empty string); null text counts as empty
and an empty text as one token, so every document has a weight; targets for values that do not occur are spread over the
others; a value without a target has target 0; repeated rows are sampled alike; documents without an id draw by their text; very long texts are
used whole; extra columns are carried by mix() and ignored by op5; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.llm.common import HashedWords, hands_back, written

DIMENSIONS = ("source", "lang", "topic")
BUCKETS = 512
STEPS = 1024


def vectors(texts: list[str], words: HashedWords) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of hashed words, of length about STEPS in whole steps, and the number of words of each text."""
    found = words.batch(texts)
    out = np.zeros((len(texts), BUCKETS))
    for row, h in zip(out, found, strict=True):
        if len(h):
            row += np.sqrt(np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS))
    return stepped(np.rint(out * STEPS)), np.array([len(x) for x in found], np.int64)


def stepped(x: np.ndarray) -> np.ndarray:
    """Rows brought to length STEPS and rounded to whole numbers; a zero row stays."""
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.rint(STEPS * x / np.where(size > 0, size, 1))


def unpacked(x: pd.Series) -> np.ndarray:
    """Rows of packed vectors as doubles."""
    return np.frombuffer(b"".join(x), np.int16).astype(np.float64).reshape(-1, BUCKETS)


def packed(x: np.ndarray) -> list[bytes]:
    return [v.tobytes() for v in x.astype(np.int16)]


def chunks(batches: Iterator[pd.DataFrame], size: int = 2000) -> Iterator[pd.DataFrame]:
    for b in batches:
        for a in range(0, len(b), size):
            yield b.iloc[a : a + size]


def added_up(parts: DataFrame, key: str) -> DataFrame:
    """Partial sums (key, n, s: an array) of tasks to one row a key and position `dim`: n and v."""
    return parts.select(key, "n", F.posexplode("s").alias("dim", "v")).groupBy(key, "dim").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


def language_means(seen: DataFrame) -> DataFrame:
    """(_lang, _mean): the mean vector of all documents of a language that have words, in whole numbers."""

    @hands_back
    def run(batches):
        sums: dict = {}
        for b in chunks(batches):
            x, langs = unpacked(b["_x"]), b["_lang"].to_numpy()
            for lang in set(langs):
                n, s = sums.get(lang, (0, 0))
                sums[lang] = (n + int((langs == lang).sum()), s + x[langs == lang].sum(0))
            if len(sums) > 256:  # a task holds few languages at once
                yield table(sums)
                sums = {}
        if sums:
            yield table(sums)

    def table(sums: dict) -> pd.DataFrame:
        return pd.DataFrame({"_lang": list(sums), "n": [n for n, _ in sums.values()], "s": [v.astype(np.int64) for _, v in sums.values()]})

    parts = seen.where("_words > 0").select("_lang", "_x").mapInPandas(run, "_lang string, n bigint, s array<bigint>")
    means = added_up(parts, "_lang").groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("dim", F.rint(F.col("v") / F.col("n")).cast("smallint").alias("m")))).alias("_m"))
    return means.select("_lang", F.col("_m.m").alias("_mean"))


def centred(x: np.ndarray, means: pd.Series) -> np.ndarray:
    return stepped(x - np.stack(list(means)).astype(np.float64)) if len(x) else x


def fitted(z: DataFrame, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of all vectors of z (column z, packed). The first is the least vector, then each time the one least like those taken; then rounds of spherical k-means."""

    def least_like(c: np.ndarray):
        @hands_back
        def run(batches):
            best = None
            for b in chunks(batches):
                like = (unpacked(b["z"]) @ c.T).max(1)
                found = (like.min(), min(b["z"].to_numpy()[like == like.min()]))
                best = found if best is None else min(best, found)
            if best is not None:
                yield pd.DataFrame([best], columns=["like", "z"])

        return run

    def members(c: np.ndarray):
        @hands_back
        def run(batches):
            n, s = np.zeros(len(c), np.int64), np.zeros(c.shape)
            for b in chunks(batches):
                x = unpacked(b["z"])
                of = (x @ c.T).argmax(1)
                n += np.bincount(of, minlength=len(c))
                s += np.eye(len(c))[of].T @ x
            if n.any():
                yield pd.DataFrame({"c": np.arange(len(c)), "n": n, "s": list(s.astype(np.int64))})[n > 0]

        return run

    first = z.agg(F.min("z")).first()[0]
    if first is None:
        return np.zeros((0, BUCKETS))
    picked = [first]
    while len(picked) < k:
        far = z.mapInPandas(least_like(unpacked(pd.Series(picked))), "like double, z binary")
        picked.append(far.agg(F.min(F.struct("like", "z")).alias("f")).first().f.z)
    c = unpacked(pd.Series([bytes(p) for p in picked]))
    for _ in range(rounds):
        sums, now = np.zeros(c.shape), c.copy()
        for r in added_up(z.mapInPandas(members(c), "c int, n bigint, s array<bigint>"), "c").collect():  # k times BUCKETS numbers
            sums[r.c, r.dim] = r.v
            now[r.c] = 0
        now = np.where((now == 0).all(1, keepdims=True), stepped(sums), c)
        if (now == c).all():
            break
        c = now
    return c


def with_cells(docs: DataFrame, topic: Column | None = None, topics: int = 8, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs (without the columns of `drop`), written once, with _source, _lang, _topic and _tokens; topics are fitted unless a topic column is given."""
    label = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    @hands_back
    def hashed_words(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = HashedWords()
        for t in parts:
            xs, counts = [], []
            for a in range(0, len(t), 500):
                x, n = vectors(t.iloc[a : a + 500].tolist(), words)
                xs += packed(x)
                counts.append(n)
            yield pd.DataFrame({"x": xs, "n": np.concatenate(counts) if counts else np.zeros(0, np.int64)})

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in drop]
    seen = F.pandas_udf(hashed_words, "x binary, n bigint")(F.coalesce(F.col("text"), F.lit("")))
    d = docs.withColumn("_seen", seen).select(*kept, label(F.col("source")).alias("_source"), label(F.col("lang")).alias("_lang"), F.col("_seen.n").alias("_words"),
                                              *([F.col("_seen.x").alias("_x")] if topic is None else [label(topic).alias("_topic")]))
    d = written(d, "mix-documents")
    shown = [*[F.col(f"`{c}`") for c in docs.columns if c not in drop], "_source", "_lang", "_topic", F.greatest("_words", F.lit(1).cast("bigint")).alias("_tokens")]
    if topic is not None:
        return d.select(*shown)
    means = written(language_means(d), "mix-means")

    def centre(x: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([v for a in range(0, len(x), 2000) for v in packed(centred(unpacked(x.iloc[a : a + 2000]), m.iloc[a : a + 2000]))], dtype=object)

    z = F.pandas_udf(centre, "binary")("_x", "_mean").alias("z")
    c = fitted(written(d.where("_words > 0").select("_lang", "_x").join(means, "_lang").select(z), "mix-vectors"), topics)

    def nearest(x: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        out = np.full(len(x), "", object)
        for a in range(0, len(x), 2000):
            has = np.nonzero(n.to_numpy()[a : a + 2000] > 0)[0] + a
            if len(has):
                out[has] = [f"t{k}" for k in (centred(unpacked(x.iloc[has]), m.iloc[has]) @ c.T).argmax(1)]
        return pd.Series(out)

    return d.join(means, "_lang", "left").withColumn("_topic", F.pandas_udf(nearest, "string")("_x", "_mean", "_words")).select(*shown)


def flattened(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Default target: observed shares raised to `power`, which lifts small values and lowers large ones."""
    return cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), power).alias("target"))


def goals(cells: DataFrame, targets: dict[str, DataFrame], rate: float) -> tuple[dict[str, DataFrame], float]:
    """Per dimension the tokens to keep of each value that occurs, and the share of all tokens that the sample holds: `rate`, or less where a value has too few."""
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    share = {}
    for d, t in targets.items():
        have = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("have"))
        g = have.join(t.groupBy(d).agg(F.sum("target").alias("target")), d, "left").select(d, "have", F.coalesce("target", F.lit(0.0)).alias("target"))
        whole = g.agg(F.sum("target")).first()[0] or 1.0
        share[d] = written(g.select(d, "have", (F.col("target") / whole).alias("share")), "mix-targets")
        most = share[d].where("share > 0").agg(F.min(F.col("have") / F.col("share"))).first()[0]
        if most is not None and total:
            rate = min(rate, most / total)
    return {d: g.select(d, (F.col("share") * rate * total).alias(f"goal_{d}")) for d, g in share.items()}, rate


def rake(cells: DataFrame, targets: dict[str, DataFrame], rate: float, tolerance: float = 0.002, rounds: int = 60, rounds_a_check: int = 4) -> DataFrame:
    """cells (dimensions, tokens) with `weight`, the tokens to keep of each, at most its tokens.

    A round scales and cuts for each dimension in turn. Every few rounds the table is written and the largest miss of a value, as
    a share of the sample, is measured; it ends at `tolerance`, or after `rounds` where no sample meets all targets.
    """
    goal, rate = goals(cells, targets, rate)
    w = cells.withColumn("weight", F.col("tokens") * F.lit(float(rate)))
    for d, g in goal.items():
        w = w.join(g, d)
    w = written(w, "raked-cells")
    total = w.agg(F.sum("weight")).first()[0] or 0.0
    for i in range(rounds if total else 0):
        for d in targets:
            have = F.sum("weight").over(Window.partitionBy(d))
            scaled = F.coalesce(F.try_divide(F.col("weight") * F.col(f"goal_{d}"), have), F.lit(0.0))
            w = w.withColumn("weight", F.least(F.col("tokens").cast("double"), scaled))
        if (i + 1) % rounds_a_check == 0 or i == rounds - 1:
            w = written(w, "raked-cells")
            if max(miss(w, d) for d in targets) <= tolerance * total:
                break
    return w


def miss(cells: DataFrame, dim: str) -> float:
    """Of the values of a dimension, the largest difference in tokens between what is kept and the goal."""
    g = cells.groupBy(dim).agg(F.sum("weight").alias("_w"), F.max(f"goal_{dim}").alias("_g"))
    return g.agg(F.max(F.abs(F.col("_w") - F.col("_g")))).first()[0] or 0.0


def calibrated(celled: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = 0.7, rate: float = 0.5, **how) -> DataFrame:
    """Cells with tokens, weight, goals and keep, the probability of a document. celled: of with_cells(). rate: the share of all tokens to keep."""
    cells = written(celled.groupBy(*[F.col(f"_{c}").alias(c) for c in DIMENSIONS]).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs")), "cells")
    given = targets or {}
    raked = rake(cells, {c: given.get(c) or flattened(cells, c, power) for c in DIMENSIONS}, rate, **how)
    # Sums of doubles differ in their last digits with the order of rows; nine digits of a probability do not.
    return raked.withColumn("keep", F.round(F.coalesce(F.try_divide("weight", "tokens"), F.lit(0.0)), 9))


def unit(doc_id: Column, seed: int, text: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone; on the text where there is no id."""
    h = F.when(doc_id.isNull(), F.xxhash64(text, F.lit(seed))).otherwise(F.xxhash64(doc_id, F.lit(seed)))
    return F.pmod(h, F.lit(1 << 52)).cast("double") / float(1 << 52)


def mix(docs: DataFrame, seed: int = 17, topic: Column | None = None, drop: tuple[str, ...] = (), **how) -> DataFrame:
    """docs (without the columns of `drop`) with source/lang/topic cell, tokens, keep probability and whether the document is in the sample."""
    draw = unit(F.col("doc_id"), seed, F.coalesce(F.col("text"), F.lit("")))
    celled = with_cells(docs.withColumn("_draw", draw), topic, drop=drop)
    f = calibrated(celled, **how).select(*[F.col(c).alias(f"_{c}") for c in DIMENSIONS], F.col("keep").alias("_keep"), F.col("weight").alias("_weight"))
    d = celled.join(f, [f"_{c}" for c in DIMENSIONS], "left")
    return d.withColumn("_in", F.col("_draw") < F.col("_keep")).drop("_draw")


def op5_mix_to_targets(docs: DataFrame) -> DataFrame:
    d = mix(docs.select("doc_id", "text", "source", "lang"), drop=("text",))
    return d.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
                    F.col("_keep").alias("keep_probability"), F.col("_in").alias("sampled"))
