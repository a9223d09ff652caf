"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 9).

One pass turns every text into a short vector of statistics, written once to the shared folder. The trees are fitted on the
driver on at most `max_train_rows` labelled rows, drawn by a hash of doc_id (a documented bound: the model's size and
the driver's memory do not grow with the corpus); every document is scored by Spark tasks that walk the flattened arrays of
all trees with numpy. Labels, lang, source and doc_id never enter the vector.

Defined results: null text counts as empty and is scored like any other; labels that are null or without a document are not
used; repeated labels of a document count once (highest wins); without two classes of labels every score is the label mean
(0.5 without labels); repeated rows are scored alike; null ids are scored and not held out; very long texts are used whole; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import crc_mod, hands_back, hashed, written

BYTE_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": [32], "newline": [10], "high": range(128, 256),
    "comma": [44], "stop": [46], "exclaim": [33], "pipe": [124], "symbol": [ord(c) for c in "#*$%&<>"], "quote": [34, 39],
    "bracket": [ord(c) for c in "()[]{}"], "other": [ord(c) for c in "+-/:;=?@\\^_`~"],
}
FEATURES = ["log_bytes", *BYTE_CLASSES, "mean_word", "max_word", "distinct_words", "log_words", "mean_line", "dup_lines", "short_lines", "top_word"]


def statistics(texts_: list[str]) -> np.ndarray:
    """One row of FEATURES per text."""
    n = len(texts_)
    counts = np.zeros((n, 256))
    rest = np.zeros((n, 8))
    for i, t in enumerate(texts_):
        b = t.encode("utf-8", "surrogatepass")
        counts[i] = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        ws = b.split()
        if not ws:
            continue
        seen: dict = {}
        for w in ws:
            seen[w] = seen.get(w, 0) + 1
        lines = [x for x in b.split(b"\n") if x.strip()]
        chars = sum(map(len, ws))
        rest[i] = (
            chars / len(ws), max(map(len, seen)), len(seen) / len(ws), np.log1p(len(ws)), np.log1p(chars / len(lines)),
            1 - len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines), max(seen.values()) / len(ws),
        )
    total = counts.sum(1)
    shares = np.stack([counts[:, list(c)].sum(1) for c in BYTE_CLASSES.values()], 1) / np.maximum(total, 1)[:, None]
    return np.concatenate([np.log1p(total)[:, None], shares, rest], 1)


def features(docs: DataFrame) -> DataFrame:
    @hands_back
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "x": list(statistics(b["text"].tolist()))})

    return hashed(docs).mapInPandas(run, "doc_id bigint, text_hash bigint, x array<double>")


@dataclass
class Trees:
    """All trees flattened: node arrays, with the roots' positions. A leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for r in self.roots:
            at = np.full(len(x), r)
            for _ in range(self.depth):
                f = self.feature[at]
                down = np.where(x[rows, np.maximum(f, 0)] <= self.cut[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, down)
            raw += self.value[at]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, min_rows: int = 8) -> Trees:
    """Second-order boosting of the logistic loss; splits are searched over histograms of quantile bins."""
    n, d = x.shape if len(x) else (0, len(FEATURES))
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) if n else np.zeros(0) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], 1) if n else np.zeros((0, d), int)
    nodes: list[list] = []
    roots, raw = [], np.full(n, base)
    two = n > 0 and 0 < y.sum() < n
    for _ in range(n_trees if two else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([-1, 0.0, 0, 0, 0.0])
        todo = [(roots[-1], np.arange(n), 0)]
        while todo:
            k, rows, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            if level < depth and len(rows) >= 2 * min_rows:
                for j in range(d):
                    if not len(cuts[j]):
                        continue
                    b = binned[rows, j]
                    m = len(cuts[j]) + 1
                    gl, hl = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (g[rows], h[rows]))
                    nl = np.cumsum(np.bincount(b, minlength=m))[:-1]
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(nl < min_rows) | (len(rows) - nl < min_rows)] = -1
                    if gain[i := int(gain.argmax())] > best[0]:
                        best = (gain[i], j, i)
            if best[1] < 0:
                nodes[k][4] = rate * gs / (hs + l2)
                raw[rows] += nodes[k][4]
                continue
            _, j, i = best
            go = binned[rows, j] <= i
            nodes[k][:4] = [j, float(cuts[j][i]), len(nodes), len(nodes) + 1]
            nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
            todo += [(nodes[k][2], rows[go], level + 1), (nodes[k][3], rows[~go], level + 1)]
    a = np.array(nodes, float).reshape(-1, 5)
    return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots, int), depth, base)


def quality_model(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_train_rows: int = 20_000, held_mod: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, text_hash for every document."""
    x = written(features(docs), "quality-features")
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label_col).cast("double").alias("y"))
    train = x.join(known, "doc_id").where(crc_mod(F.col("doc_id"), held_mod) != held)
    # A hash threshold cuts the rows to about as many as are taken before any task sorts its own, so what reaches the driver does not grow with tasks.
    h = F.xxhash64("doc_id")
    share = min(1.0, 1.02 * max_train_rows / max(1, train.count()))
    few = train.where(F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = few.orderBy(h, "doc_id", "text_hash").limit(max_train_rows).select("x", "y").toPandas()
    model = fit(np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES)), rows["y"].to_numpy(float))

    @hands_back
    def run(batches):
        for b in batches:
            s = model.score(np.array(b["x"].tolist(), float).reshape(-1, len(FEATURES)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "score": s})

    out = x.mapInPandas(run, "doc_id bigint, text_hash bigint, score double")
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), held_mod) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_hash")
