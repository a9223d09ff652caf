"""Exact top-k inner-product search with a KD-tree per shard (operator 10).

Vectors are dealt to shards by the top of one KD-tree: median splits of a bounded sample give at most `regions` regions, and a region
with more than `shard_rows` vectors is dealt on by a hash. Every region has a tight box, found over all its vectors. A task holds one
shard and at most `query_rows` queries, builds a tree of median splits with tight boxes, and walks it best-first: a node's bound is the
largest inner product that any point of its box can have with the query, and the walk ends when no bound reaches the k-th score.
Every query first visits its home shard; the k-th score found there travels with it, and it visits only shards of regions whose
box bound reaches that score, where it prunes from the start. A shard's vectors are copied once per `query_rows` queries that visit it.

The sample and the number of regions steer the work only. Splits and boxes (regions x dimensions) are all that the driver holds.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids or vectors so large that a score could pass 2**62; ties go to
the smaller id; vectors are compared with those of the same length only; of a repeated id every other-id row is a candidate,
and a repeated query id is answered once; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.llm.common import written

FOUND = "query_id bigint, vec_id bigint, score bigint"


class KDTree:
    """Median splits along the widest side; lo and hi are the tight bounds of each node's points."""

    def __init__(self, points: np.ndarray, leaf: int = 128):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left child, right child (-1: leaf)
        lo, hi = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            p = points[self.order[a:b]]
            k = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            lo.append(p.min(0))
            hi.append(p.max(0))
            if parent >= 0:
                s, e, left, right = self.nodes[parent]
                self.nodes[parent] = (s, e, k, right) if side == 0 else (s, e, left, k)
            width = hi[-1] - lo[-1]
            if b - a > leaf and width.max() > 0:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(p[:, width.argmax()], mid)]
                todo += [(a, a + mid, k, 0), (a + mid, b, k, 1)]
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.points = points[self.order]

    def bound(self, q: np.ndarray, nodes) -> np.ndarray:
        return np.maximum(self.lo[nodes] * q, self.hi[nodes] * q).sum(-1)

    def search(self, q: np.ndarray, ids: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """The k best (score, id), by score and then smaller id; nothing below `least`. ids: of the points in tree order."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id), worst first
        heap = [(-int(self.bound(q, [0])[0]), 0)]
        while heap:
            bound, at = heapq.heappop(heap)
            floor = best[0][0] if len(best) == k else least
            if floor is not None and -bound < floor:
                break
            a, b, left, right = self.nodes[at]
            if left >= 0:
                for c, v in zip((left, right), self.bound(q, [left, right]), strict=True):
                    if floor is None or v >= floor:
                        heapq.heappush(heap, (-int(v), c))
                continue
            s = self.points[a:b] @ q
            for i in np.flatnonzero(s >= floor) if floor is not None else range(b - a):
                if ids[a + i] == own:
                    continue
                item = (int(s[i]), -int(ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i) for s, i in best]


def _matrix(rows) -> np.ndarray:
    m = np.array(rows.tolist(), np.int64)
    big = float(np.abs(m).max(initial=0)) ** 2 * m.shape[1]
    return m.astype(np.float64) if big < 2**53 else m  # float sums of integers below 2**53 are exact


def _search(k: int):
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(queries):
            m = _matrix(pd.concat([points["v"], queries["q"]]))
            tree = KDTree(m[: len(points)])
            ids = points["vec_id"].to_numpy()[tree.order]
            for q, own, least in zip(m[len(points) :], queries["query_id"], queries["least"], strict=True):
                out += [(own, i, s) for s, i in tree.search(q, ids, own, k, None if pd.isna(least) else int(least))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


class Regions:
    """Median splits of a sample, one tree for each vector length; leaves are numbered over all of them."""

    def __init__(self, sample: dict[int, np.ndarray], wanted: dict[int, int]):
        self.roots: dict[int, int] = {}
        self.nodes: list[tuple] = []  # (dimension, value, left, right), or (-1, leaf number, 0, 0)
        self.size = 0
        for d, points in sorted(sample.items()):
            self.roots[d] = self._grow(points, wanted[d])

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        width = points.max(0) - points.min(0) if len(points) else np.zeros(1)
        side = int(width.argmax())
        value = np.median(points[:, side]) if len(points) else 0
        low = points[:, side] <= value if len(points) else np.zeros(0, bool)
        if leaves < 2 or not low.any() or low.all():
            self.nodes[at] = (-1, self.size, 0, 0)
            self.size += 1
        else:
            left = self._grow(points[low], leaves // 2)
            self.nodes[at] = (side, value, left, self._grow(points[~low], leaves - leaves // 2))
        return at

    def of(self, m: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        out, todo = np.zeros(len(m), np.int64), [(self.roots[m.shape[1]], np.arange(len(m)))]
        while todo:
            at, rows = todo.pop()
            side, value, left, right = self.nodes[at]
            if side < 0:
                out[rows] = value
            elif len(rows):
                low = m[rows, side] <= value
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


def _dealt(regions: Regions):
    def run(batches):
        for b in batches:
            leaf = np.zeros(len(b), np.int64)
            for d, rows in b.groupby("d").indices.items():
                leaf[rows] = regions.of(np.array(b["v"].iloc[rows].tolist(), np.int64).reshape(-1, d))
            yield b.assign(leaf=leaf)

    return run


def _boxes(rows: pd.DataFrame) -> pd.DataFrame:
    lo, hi = (np.array(rows[c].tolist(), np.int64) for c in ("lo", "hi"))
    return pd.DataFrame({"leaf": [int(rows["leaf"].iloc[0])], "n": [int(rows["n"].sum())], "lo": [lo.min(0)], "hi": [hi.max(0)]})


def _partial_boxes(batches):
    for b in batches:
        for leaf, part in b.groupby("leaf"):
            m = np.array(part["v"].tolist(), np.int64)
            yield pd.DataFrame({"leaf": [leaf], "n": [len(m)], "lo": [m.min(0)], "hi": [m.max(0)]})


BOX = "leaf bigint, n bigint, lo array<bigint>, hi array<bigint>"


def topk(vectors: DataFrame, k: int = 10, query_mod: int = 100, scale: int = 1024, shard_rows: int = 4096, query_rows: int = 65_536, regions: int = 1024, sample: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by query_mod, against all other rows."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.forall("e", finite))
    v = v.where(F.forall("e", lambda x: F.abs(x) * float(scale) <= F.sqrt(2.0**62 / F.size("e"))))  # else a score could overflow a long
    v = v.select("vec_id", F.transform("e", lambda x: F.floor(x * float(scale)).cast("bigint")).alias("v"), F.size("e").alias("d"))
    spark = vectors.sparkSession
    lengths = {r["d"]: r["count"] for r in v.groupBy("d").count().collect()}
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    rows = sum(lengths.values())
    draw = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 40)) < int(min(1.0, sample / rows) * (1 << 40))
    drawn: dict[int, list] = {d: [] for d in lengths}
    for r in v.where(draw).select("d", "v").collect():  # about `sample` vectors
        drawn[r.d].append(r.v)
    wanted = {d: max(1, min(regions * n // rows, -(-n // shard_rows))) for d, n in lengths.items()}
    tree = Regions({d: np.array(sorted(x), np.int64).reshape(-1, d) for d, x in drawn.items()}, wanted)
    v = written(v.mapInPandas(_dealt(tree), "vec_id bigint, v array<bigint>, d int, leaf bigint"), "topk-points")
    box = v.select("leaf", "v").mapInPandas(_partial_boxes, BOX).groupBy("leaf").applyInPandas(_boxes, BOX).collect()
    parts = {r.leaf: max(1, -(-r.n // shard_rows)) for r in box}
    sizes = spark.createDataFrame([(leaf, n) for leaf, n in parts.items()], "leaf bigint, parts bigint")
    place = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    points = v.join(sizes, "leaf").withColumn("shard", place("vec_id"))
    queries = v.where(F.col("vec_id") % query_mod == 0).dropDuplicates(["vec_id"]).join(sizes, "leaf")
    queries = written(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("d").alias("qd"), F.col("leaf").alias("home_leaf"), place("vec_id").alias("home")), "topk-queries")

    def search(asked: DataFrame) -> DataFrame:
        """asked: query_id, q, least, at_leaf, at_shard. A shard's points meet its queries in groups of query_rows."""
        groups = asked.groupBy("at_leaf", "at_shard").agg(F.ceil(F.count("*") / query_rows).alias("groups"))
        asked = asked.join(groups, ["at_leaf", "at_shard"]).withColumn("group", F.pmod(F.xxhash64("query_id", F.lit(7)), F.col("groups")))
        held = points.join(groups.withColumnsRenamed({"at_leaf": "leaf", "at_shard": "shard"}), ["leaf", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)))
        held, asked = held.select("leaf", "shard", "part", "vec_id", "v"), asked.select("at_leaf", "at_shard", "group", "query_id", "q", "least")
        return held.groupBy("leaf", "shard", "part").cogroup(asked.groupBy("at_leaf", "at_shard", "group")).applyInPandas(_search(k), FOUND)

    home = queries.select("query_id", "q", F.lit(None).cast("bigint").alias("least"), F.col("home_leaf").alias("at_leaf"), F.col("home").alias("at_shard"))
    first = written(search(home), "topk-home")
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    lo, hi = ({r.leaf: np.array(x, float) for r, x in zip(box, xs, strict=True)} for xs in ([r.lo for r in box], [r.hi for r in box]))

    def visits(batches):
        """The shards, but for its home, whose region's box can reach a query's k-th score."""
        by_length: dict[int, list[int]] = {}
        for leaf, x in lo.items():
            by_length.setdefault(len(x), []).append(leaf)
        for b in batches:
            for d, at in b.groupby("qd").indices.items():
                leaves = by_length[d]
                some = b.iloc[at]
                q = np.array(some["q"].tolist(), float)
                low, high = (np.array([m[leaf] for leaf in leaves]) for m in (lo, hi))
                # Rounding of the bound is far below one; a score is a whole number.
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                floor = some["least"].to_numpy(float, na_value=-np.inf)
                i, j = np.nonzero(bound * (1 + 1e-12) + 1 >= floor[:, None] - np.abs(floor[:, None]) * 1e-12)
                out = [(p, leaves[s], shard) for p, s in zip(i, j, strict=True) for shard in range(parts[leaves[s]])]
                to = pd.DataFrame(out, columns=["i", "at_leaf", "at_shard"])
                full = some.iloc[to["i"]].reset_index(drop=True).assign(at_leaf=to["at_leaf"], at_shard=to["at_shard"])
                yield full[(full["at_leaf"] != full["home_leaf"]) | (full["at_shard"] != full["home"])][["query_id", "q", "least", "at_leaf", "at_shard"]]

    others = queries.join(least, "query_id", "left").select("query_id", "q", F.col("least"), "qd", "home_leaf", "home")
    others = written(others.mapInPandas(visits, "query_id bigint, q array<bigint>, least bigint, at_leaf bigint, at_shard bigint"), "topk-visits")
    found = first.unionByName(search(others))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
