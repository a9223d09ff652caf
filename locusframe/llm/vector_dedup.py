"""Near-duplicate vectors by an exact metric range join (operator 13): pivots cut the space, cells join on their own.

Distances are angles, a metric. A pair with cosine of at least `cosine` lies within the angle r.

1. Equal vectors of one label collapse to a class (a partial aggregate), so groups of exact copies cost one row.
2. A cell (at first: a label) with more than `cell_rows` home vectors is cut by pivots: every vector is at home with its nearest pivot,
   and also a guest of each cell that its ball of radius r can reach. By the triangle inequality that needs an angle to the pivot of
   at most the own pivot's plus 2r; and the ball must reach across the two pivots' bisecting plane, which is tighter. So a vector's
   partners are all among the members of its home cell. Cells still too full are cut once more, if that spares half their comparisons
   (measured on the sample: where vectors have no near ones, balls reach most cells, and further cuts only copy).
3. Every home vector meets the members of its cell, in blocks of at most `block` rows a side: its links are counted there and nowhere
   else, so no pair is counted twice. Pairs are never written: a task returns a count a vector, and the links that join components.
4. In a cell too full for one block, members within r/2 of the pivot are linked with one another by the triangle inequality alone: a
   dense group of near copies costs an aggregate, not its square.

Pivots steer only the work, never the result: they are drawn from up to `sample` vectors a cell, the densest first, each the mean of the
sample around it. Cosines are taken in double precision; within 1e-12 of the bound, from exactly rounded sums.

Defined results: null ids, and vectors that are null, empty, zero or hold null or non-finite components, or have no label, keep their
row with 0 links and themselves as component (kept; null for a null id); vectors meet those of their own length only; a repeated id counts as
another vector, so each of its rows counts the others; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.llm.common import written
from locusframe.llm.components import components

MEMBER = "cell string, key binary, w bigint, home boolean, core boolean, v binary"


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest entry first, so that no square overflows."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _rows(v, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(v), dtype).reshape(len(v), -1).astype(np.float64)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    dot = lambda x, y: math.fsum((x * y).tolist())
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def _prepared(dtype: str):
    """vec_id, label, the class hash (null for vectors that link with nothing) and the entries as bytes."""

    def run(batches):
        for b in batches:
            keys, raw = [], []
            for i, label, e in zip(b["vec_id"], b["label"], b["embedding"], strict=True):
                v = None if e is None or i is None or pd.isna(i) or label is None else np.array(e, np.float64)
                if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
                    keys.append(None)
                    raw.append(None)
                    continue
                v = v + 0.0  # -0.0 equals 0.0
                raw.append(v.astype(dtype).tobytes())
                keys.append(xxhash.xxh3_128_digest(f"{label}\0{len(v)}\0".encode() + v.tobytes()))
            yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "label": b["label"], "hash": keys, "dim": [None if r is None else len(r) // int(dtype[2]) for r in raw], "v": raw}).astype({"dim": "Int64"})

    return run


def pick_pivots(sample: np.ndarray, k: int, r: float) -> np.ndarray:
    """Up to k unit pivots: the sample vector with most others within r, then what is left likewise; each the mean direction of those around it."""
    near = sample @ sample.T >= math.cos(r)
    left, out = np.ones(len(sample), bool), []
    while left.any() and len(out) < k:
        at = int(np.argmax((near & left).sum(1) * left))
        around = near[at] & left
        around[at] = True
        out.append(sample[around].sum(0))
        left &= ~around
    return unit(np.array(out))


def memberships(u: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each unit vector, the cells that its ball of radius r can reach, and whether it lies within r/2 of its home's pivot."""
    cos = np.clip(u @ pivots.T, -1, 1)
    home = cos.argmax(1)
    own = cos[np.arange(len(u)), home]
    apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(-1), 0))
    crosses = own[:, None] - cos <= math.sin(r) * apart[home] + 1e-9
    triangle = np.arccos(cos) <= np.arccos(own)[:, None] + 2 * r + 1e-7
    reach = crosses & triangle
    reach[np.arange(len(u)), home] = True
    return home, reach, np.arccos(cos) <= r / 2 - 1e-7


def _pivots(r: float, dtype: str, cell_rows: int, most: int):
    """The pivots of a cell, and which share of its comparisons would remain after the cut (by its sample)."""

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        s = unit(_rows(sample["v"], dtype))
        p = pick_pivots(s, max(2, min(most, 2 * -(-int(sample["homes"].iloc[0]) // cell_rows))), r)
        home, reach, _ = memberships(s, p, r)
        left = (np.bincount(home, minlength=len(p)) * reach.sum(0)).sum() / len(s) ** 2
        return pd.DataFrame({"of": sample["cell"].iloc[:1], "slices": sample["slices"].iloc[:1], "pivots": [p.tobytes()], "left": left})

    return run


def _cut(r: float, dtype: str):
    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        columns = ["cell", "key", "w", "home", "core", "v"]
        if not len(rows):
            return pd.DataFrame(columns=columns)
        v = _rows(rows["v"], dtype)
        p = np.frombuffer(pivots["pivots"].iloc[0]).reshape(-1, v.shape[1])
        home, reach, core = memberships(unit(v), p, r)
        at, cell = np.nonzero(reach)
        d = rows.iloc[at]
        return pd.DataFrame({"cell": d["cell"].to_numpy() + np.array([f"/{c}" for c in cell], object), "key": d["key"].to_numpy(), "w": d["w"].to_numpy(), "home": d["home"].to_numpy() & (cell == home[at]), "core": core[at, cell], "v": d["v"].to_numpy()})[columns]

    return run


def _met(cosine: float, dtype: str):
    """A block pair: links of its home rows with its members, counted by weight, and the links that join components among them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = _rows(rows["v"], dtype)
        u, keys, w = unit(v), rows["key"].to_numpy(), rows["w"].to_numpy(np.int64)
        hs, ms = np.flatnonzero(rows["asks"]), np.flatnonzero(rows["answers"])
        number = {k: i for i, k in enumerate(dict.fromkeys(keys))}  # a vector may stand on both sides
        num = np.array([number[k] for k in keys])
        names = list(number)
        label = np.arange(len(names))
        counts, joins = np.zeros(len(names), np.int64), []
        for lo in range(0, len(hs), 512):
            part = hs[lo : lo + 512]
            cos = u[part] @ u[ms].T
            link = cos >= cosine
            for i, j in zip(*np.nonzero(np.abs(cos - cosine) < 1e-12), strict=True):
                link[i, j] = exact_cosine(v[part[i]], v[ms[j]]) >= cosine
            link &= num[part][:, None] != num[ms][None]
            counts[num[part]] += link @ w[ms]
            for i in np.flatnonzero(link.any(1)):
                me = num[part[i]]
                others = num[ms[link[i]]]
                groups, first = np.unique(label[others], return_index=True)
                new = groups != label[me]
                if new.any():
                    joins += [(names[me], names[x]) for x in others[first[new]]]
                    label[np.isin(label, groups[new])] = label[me]
        got = np.flatnonzero(counts)
        return pd.concat([pd.DataFrame({"key": [names[i] for i in got], "other": None, "n": counts[got]}), pd.DataFrame(joins, columns=["key", "other"]).assign(n=0)])

    return run


def range_join(classes: DataFrame, cosine: float, dtype: str, cell_rows: int, block: int, levels: int, sample: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """classes: (label, key, w, v). Two tables: (key, n), the weight of all classes linked with a class; (a, b), links that join components."""
    r = math.acos(cosine)
    cells = written(classes.select(F.concat_ws("\0", "label", "dim").alias("cell"), "key", "w", F.lit(True).alias("home"), F.lit(False).alias("core"), "v"), "vector-cells")
    ready = []
    for level in range(levels):
        full = cells.groupBy("cell").agg(F.count_if("home").alias("homes"), F.ceil(F.count("*") / block).alias("slices")).where(F.col("homes") > cell_rows)
        full = written(full, "full-cells")
        if full.isEmpty():
            break
        order = Window.partitionBy("cell").orderBy(F.xxhash64("key"), "key")
        drawn = cells.where("home").join(full, "cell").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample)
        chosen = drawn.groupBy("cell").applyInPandas(_pivots(r, dtype, cell_rows, pivots), "of string, slices bigint, pivots binary, left double")
        chosen = written(chosen.where(F.col("left") <= (0.5 if level else 1.0)), "pivots")
        busy = cells.join(chosen.select(F.col("of").alias("cell"), "slices"), "cell").withColumn("slice", F.pmod(F.xxhash64("key", F.lit(3)), F.col("slices")))
        parts = chosen.select("of", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("part"), "pivots")
        cut = busy.groupBy("cell", "slice").cogroup(parts.groupBy("of", "part")).applyInPandas(_cut(r, dtype), MEMBER)
        ready.append(cells.join(chosen.select(F.col("of").alias("cell")), "cell", "left_anti"))
        cells = written(cut, "vector-cells")
    for c in ready:
        cells = cells.unionByName(c)
    # Blocks: of a cell's members, core ones and others apart where they exceed one block. Core never meets core: all are linked.
    kind = lambda a, b: F.count_if(F.expr(a) & F.expr(b))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("all"), kind("home", "core").alias("hc"), kind("home", "not core").alias("hn"), kind("not home or home", "core").alias("mc"), kind("not home or home", "not core").alias("mn"), F.sum(F.when(F.col("core"), F.col("w"))).alias("core_w"), F.min(F.when(F.col("core"), F.col("key"))).alias("core_key"))
    sizes = written(sizes.where("hc + hn > 0 and all > 1"), "cell-sizes")
    d = cells.join(sizes, "cell")
    one = d.where(F.col("all") <= block).select("cell", F.lit("").alias("i"), F.lit("").alias("j"), "key", "w", "v", F.col("home").alias("asks"), F.lit(True).alias("answers"))
    many = d.where(F.col("all") > block)
    names = lambda p, n: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col(n) / block) - 1), lambda x: F.concat(F.lit(p), x.cast("string")))).otherwise(F.array().cast("array<string>"))
    mine = lambda c, n: F.concat(F.when(F.col("core"), "c").otherwise("n"), F.pmod(F.xxhash64("key", F.lit(5)), F.ceil(F.when(F.col("core"), F.col(c)).otherwise(F.col(n)) / block)).cast("string"))
    asks = many.where("home").withColumn("i", mine("hc", "hn")).withColumn("j", F.explode(F.when(F.col("core"), names("n", "mn")).otherwise(F.concat(names("c", "mc"), names("n", "mn")))))
    answers = many.withColumn("j", mine("mc", "mn")).withColumn("i", F.explode(F.when(F.col("core"), names("n", "hn")).otherwise(F.concat(names("c", "hc"), names("n", "hn")))))
    side = lambda x, asking: x.select("cell", "i", "j", "key", "w", "v", F.lit(asking).alias("asks"), F.lit(not asking).alias("answers"))
    met = one.unionByName(side(asks, True)).unionByName(side(answers, False)).groupBy("cell", "i", "j").applyInPandas(_met(cosine, dtype), "key binary, other binary, n bigint")
    sure = many.where("home and core and mc > 1").select("key", F.when(F.col("key") != F.col("core_key"), F.col("core_key")).alias("other"), (F.col("core_w") - F.col("w")).alias("n"))
    found = written(met.unionByName(sure), "vector-links")
    return found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 0"), found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, cell_rows: int = 1024, block: int = 4096, levels: int = 2, sample: int = 512, pivots: int = 16) -> DataFrame:
    """vec_id, n_links, component_id, kept, label, one row a vector. cell_rows: homes of a cell that is not cut; block: rows of a side that meet in one task."""
    dtype = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    d = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.col("label").cast("string").alias("label"))
    d = written(d.mapInPandas(_prepared(dtype), "vec_id bigint, label string, hash binary, dim bigint, v binary"), "vectors")
    classes = d.where("hash is not null").groupBy("label", "dim", "hash").agg(F.count("*").alias("w"), F.min("vec_id").alias("rep"), F.max("v").alias("v"))
    # A class is named by its smallest id, as eight bytes that sort like it, and its hash: the smallest name of a component tells its smallest id.
    sign = -(1 << 63)
    name = F.concat(F.unhex(F.lpad(F.hex(F.col("rep").bitwiseXOR(F.lit(sign))), 16, "0")), F.col("hash"))
    classes = written(classes.withColumn("key", name), "vector-classes")
    counts, edges = range_join(classes, cosine, dtype, cell_rows, block, levels, sample, pivots)
    comp = components(edges).withColumnRenamed("id", "key")
    of = classes.select("key", "hash", "w").join(comp, "key", "left").join(counts, "key", "left")
    head = F.conv(F.hex(F.substring(F.coalesce("component", "key"), 1, 8)), 16, 10).cast("decimal(20,0)")
    of = of.select("hash", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"), (head + F.lit(sign)).cast("bigint").alias("least"))
    out = d.select("vec_id", "label", "hash").join(of, "hash", "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), "label")
