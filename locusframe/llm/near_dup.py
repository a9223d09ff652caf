"""MinHash near-duplicates (operator 2): one-permutation hashing, banded buckets, star-shaped candidate edges.

1. Every text becomes its set of 64-bit shingle hashes, a fingerprint of the set, and a signature: one permutation cut into
   `bins` equal ranges, the minimum of each range, empty ranges filled by optimal densification (a range looks up, by a fixed
   sequence of its own, the first range that is not empty).
2. Equal sets collapse to one class, named by the set's 128-bit fingerprint, by a partial aggregate, so groups of exact copies
   cost one row.
3. Signatures are cut into bands; equal bands are buckets. A bucket links its members to one centre only: the member that
   shares most buckets corpus-wide, which in a group of edited copies is the common original. All bands so agree on centres.
4. Star edges are confirmed on full shingle sets, in chunks bounded in shingles and in rows (a hot centre is spread over many).
   The sets are written where they are met, by star and chunk, so no later step sends all of them again.
5. What a star may miss, a member that fails against the centre yet is near another member, is settled exactly: the failed
   members of a star are compared on full sets with its members, chunk against chunk; no pairs are emitted, only the links that join
   components. A star of one chunk is settled where it is confirmed. Members of a larger star lie in chunks by their similarity to the centre: 1 - similarity is a metric, so two members
   can only be near if their similarities to the centre differ by no more than 1 - the bound, and other chunk pairs are left out. A
   chunk with failed members first meets itself and the chunk with most confirmed members that it can be near; who has joined the
   centre there needs no more, and only the rest meets all other chunks. So every pair that shares a bucket is decided; no bucket is capped.
6. Components by min-label propagation over the class representatives.

With 32 bands of 4 rows a pair at similarity 0.85 shares no bucket with probability 6e-11 (0.8: 5e-8).

Defined results: null or empty text, or text without words, has the empty set and no links; a text with fewer than n words is
one shingle; repeated rows (same id or not) are copies; an id with several texts has a row for each, each text linked on its own
and kept if the id is its component's smallest; null ids keep their row, never link; extra columns are ignored; very long texts are used
whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import HashedWords, hands_back, hashed, mix, texts, written
from locusframe.llm.components import components

SIGNED = "doc_id bigint, text_hash bigint, n_shingles bigint, fp binary, bands array<bigint>"


def shingles_of(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    if not len(h):
        return np.zeros(0, np.uint64)
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64) + np.uint64(k if k < n else 0)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


def probes(bins: int) -> np.ndarray:
    """For each bin the order in which it looks at the bins when it is empty (densification): fixed, the same for all texts."""
    i, k = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(1, 2 * bins + 1, dtype=np.uint64), indexing="ij")
    return (mix(i * np.uint64(0x100000001B3) + k) % np.uint64(bins)).astype(np.int64)


def signature(shingles: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """One-permutation signature of a sorted, non-empty array of hashes: range = high bits, so its first hash is its minimum."""
    where = (shingles >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    full, first = np.unique(where, return_index=True)
    sig = np.zeros(bins, np.uint64)
    has = np.zeros(bins, bool)
    sig[full], has[full] = shingles[first], True
    if len(full) < bins:
        empty = np.flatnonzero(~has)
        got = has[order[empty]]
        pick = order[empty, got.argmax(1)]
        pick[~got.any(1)] = full[0]  # a handful of shingles that no probe hit
        sig[empty] = sig[pick]
    return sig


def signed(docs: DataFrame, n: int, bins: int, rows: int) -> DataFrame:
    @hands_back
    def run(batches):
        order, words = probes(bins), HashedWords()
        salt = mix(np.arange(1, bins // rows + 1, dtype=np.uint64))
        for b in batches:
            out = []
            for doc, t, h in zip(b["doc_id"], b["text_hash"], words.batch(b["text"]), strict=True):
                s = shingles_of(h, n)
                if not len(s):
                    out.append((doc, t, 0, b"", []))
                    continue
                sig = signature(s, bins, order).reshape(-1, rows)
                key = salt.copy()
                for k in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
                out.append((doc, t, len(s), xxhash.xxh3_128_digest(s.tobytes()), key.view(np.int64)))
            frame = pd.DataFrame(out, columns=["doc_id", "text_hash", "n_shingles", "fp", "bands"])
            yield frame.astype({"doc_id": "Int64"})

    return hashed(docs).mapInPandas(run, SIGNED)


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    @hands_back
    def run(batches):
        words = HashedWords()
        for b in batches:
            sets = [shingles_of(h, n).tobytes() for h in words.batch(b["text"])]
            yield pd.DataFrame({"x": [xxhash.xxh3_128_digest(s) for s in sets], "s": sets})

    return docs.mapInPandas(run, "x binary, s binary")


def _similar(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def _confirm(percent: int):
    """One chunk of a star: its members against the centre's full set. Where it is the whole star, its failed members are settled here too: joined is what such a member is linked to."""
    settle = _settle(percent)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        members, centre = rows[~rows["centre"]], rows[rows["centre"]]
        out = members[["c", "x", "n", "k"]].assign(ok=False, sim=0.0, joined=None)
        if not len(members) or not len(centre):
            return out[:0]
        c = np.frombuffer(centre["s"].iloc[0], np.uint64)
        ok, sim = [], []
        for raw in members["s"]:
            x = np.frombuffer(raw, np.uint64)
            at = np.searchsorted(c, x)
            inter = int((c[np.minimum(at, len(c) - 1)] == x).sum())
            ok.append(_similar(inter, len(c), len(x), percent))
            sim.append(inter / (len(c) + len(x) - inter))
        out = out.assign(ok=ok, sim=sim)
        if out["k"].iloc[0] == 1 and len(out) > 1 and not all(ok):
            found = settle(members[["c", "x", "s"]].assign(ok=ok, i=0, j=0, side=0))
            to = {bytes(x): t for x, t in zip(found["a"], found["b"], strict=True)}
            out = out.assign(joined=[to.get(bytes(x)) for x in out["x"]])
        return out

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Intersection sizes of all sets of a with all of b, by dense products over slices of their common shingles."""
    fa, fb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(fa, fb)
    out = np.zeros((len(a), len(b)), np.float32)
    ra, rb = (np.repeat(np.arange(len(z)), [len(x) for x in z]) for z in (a, b))
    pa, pb = (np.searchsorted(common, z) for z in (fa, fb))
    for lo in range(0, len(common), width):
        part = common[lo : lo + width]
        ms = []
        for f, r, p, k in ((fa, ra, pa, len(a)), (fb, rb, pb, len(b))):
            keep = (p >= lo) & (p < lo + len(part))
            keep[keep] = part[p[keep] - lo] == f[keep]
            m = np.zeros((k, len(part)), np.float32)
            m[r[keep], p[keep] - lo] = 1
            ms.append(m)
        out += ms[0] @ ms[1].T
    return out.astype(np.int64)


def _settle(percent: int):
    """Two chunks of one star: failed members of either against all members of the other; each that found its component, with the centre if that is in it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in rows["s"]]
        ids, ok, side = rows["x"].to_numpy(), rows["ok"].to_numpy(), rows["side"].to_numpy()
        c = bytes(rows["c"].iloc[0])
        root = {bytes(x): c if o else bytes(x) for x, o in zip(ids, ok, strict=True)}
        parent = {v: v for v in (c, *root.values())}

        def top(v):
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for left, right in ((0, 0),) if int(rows["i"].iloc[0]) == int(rows["j"].iloc[0]) else ((0, 1), (1, 0)):
            fs, ms = np.flatnonzero((side == left) & ~ok), np.flatnonzero(side == right)
            if not len(fs) or not len(ms):
                continue
            inter = overlaps([sets[k] for k in fs], [sets[k] for k in ms])
            size = lambda z: np.array([len(sets[k]) for k in z], np.int64)
            for p, q in zip(*np.nonzero(_similar(inter, size(fs)[:, None], size(ms)[None, :], percent)), strict=True):
                parent[top(root[bytes(ids[fs[p]])])] = top(root[bytes(ids[ms[q]])])
        found = ((v, c if top(v) == top(c) else top(v)) for v, r in root.items() if v == r)
        return pd.DataFrame([(c, v, t) for v, t in found if v != t], columns=["c", "a", "b"])

    return run


def _settled(checked: DataFrame, sets: DataFrame, percent: int, chunk: int, chunk_rows: int, levels: int) -> list[DataFrame]:
    """Links (a, b) of the members that failed against the centres of stars of several chunks: tables whose union joins all they are near to."""
    open_ = checked.groupBy("c").agg(F.count_if(~F.col("ok")).alias("bad")).where("bad > 0").select("c")
    state = checked.join(open_, "c").withColumn("level", F.floor(F.col("sim") * levels).cast("bigint"))
    slices = state.groupBy("c", "level").agg(F.greatest(F.ceil(F.sum("n") / chunk), F.ceil(F.count("*") / chunk_rows)).alias("slices"))
    at = F.shiftleft("level", 40) + F.pmod(F.xxhash64("x"), F.col("slices"))  # chunks sort by level
    state = written(state.join(slices, ["c", "level"]).select("c", "x", "ok", "level", at.alias("i")), "open-stars")

    def pairs(state: DataFrame) -> DataFrame:
        """Chunk pairs (p <= q) that may hold a link of a failed member, and whether they come first."""
        per = state.groupBy("c", "i", "level").agg(F.count_if(~F.col("ok")).alias("bad"), F.count_if("ok").alias("good"))
        asks = per.where("bad > 0").select("c", F.col("i").alias("f"), F.col("level").alias("fl"))
        met = asks.join(per, "c").where(F.abs(F.col("fl") - F.col("level")) - 1 <= -(-levels * (100 - percent) // 100))
        best = met.groupBy("c", "f").agg(F.max_by("i", F.struct("good", "i")).alias("best"))
        met = met.join(best, ["c", "f"]).select("c", F.least("f", "i").alias("p"), F.greatest("f", "i").alias("q"), ((F.col("f") == F.col("i")) | (F.col("i") == F.col("best"))).alias("early"))
        return met.groupBy("c", "p", "q").agg(F.max("early").alias("early"))

    def compared(state: DataFrame, sides: DataFrame) -> DataFrame:
        ends = sides.select("c", F.col("p").alias("i"), F.col("p").alias("lo"), F.col("q").alias("hi"), F.lit(0).alias("side")).union(
            sides.where("p < q").select("c", F.col("q").alias("i"), F.col("p").alias("lo"), F.col("q").alias("hi"), F.lit(1).alias("side")))
        # Sets come last: they are sent to their stars' members once, and then to the chunk pairs.
        asks = state.join(ends, ["c", "i"]).select("c", F.col("lo").alias("i"), F.col("hi").alias("j"), "side", "x", "ok")
        placed = asks.join(sets, ["c", "x"])
        return written(placed.groupBy("c", "i", "j").applyInPandas(_settle(percent), "c binary, a binary, b binary"), "settled")

    every = written(pairs(state), "chunk-pairs")
    first = compared(state, every.where("early"))
    joined = first.where("b = c").select("c", F.col("a").alias("x"), F.lit(True).alias("joined")).distinct()
    state = state.join(joined, ["c", "x"], "left").withColumn("ok", F.col("ok") | F.coalesce("joined", F.lit(False))).drop("joined")
    left = state.where("not ok").select("c", "i").distinct()
    rest = every.where("not early")
    rest = rest.join(left.withColumnRenamed("i", "p"), ["c", "p"], "left_semi").union(rest.join(left.withColumnRenamed("i", "q"), ["c", "q"], "left_semi").select("c", "p", "q", "early")).distinct()
    return [first.select("a", "b"), compared(state, rest).select("a", "b")]


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bins: int = 128, rows: int = 4, chunk: int = 400_000, chunk_rows: int = 400, levels: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, component (its name, null without words). chunk, chunk_rows: shingles and rows that a task compares at a time; levels: steps of similarity to the centre that part a large star."""
    sig = written(signed(docs, n, bins, rows), "signatures")
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = written(classes, "classes")
    entries = classes.select(F.col("fp").alias("x"), F.explode("bands").alias("band"))
    full = entries.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    entries = written(entries.join(full, "band"), "buckets")
    weight = entries.groupBy("x").agg(F.sum(F.log2("size")).alias("weight"))
    ranked = entries.join(weight, "x")
    centre = ranked.groupBy("band").agg(F.max_by("x", F.struct("weight", "x")).alias("c"))
    stars = entries.join(centre, "band").where("x <> c").select("c", "x").distinct()
    stars = written(stars.join(classes.select(F.col("fp").alias("x"), "n"), "x"), "stars")
    chunks = stars.groupBy("c").agg(F.greatest(F.ceil(F.sum("n") / chunk), F.ceil(F.count("*") / chunk_rows)).cast("int").alias("k"))
    stars = stars.join(chunks, "c").withColumn("i", F.pmod(F.xxhash64("x"), F.col("k")).cast("int"))
    ids = stars.select(F.col("x").alias("fp")).union(stars.select("c")).distinct()
    # One document a class brings its text; where an id has several texts, their fingerprints tell them apart.
    # Their ids are written, so that the size of the table is known before texts are sent: while it is small, texts stay where they are.
    asked = written(classes.join(ids, "fp").select(F.col("rep").alias("doc_id")).distinct(), "asked")
    needed = texts(docs).join(asked, "doc_id", "left_semi")
    # A set goes to its stars where copies of it are dropped: as a member to its chunk, as a centre to each of its star's chunks.
    members = stars.select("c", "x", "n", "k", "i", F.lit(False).alias("centre"))
    centres = chunks.select("c", F.col("c").alias("x"), F.lit(0).cast("bigint").alias("n"), "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), F.lit(True).alias("centre"))
    placed = written(sets_of(needed, n).dropDuplicates(["x"]).join(members.union(centres), "x"), "star-sets", "lz4")
    checked = placed.groupBy("c", "i").applyInPandas(_confirm(percent), "c binary, x binary, n bigint, k int, ok boolean, sim double, joined binary")
    checked = written(checked, "star-checks")
    edges = checked.where("ok").select(F.col("c").alias("a"), F.col("x").alias("b"))
    edges = edges.union(checked.where("joined is not null").select(F.col("x").alias("a"), F.col("joined").alias("b")))
    for more in _settled(checked.where("k > 1"), placed.where("k > 1 and not centre").select("c", "x", "s"), percent, chunk, chunk_rows, levels):
        edges = edges.union(more)
    comp = components(edges).withColumnRenamed("id", "fp")
    of = classes.select("fp", "rep").join(comp, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    of = of.join(of.groupBy("root").agg(F.min("rep").alias("component")), "root").select("fp", "root", "component")
    out = sig.drop("bands").join(of, "fp", "left")
    own = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "text_hash", F.hex("root").alias("component"))
