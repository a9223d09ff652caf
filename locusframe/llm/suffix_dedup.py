"""Suffix dedup (operator 7): remove every byte covered by a 200-byte string that starts more than once in the corpus. Exact.

A full suffix array would ship 200 bytes for each byte of text, so suffixes without a possible partner are ruled out first:

0. Documents are packed once into blocks, a written table named by partition and ordinal, which all later steps read.
1. In every 200-byte string the rightmost minimum of its 48-byte hashes is its anchor, a function of its content. A text's
   strings so fall into territories, runs of starts with one anchor (about one in 77 bytes). Tasks send the hashes of anchors
   and of whole territories to shards. An anchor seen once: nothing there repeats. A territory seen twice: all of it repeats.
   Only the strings of anchors with different territories, the edges of repeated passages, stay open.
2. Those suffixes are range-partitioned by their leading 8 bytes with sampled splitters (equal splitters share a hot lead by
   fingerprint), each bucket sorts them by lead, then by the fingerprint of their 200 bytes (two-key sort), and compares
   neighbours. A key has one bucket, so no neighbours are parted by a bucket's boundary.
3. Answers return to the blocks of documents, where bytes are removed.

What travels is packed: one row per (block, shard), distinct within the block, so a passage that a third of all documents
share costs each block one entry. Equality is that of 64-bit hashes of two kinds (anchor and territory; lead and fingerprint).

Defined results: null or empty text has 0 bytes; texts under 200 bytes keep all; repeated rows repeat each other's strings, so
both lose them (and so do repeated files); null ids are kept; extra columns are ignored; long texts are used whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import mix, ragged, texts, written

PACKED = "block bigint, doc_ids array<bigint>, nulls binary, lengths array<bigint>, bytes binary"
ASKED = "block bigint, shard int, a binary, b binary, twice binary"
ANSWER = "block bigint, shard int, code binary"
ODD, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def _pack(limit: int):
    def run(batches):
        part, count = TaskContext.get().partitionId(), 0
        ids, raw, size = [], [], 0

        def row():
            null = np.array([x is None or x != x for x in ids], bool)
            keys = np.array([0 if n else int(i) for i, n in zip(ids, null, strict=True)], np.int64)
            return pd.DataFrame({"block": [part << 32 | count], "doc_ids": [keys], "nulls": [null.tobytes()], "lengths": [np.array([len(x) for x in raw], np.int64)], "bytes": [zstandard.compress(b"".join(raw))]})

        for b in batches:
            for i, t in zip(b["doc_id"].tolist(), b["text"], strict=True):
                ids.append(i)
                raw.append(t.encode("utf-8", "surrogatepass"))
                size += len(raw[-1])
                if size >= limit:
                    yield row()
                    count += 1
                    ids, raw, size = [], [], 0
        if ids:
            yield row()

    return run


class Block:
    """Rolling hashes and territories of one packed block."""

    def __init__(self, row, size: int, gram: int):
        self.size = size
        self.bytes = zstandard.decompress(row.bytes)
        self.raw = np.frombuffer(self.bytes, np.uint8)
        self.lengths = np.array(row.lengths, np.int64)
        n = len(self.raw)
        self.ends = np.cumsum(self.lengths)
        power = np.full(n + 1, ODD)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[self.raw] * power[:-1], out=self.sums[1:])
        del power
        self.back = np.full(n + 1, INVERSE)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        starts = ragged(self.ends - self.lengths, np.maximum(self.lengths - size + 1, 0))
        if not len(starts):
            self.lo = self.hi = self.anchor = self.whole = np.zeros(0, np.uint64)
            return
        width = size - gram + 1
        grams = self.hash(np.arange(n - gram + 1), gram)
        key = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
        pad = np.full(-len(key) % width, np.uint64(2**64 - 1))
        tiles = np.concatenate([key, pad]).reshape(-1, width)
        before = np.minimum.accumulate(tiles, 1).reshape(-1)
        after = np.minimum.accumulate(tiles[:, ::-1], 1)[:, ::-1].reshape(-1)
        least = np.minimum(after[starts], before[starts + width - 1])
        place = np.int64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], place[1:] != place[:-1]])
        first = np.flatnonzero(new)
        self.lo = starts[first]
        self.hi = starts[np.concatenate([first[1:], [len(starts)]]) - 1]
        at = place[first]
        self.anchor = grams[at]
        shape = ((at - self.lo) * 1000 + self.hi - self.lo).astype(np.uint64)
        self.whole = mix(self.hash(self.lo, self.hi - self.lo + size) + shape * ODD)

    def hash(self, at: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[at + length] - self.sums[at]) * self.back[at])

    def suffixes(self, which: np.ndarray) -> np.ndarray:
        """Starts of all strings in the given territories."""
        return ragged(self.lo[which], self.hi[which] - self.lo[which] + 1)

    def lead(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | self.raw[at + k].astype(np.uint64)
        return out


def _distinct(shard: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Distinct (shard, a, b) in that order, whether each occurs twice, and the place of every input in them."""
    order = np.lexsort((b, a, shard))
    s, x, y = shard[order], a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    number = np.cumsum(new) - 1
    inverse = np.empty(len(order), np.int64)
    inverse[order] = number
    first = np.flatnonzero(new)
    return s[first], x[first], y[first], np.diff(np.concatenate([first, [len(order)]])) > 1, inverse


def _asked(name: int, shard, a, b, twice) -> pd.DataFrame:
    """One row a shard that occurs (shard is sorted)."""
    present, cut = np.unique(shard, return_index=True)
    rows = [(name, int(s), a[p:q].tobytes(), b[p:q].tobytes(), twice[p:q].tobytes()) for s, p, q in zip(present, cut, np.append(cut, len(shard))[1:], strict=True)]
    return pd.DataFrame(rows, columns=["block", "shard", "a", "b", "twice"])


def _of_anchors(block: Block, shards: int):
    return _distinct((block.anchor % np.uint64(shards)).astype(np.int64), block.anchor, block.whole)


def _of_suffixes(block: Block, code: np.ndarray, splitters: np.ndarray, inner: int):
    """The open suffixes of a block: those of anchors with more than one territory; of equal territories the first asks for all.

    A range between splitters is dealt on over `inner` buckets by a hash of the leading bytes; a lead that fills ranges of its own, by its print.
    """
    at = block.suffixes(np.flatnonzero((code & 6) == 6))
    lead, print_ = block.lead(at), block.hash(at, block.size)
    lo, hi = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
    shard = lo + (print_ % (hi - lo + 1).astype(np.uint64)).astype(np.int64)
    if inner > 1:
        shard = shard * inner + (np.where(hi > lo, mix(print_), mix(lead)) % np.uint64(inner)).astype(np.int64)
    return at, _distinct(shard, lead, print_)


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: sort by (a, b) and compare neighbours. Code 1: (a, b) occurs twice; 2: a occurs with different b; 4: the first row of its (a, b)."""
    rows = rows.sort_values("block", ignore_index=True)
    a, b = (np.concatenate([np.frombuffer(x, np.uint64) for x in rows[c]]) for c in "ab")
    n = 1 + np.concatenate([np.frombuffer(x, np.uint8) for x in rows["twice"]]).astype(np.int64)
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new_a = np.concatenate([[True], x[1:] != x[:-1]])
    new = new_a.copy()
    new[1:] |= y[1:] != y[:-1]
    number, owner = np.cumsum(new) - 1, np.cumsum(new_a) - 1
    twice = np.bincount(number, n[order])[number] > 1
    mixed = np.bincount(owner, new)[owner] > 1
    code = np.empty(len(a), np.uint8)
    code[order] = twice + 2 * mixed.astype(np.uint8) + 4 * new.astype(np.uint8)
    ends = np.cumsum([len(c) for c in rows["twice"]])
    return pd.DataFrame({"block": rows["block"], "shard": rows["shard"], "code": [code[e - len(t) : e].tobytes() for e, t in zip(ends, rows["twice"], strict=True)]})


def _codes(answers: pd.DataFrame, n: int) -> np.ndarray:
    got = b"".join(answers.sort_values("shard")["code"])
    if len(got) != n:
        raise ValueError(f"{len(got)} answers to {n} questions")
    return np.frombuffer(got, np.uint8)


def _open(size: int, gram: int, shards: int, splitters: np.ndarray, inner: int):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in docs.itertuples():
            block = Block(row, size, gram)
            *_, inverse = _of_anchors(block, shards)
            code = _codes(answers, int(inverse.max(initial=-1)) + 1)[inverse]
            _, (shard, a, b, twice, _) = _of_suffixes(block, code, splitters, inner)
            out.append(_asked(row.block, shard, a, b, twice))
        return pd.concat(out) if out else pd.DataFrame(columns=["block", "shard", "a", "b", "twice"])

    return run


def _remove(size: int, gram: int, shards: int, splitters: np.ndarray, inner: int):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in docs.itertuples():
            block = Block(row, size, gram)
            *_, inverse = _of_anchors(block, shards)
            code = _codes(answers[answers["step"] == 1], int(inverse.max(initial=-1)) + 1)[inverse]
            at, (*_, back) = _of_suffixes(block, code, splitters, inner)
            repeated = at[(_codes(answers[answers["step"] == 2], int(back.max(initial=-1)) + 1)[back] & 1) > 0]
            edge = np.zeros(len(block.raw) + 1, np.int32)
            full = np.flatnonzero(code & 1)
            np.add.at(edge, block.lo[full].astype(np.int64), 1)
            np.add.at(edge, block.hi[full].astype(np.int64) + size, -1)
            np.add.at(edge, repeated, 1)
            np.add.at(edge, repeated + size, -1)
            gone = np.cumsum(edge[:-1]) > 0
            first = block.ends - block.lengths
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            starts = first[(block.lengths > 0)]
            begins[starts] = gone[starts]
            total = lambda x: np.concatenate([[0], np.cumsum(x)])
            removed, spans = (t[block.ends] - t[first] for t in (total(gone), total(begins)))
            data = block.bytes
            sha = [hashlib.sha256(data[p:q] if not r else block.raw[p:q][~gone[p:q]].tobytes()).hexdigest() for p, q, r in zip(first, block.ends, removed, strict=True)]
            ids = pd.array(np.array(row.doc_ids, np.int64), "Int64")
            ids[np.frombuffer(row.nulls, bool)] = pd.NA
            out.append(pd.DataFrame({"doc_id": ids, "n_bytes": block.lengths, "n_removed": removed, "n_spans": spans, "kept_sha256": sha}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, size: int = 200, gram: int = 48, block_bytes: int = 2_500_000, shard_chars: int = 16_000_000, samples: int = 64, ranges: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. gram: at most size; block_bytes and shard_chars bound what a task holds."""
    packed = written(texts(docs).mapInPandas(_pack(block_bytes), PACKED), "dedup-blocks", "uncompressed")  # the bytes are compressed as they are, so that shuffles carry them so
    size_of = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    shards = max(1, -(-(packed.agg(F.sum(size_of)).first()[0] or 0) // shard_chars))

    def ask(batches):
        for b in batches:
            for row in b.itertuples():
                shard, x, y, twice, _ = _of_anchors(Block(row, size, gram), shards)
                yield _asked(row.block, shard, x, y, twice)

    first = written(packed.mapInPandas(ask, ASKED).groupBy("shard").applyInPandas(_answer, ANSWER), "anchor-answers", "lz4")

    def leads(batches):
        """A sample of each block's leading bytes, at evenly spaced places, as signed integers in the same order."""
        for b in batches:
            for row in b.itertuples():
                raw = np.frombuffer(zstandard.decompress(row.bytes), np.uint8)
                if len(raw) >= 8:
                    at = np.linspace(0, len(raw) - 8, samples).astype(np.int64)
                    x = np.zeros(samples, np.uint64)
                    for k in range(8):
                        x = (x << np.uint64(8)) | raw[at + k].astype(np.uint64)
                    yield pd.DataFrame({"lead": (x ^ np.uint64(1 << 63)).view(np.int64)})

    # At most `ranges` of them, so neither the aggregate nor what tasks carry grows with the corpus; larger ranges are dealt on inside.
    inner = -(-shards // ranges)
    wide = -(-shards // inner)
    cuts = [(i + 1) / wide for i in range(wide - 1)]
    found = packed.mapInPandas(leads, "lead bigint").agg(F.percentile_approx("lead", cuts, 4 * ranges)).first()[0] if cuts else []
    splitters = np.array([x & 0xFFFFFFFFFFFFFFFF for x in found or []], np.uint64) ^ np.uint64(1 << 63)
    by_block = packed.groupBy("block")
    asked = by_block.cogroup(first.groupBy("block")).applyInPandas(_open(size, gram, shards, splitters, inner), ASKED)
    second = written(asked.groupBy("shard").applyInPandas(_answer, ANSWER), "suffix-answers", "lz4")
    both = first.withColumn("step", F.lit(1)).union(second.withColumn("step", F.lit(2)))
    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return packed.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(_remove(size, gram, shards, splitters, inner), out)
