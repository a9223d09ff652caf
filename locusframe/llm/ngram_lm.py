"""LM scoring with an Elias-Fano n-gram trie (operator 1).

The trie is cut into shards by a hash of the context word, so neither building nor querying it ever needs it in one place:

1. Documents are read once, into blocks of about `block_words` words: words become 64-bit hashes and places in the block's
   vocabulary. The blocks are a written table, named by partition and ordinal, so every later step reads the same blocks.
2. A block sends its distinct bigrams, grouped by context, one row a shard: contexts, successor counts, successors in 40 bits,
   counts in the learning documents. A hot context (its occurrences exceed `hot`) is split by its successors over many shards.
3. A shard adds up the counts of all blocks and lays out its part of the trie in one memory map: sorted contexts, pointers to
   their successors, cumulative uses, a dictionary and context-relative successors, all monotone Elias-Fano sequences, and
   8-bit quantised smoothed probabilities. Each distinct question is answered there, by successor search between its context's
   pointers on the packed levels; a block gets back one byte a bigram, and uses and types (distinct successors) a context.
4. Blocks and answers meet by block; documents are scored there, the parts of a hot context weighted by their uses and types.

Model: interpolated Witten-Bell over add-half unigrams, p(w|v) = (c(vw) + T(v) p(w)) / (c(v) + T(v)), where T counts distinct
successors; p(w) is the base's probability, so unseen words and contexts have mass. The trie stores c(vw)/(c(v)+T(v)) in 255
steps between 1 and the least value that the text's size allows, finer near 1; a code stands for the mean of what fell on it
in the whole corpus (256 sums), so one grid serves all shards and only codes travel. Nothing is pruned; shards grow in number with the text. Successors of
one context are told apart by 40 bits: of a million, one pair in two contexts is expected to merge.

Rows sent are blocks times shards, and never more than distinct bigrams. Defined results: null text counts as empty (one end
token); repeated rows and repeated files each count in training and are each scored; null ids are held in (their crc is null)
and scored; extra columns are ignored; an empty table gives an empty result; long texts whole.
"""

from __future__ import annotations

import mmap

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import HashedWords, crc_mod, mix, texts, written

START, END = np.uint64(0x5374617274), np.uint64(0x456E64)
MASK40 = np.uint64((1 << 40) - 1)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Place of the r-th set bit of a byte.
SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _on = [k for k in range(8) if _b >> k & 1]
    SELECT[_b, : len(_on)] = _on


class EliasFano:
    """A monotone sequence of 64-bit integers: low bits packed in bytes, high bits in unary with a count of ones before each byte."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, width: int):
        self.low, self.high, self.n, self.width = low, high, n, width
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])

    @staticmethod
    def parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = 0
        while n and (top >> (8 * width)) > 4 * n and width < 7:
            width += 1  # whole bytes of low bits
        low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].copy() if n else np.zeros((0, width), np.uint8)
        where = (values >> np.uint64(8 * width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(where[-1]) if n else 0) + 1, np.uint8)
        bits[where] = n > 0
        return low.reshape(-1), np.packbits(bits, bitorder="little"), width

    def get(self, k: np.ndarray) -> np.ndarray:
        byte = np.searchsorted(self.rank, k, side="right") - 1
        where = 8 * byte + SELECT[self.high[byte], k - self.rank[byte]]
        out = (where - k).astype(np.uint64) << np.uint64(8 * self.width)
        at = k * self.width
        for b in range(self.width):
            out |= self.low[at + b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """First place in [lo, hi) whose value is at least x (hi if none), for many queries at once, `step` at a time."""
        out = np.empty(len(x), np.int64)
        for a in range(0, len(x), step):
            q, left, right = x[a : a + step], lo[a : a + step].copy(), hi[a : a + step].copy()
            while len(todo := np.flatnonzero(left < right)):
                mid = (left[todo] + right[todo]) >> 1
                less = self.get(mid) < q[todo]
                left[todo] = np.where(less, mid + 1, left[todo])
                right[todo] = np.where(less, right[todo], mid)
            out[a : a + step] = left
        return out


def grid(least: float, weights: np.ndarray | None = None, logs: np.ndarray | None = None) -> np.ndarray:
    """The 256 values of a code: 0 is absent, 1..255 fall from 1 to `least`, in ratios that grow evenly from step to step.

    Given the weight and summed logarithm of what fell on each code, a code stands for its geometric mean.
    """
    middle = np.log(least) * ((np.arange(255) + 0.5) / 255) ** 2
    if weights is not None:
        middle = np.where(weights[1:] > 0, logs[1:] / np.maximum(weights[1:], 1), middle)
    return np.concatenate([[0.0], np.exp(middle)])


def quantised(p: np.ndarray, least: float) -> np.ndarray:
    return (1 + np.clip(np.sqrt(np.log(p) / np.log(least)) * 255, 0, 254)).astype(np.uint8)


class Trie:
    """Two levels in one memory map: contexts -> pointers -> context-relative successors -> codes."""

    def __init__(self, contexts: np.ndarray, types: np.ndarray, uses: np.ndarray, successors: np.ndarray, codes: np.ndarray):
        """contexts: sorted, with their numbers of successors and of uses; successors: sorted within a context, below 2**40; codes: theirs."""
        words, relative = np.unique(successors, return_inverse=True)
        owner = np.repeat(np.arange(len(contexts), dtype=np.uint64), types)
        self.base = max(1, len(words))
        sums = lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.uint64)
        levels = (contexts, sums(types), sums(uses), words, owner * np.uint64(self.base) + relative.astype(np.uint64))
        parts = [EliasFano.parts(x) for x in levels]
        blobs = [x for low, high, _ in parts for x in (low, high)] + [codes]
        self.buffer = mmap.mmap(-1, max(1, sum(len(x) for x in blobs)))
        views, at = [], 0
        for x in blobs:
            self.buffer[at : at + len(x)] = x.tobytes()
            views.append(np.frombuffer(self.buffer, np.uint8, len(x), at))
            at += len(x)
        self.contexts, self.pointers, self.uses, self.dictionary, self.successors = (
            EliasFano(views[2 * i], views[2 * i + 1], len(x), p[2]) for i, (x, p) in enumerate(zip(levels, parts, strict=True)))
        self.codes = views[-1]

    def context(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each context, -1 if absent."""
        return self._find(self.contexts, hashes)

    def statistics(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Uses and types of each context number; 0 of -1."""
        out = [np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)]
        ask = np.flatnonzero(context >= 0)
        for x, level in zip(out, (self.uses, self.pointers), strict=True):
            x[ask] = (level.get(context[ask] + 1) - level.get(context[ask])).astype(np.int64)
        return out[0], out[1]

    @staticmethod
    def _find(level: EliasFano, x: np.ndarray) -> np.ndarray:
        if not level.n:
            return np.full(len(x), -1)
        at = level.successor(x, np.zeros(len(x), np.int64), np.full(len(x), level.n))
        hit = level.get(np.minimum(at, level.n - 1)) == x
        return np.where(hit & (at < level.n), at, -1)

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Code of each (context number, successor), 0 if absent."""
        words, back = np.unique(successor, return_inverse=True)
        word = self._find(self.dictionary, words)[back]
        ask = np.flatnonzero((context >= 0) & (word >= 0))
        out = np.zeros(len(context), np.uint8)
        if len(ask):
            c = context[ask]
            lo, hi = self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64)
            x = c.astype(np.uint64) * np.uint64(self.base) + word[ask].astype(np.uint64)
            at = self.successors.successor(x, lo, hi)
            ok = np.flatnonzero(at < hi)
            ok = ok[self.successors.get(at[ok]) == x[ok]]
            out[ask[ok]] = self.codes[at[ok]]
        return out


BLOCK = "block bigint, doc_ids array<bigint>, nulls binary, train binary, lengths array<bigint>, vocabulary binary, words binary"


def _encode(limit: int):
    """Runs of a partition's documents as blocks: the block's vocabulary (with the end token) and every token's place in it."""

    def run(batches):
        part, words, count = TaskContext.get().partitionId(), HashedWords(), 0
        ids, train, rows, size = [], [], [], 0

        def block():
            lengths = np.array([len(x) + 1 for x in rows], np.int64)
            ends = np.cumsum(lengths)
            token = np.empty(ends[-1], np.uint64)
            token[ends - 1] = END
            inner = np.ones(len(token), bool)
            inner[ends - 1] = False
            token[inner] = np.concatenate(rows)
            vocabulary, place = np.unique(token, return_inverse=True)
            return pd.DataFrame({
                "block": [part << 32 | count], "doc_ids": [pd.array(ids, "Int64").to_numpy(np.int64, na_value=0)], "nulls": [np.array([x is None or x != x for x in ids], bool).tobytes()],
                "train": [np.array(train, bool).tobytes()], "lengths": [lengths], "vocabulary": [vocabulary.tobytes()], "words": [place.astype(np.int32).tobytes()]})

        for b in batches:
            for k in range(0, len(b), 500):
                some = b.iloc[k : k + 500]
                ids += some["doc_id"].tolist()
                train += some["train"].tolist()
                rows += words.batch(some["text"])
                size += sum(len(x) for x in rows[-len(some) :])
                if size >= limit:
                    yield block()
                    count += 1
                    ids, train, rows, size = [], [], [], 0
        if ids:
            yield block()

    return run


class Bigrams:
    """A block's tokens and distinct bigrams; segments are the (context, part) groups of bigrams in wire order: by shard and context."""

    def __init__(self, row, shards: int, hot: tuple[np.ndarray, np.ndarray]):
        vocabulary = np.frombuffer(row.vocabulary, np.uint64)
        self.words = np.frombuffer(row.words, np.int32)
        self.lengths = np.array(row.lengths, np.int64)
        self.train = np.frombuffer(row.train, bool)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.names = np.concatenate([vocabulary, [START]])
        self.end = int(np.searchsorted(vocabulary, END))
        self.context = np.empty(len(self.words), np.int32)
        self.context[1:] = self.words[:-1]
        self.context[self.first] = len(vocabulary)
        short, rank = np.unique(vocabulary & MASK40, return_inverse=True)
        pair, token_pair = np.unique(self.context.astype(np.int64) * len(short) + rank[self.words], return_inverse=True)
        owner, successor = pair // len(short), short[pair % len(short)]
        # Hot contexts are split by successor; a block asks all parts of those that it holds, for their uses.
        parts = np.ones(len(self.names), np.int64)
        if len(hot[0]):
            at = np.minimum(np.searchsorted(hot[0], self.names), len(hot[0]) - 1)
            parts = np.where(hot[0][at] == self.names, hot[1][at], 1)
        most = int(parts.max())
        part = (mix(successor) % parts[owner].astype(np.uint64)).astype(np.int64)
        split = np.flatnonzero(parts > 1)
        every = np.concatenate([np.repeat(split, parts[split]) * most + np.concatenate([np.arange(parts[s]) for s in split])]) if len(split) else np.zeros(0, np.int64)
        segment, of = np.unique(np.concatenate([owner * most + part, every]), return_inverse=True)
        seg_context, seg_part = segment // most, (segment % most).astype(np.uint64)
        shard = (mix(self.names[seg_context] + seg_part * ODD) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((segment, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        mine = place[of[: len(pair)]]
        by = np.argsort(mine, kind="stable")
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        self.seg_context, self.seg_shard = seg_context[order], shard[order]
        self.seg_name = (self.names[seg_context] + seg_part * ODD)[order]  # of part 0: the context's own
        self.seg_size = np.bincount(mine, minlength=len(order))
        self.pair_segment, self.successor, self.token_pair = mine[by], successor[by], back[token_pair]

    def counts(self) -> np.ndarray:
        """How often the learning documents hold each bigram."""
        return np.bincount(self.token_pair[np.repeat(self.train, self.lengths)], minlength=len(self.successor))


ASKED = "block bigint, shard int, contexts binary, sizes binary, size_width int, successors binary, counts binary, count_width int"
ANSWER = "block bigint, shard int, tokens bigint, types bigint, hot array<bigint>, weights array<double>, logs array<double>, uses binary, use_width int, kinds binary, kind_width int, codes binary"


def _small(x: np.ndarray) -> tuple[bytes, int]:
    top = x.max(initial=0)
    kind = np.uint8 if top < 1 << 8 else np.uint32 if top < 1 << 32 else np.int64
    return x.astype(kind).tobytes(), kind().itemsize


def _read(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 4: np.uint32, 8: np.int64}[width]).astype(np.int64)


def _ask(shards: int, hot):
    def run(batches):
        for b in batches:
            for row in b.itertuples():
                g = Bigrams(row, shards, hot)
                count = g.counts()
                five = g.successor.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                present, cut = np.unique(g.seg_shard, return_index=True)  # only shards that the block has a question for
                cut = np.append(cut, len(g.seg_shard))
                pairs = np.concatenate([[0], np.cumsum(g.seg_size)])[cut]
                out = []
                for k, s in enumerate(present):
                    (p, q), (u, v) = cut[k : k + 2], pairs[k : k + 2]
                    out.append((row.block, s, g.seg_name[p:q].tobytes(), *_small(g.seg_size[p:q]), five[u:v].tobytes(), *_small(count[u:v])))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in ASKED.split(", ")])

    return run


def _answer(least: float, hot: tuple[np.ndarray, np.ndarray]):
    """All blocks' questions to one shard: build its part of the trie, look every distinct question up."""
    owners = np.repeat(hot[0], hot[1])
    hot_names = owners + (np.arange(len(owners)) - np.repeat(np.cumsum(hot[1]) - hot[1], hot[1])).astype(np.uint64) * ODD

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        segment, own, suc, cnt, n_seg, n_suc = [], [], [], [], [], []
        for r in rows.itertuples():
            h = np.frombuffer(r.contexts, np.uint64)
            segment.append(h)
            own.append(np.repeat(h, _read(r.sizes, r.size_width)))
            raw = np.zeros((len(r.successors) // 5, 8), np.uint8)
            raw[:, :5] = np.frombuffer(r.successors, np.uint8).reshape(-1, 5)
            suc.append(raw.view("<u8").reshape(-1))
            cnt.append(_read(r.counts, r.count_width))
            n_seg.append(len(h))
            n_suc.append(len(raw))
        segment, own, suc, cnt = (np.concatenate(x) for x in (segment, own, suc, cnt))
        every = np.unique(segment)
        pair, asked = np.unique((np.searchsorted(every, own).astype(np.uint64) << np.uint64(40)) | suc, return_inverse=True)
        del own, suc
        count = np.bincount(asked, cnt, len(pair)).astype(np.int64)
        owner = (pair >> np.uint64(40)).astype(np.int64)
        uses, types = np.bincount(owner, count, len(every)).astype(np.int64), np.bincount(owner, count > 0, len(every)).astype(np.int64)
        live, learnt = np.flatnonzero(types), np.flatnonzero(count)
        seen = count[learnt] / (uses + types)[owner[learnt]]
        codes = quantised(seen, least)
        trie = Trie(every[live], types[live], uses[live], pair[learnt] & MASK40, codes)
        number = trie.context(every)
        code = trie.find(number[owner], pair & MASK40)[asked]
        use, kind = (x[np.searchsorted(every, segment)] for x in trie.statistics(number))
        used = every[uses > 0]
        split = owners[np.isin(hot_names, used)]
        totals = (int(uses.sum()), int((~np.isin(used, hot_names) & (used != START)).sum()), np.unique(split[split != START]).view(np.int64),
                  np.bincount(codes, count[learnt], 256), np.bincount(codes, count[learnt] * np.log(seen), 256))
        out = []
        a = b = 0
        for k, r in enumerate(rows.itertuples()):
            u, v = a + n_seg[k], b + n_suc[k]
            out.append((r.block, r.shard, *(totals if k == 0 else (0, 0, [], None, None)), *_small(use[a:u]), *_small(kind[a:u]), code[b:v].tobytes()))
            a, b = u, v
        return pd.DataFrame(out, columns=[x.split()[0] for x in ANSWER.split(", ")])

    return run


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(n: int, v: int, centres: np.ndarray, shards: int, hot):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("shard")
        out = []
        for row in docs.itertuples():
            g = Bigrams(row, shards, hot)
            uses, types = (np.concatenate([_read(getattr(r, c), getattr(r, w)) for r in answers.itertuples()]) for c, w in (("uses", "use_width"), ("kinds", "kind_width")))
            codes = np.frombuffer(b"".join(answers["codes"]), np.uint8)
            if len(uses) != len(g.seg_context) or len(codes) != len(g.successor):
                raise ValueError(f"block {row.block}: {len(codes)} answers to {len(g.successor)} questions")
            use, kind = (np.bincount(g.seg_context, x, len(g.names)) for x in (uses, types))
            total = use.copy()
            total[g.end] = use[-1]  # every learning document has one start and one end
            base = (total + 0.5) / (n + 0.5 * (v + 1))
            whole = np.maximum(use + kind, 1)
            back = np.where(use + kind > 0, kind / whole, 1.0)
            seen = centres[codes] * ((uses + types) / whole[g.seg_context])[g.pair_segment]
            p = seen[g.token_pair] + back[g.context] * base[g.words]
            add = lambda x: np.add.reduceat(x, g.first)  # noqa: B023, E731
            ids = pd.array(np.array(row.doc_ids, np.int64), "Int64")
            ids[np.frombuffer(row.nulls, bool)] = pd.NA
            out.append(pd.DataFrame({
                "doc_id": ids, "held_out": ~g.train, "n_tokens": g.lengths, "n_known": add((total[g.words] > 0).astype(np.int64)), "train_tokens": n,
                "base_score": add(np.log10(base[g.words])), "score": add(np.log10(p))}))
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in SCORED.split(", ")])

    return run


def hot_contexts(blocks: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of more than `hot` occurrences (sorted hashes), and into how many parts each is split: at most tokens / hot of them, 16 bytes each."""
    n = max(1, blocks.count())

    def often(batches):
        for b in batches:
            for row in b.itertuples():
                names = np.concatenate([np.frombuffer(row.vocabulary, np.uint64), [START]])
                times = np.append(np.bincount(np.frombuffer(row.words, np.int32), minlength=len(names) - 1), len(row.lengths))
                times[np.searchsorted(names[:-1], END)] = 0  # no context
                some = np.flatnonzero(2 * n * times >= hot)  # what is below in every block adds up to less than half of `hot`
                yield pd.DataFrame({"context": names[some].view(np.int64), "times": times[some]})

    found = blocks.select("vocabulary", "words", "lengths").mapInPandas(often, "context bigint, times bigint")
    rows = found.groupBy("context").agg(F.sum("times").alias("times")).where(F.col("times") >= hot / 2).collect()
    names = np.array([r.context for r in rows], np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], np.array([2 + r.times // hot for r in rows], np.int64)[order]


def score_documents(docs: DataFrame, held_mod: int = 5, held: int = 1, block_words: int = 1_000_000, shard_chars: int = 12_000_000, hot: int = 500_000, most_hot: int = 1 << 20) -> DataFrame:
    """Scores of all documents under the model learnt from those whose crc32(doc_id) mod held_mod is not `held`.

    block_words, shard_chars and hot bound what a task holds; the number of shards follows the text's size. Contexts of more than `hot`
    occurrences, or of more than a share 1 / most_hot of all tokens, if that is more, are split: at most 2 * most_hot names (16 bytes each) go to all tasks.
    """
    src = texts(docs).withColumn("train", F.coalesce(crc_mod(F.col("doc_id"), held_mod) != held, F.lit(True)))
    blocks = written(src.mapInPandas(_encode(block_words), BLOCK), "lm-blocks")
    tokens = blocks.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).first()[0]
    shards = max(1, -(-6 * tokens // shard_chars))
    least = 1 / (4 * max(1, tokens))
    split = hot_contexts(blocks, max(hot, tokens // most_hot))
    asked = blocks.select("block", "train", "lengths", "vocabulary", "words").mapInPandas(_ask(shards, split), ASKED)
    answers = written(asked.groupBy("shard").applyInPandas(_answer(least, split), ANSWER), "lm-answers", "lz4")
    n, v = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    v += answers.select(F.explode("hot").alias("h")).distinct().count() + (n > 0)
    sums = answers.where("weights is not null").select(F.posexplode(F.arrays_zip("weights", "logs")).alias("code", "x")).groupBy("code").agg(F.sum("x.weights").alias("w"), F.sum("x.logs").alias("l"))
    weights, logs = np.zeros(256), np.zeros(256)
    for r in sums.collect():
        weights[r.code], logs[r.code] = r.w, r.l
    centres = grid(least, weights, logs)
    answers = answers.drop("tokens", "types", "hot", "weights", "logs")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(n, v, centres, shards, split), SCORED)
