"""BPE encoding and decoding by tree concatenation (operator 4).

A text is halved until its pieces are at most `leaf` characters; the pieces of all texts of a batch are encoded on their own,
side by side, and joined up the tree, level by level. At a join the window around the cut is encoded anew, with as many
units (words, or fragments of one at a piece's edge) from the left piece as from the right. The join holds once the window's
encoding begins with the left piece's own ids of its outermost unit and ends with the right piece's of its; else the window
doubles. A window that has taken in a whole piece needs no agreement on that side. What lies between the outermost units is
taken from the window: the word that the cut ran through, put together, is a unit of its own from then on.

A fragment of more than `leaf` characters (text without white space) is joined by windows of characters, which double until they share
a token (same id, same place) with the left and with the right encoding. Every neighbouring pair of the joined sequence then
stands next to each other in one of the three encodings; a sequence all of whose neighbours are BPE-stable is the encoding of the
whole.

Ids of units are remembered, so equal words are encoded once a task. Spark only deals out documents: no shuffle, and a task's memory
is bounded by its batches and a memo that is cut back to the batch's own words at `memo_words`.

Defined results: null text counts as empty (0 tokens, empty decoding); null ids are kept; repeated rows give repeated results;
extra columns are ignored; very long texts are used whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from locusframe.llm.common import hands_back, texts

SPACES = " \t\n\r\x0b\x0c"
#: Stands between words that are encoded in one text.
MARK = "\x00"


class TreeEncoder:
    """encode() and decode() of one tokenizers file. joins and windows count the joins made and the windows encoded for them."""

    def __init__(self, path: str, leaf: int = 768, memo_words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.fast = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.leaf, self.memo_words = leaf, memo_words
        self.memo: dict[str, list[int]] = {}
        self.placed: dict[str, list] = {}  # of long fragments: (id, start, end)
        self.joins = self.windows = 0
        mark = self.tok.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _pieces(self, texts_: list[str]) -> list[list[tuple[int, int, int]]]:
        """(id, start, end) of each token, of texts encoded on their own."""
        return [[(i, *o) for i, o in zip(e.ids, e.offsets, strict=True)] for e in self.tok.encode_batch(texts_, add_special_tokens=False)]

    def _join(self, text: str, a: int, cut: int, b: int, left: list, right: list) -> list:
        """The encoding of text[a:b] from those of text[a:cut] and text[cut:b]; places count from the text's start."""
        reach = 32
        while True:
            lo, hi = max(a, cut - reach), min(b, cut + reach)
            window = [(i, s + lo, e + lo) for i, s, e in self._pieces([text[lo:hi]])[0]]
            seen = {t: k for k, t in enumerate(window)}
            start, end = (-1, 0) if lo == a else (None, None), (len(window), len(right)) if hi == b else (None, None)
            if lo > a:  # a shared token that neither edge of the window nor the cut has touched
                start = next(((seen[t], k) for k in range(len(left) - 1, -1, -1) if (t := left[k])[1] > lo and t[2] < cut and t in seen), (None, None))
            if hi < b:
                end = next(((seen[t], k) for k, t in enumerate(right) if t[1] > cut and t[2] < hi and t in seen), (None, None))
            if start[0] is not None and end[0] is not None and start[0] < end[0]:
                head = left[: start[1] + 1] if lo > a else []
                tail = right[end[1] :] if hi < b else []
                return head + window[start[0] + 1 : end[0]] + tail
            reach *= 2

    def _join_long(self, left: str, right: str) -> None:
        """Remember the encoding of left + right, two fragments of which one at least is long."""
        both = left + right
        if both in self.placed:
            return
        for x in (left, right):
            if x not in self.placed:
                self.placed[x] = self._pieces([x])[0]
        cut = len(left)
        moved = [(i, s + cut, e + cut) for i, s, e in self.placed[right]]
        self.placed[both] = self._join(both, 0, cut, len(both), self.placed[left], moved)
        self.memo[both] = [i for i, _, _ in self.placed[both]]

    def _leaves(self, text: str) -> list[tuple[int, int]]:
        spans = [(0, len(text))]
        while spans[0][1] - spans[0][0] > self.leaf:
            spans = [x for a, b in spans for x in ((a, (a + b) // 2), ((a + b) // 2, b))]
        return spans

    def _level(self, cuts: list[tuple[list[str], list[str], bool]]) -> list[list[str]]:
        """Pairs of neighbouring pieces (units of the left, of the right, whether the cut runs through a word), joined."""
        out: list = [None] * len(cuts)
        todo = []
        for k, (left, right, glued) in enumerate(cuts):
            if not left or not right:
                out[k] = left + right
            elif glued and len(left[-1]) + len(right[0]) > self.leaf:
                self._join_long(left[-1], right[0])
                out[k] = left[:-1] + [left[-1] + right[0]] + right[1:]
            else:
                todo.append(k)
        self.joins += len(cuts)
        reach = 2
        while todo:
            parts = [(cuts[k][0][-reach:], cuts[k][1][:reach]) for k in todo]
            shown = [" ".join(a) + ("" if cuts[k][2] else " ") + " ".join(b) for k, (a, b) in zip(todo, parts, strict=True)]
            self.windows += len(shown)
            again = []
            for k, (a, b), said, e in zip(todo, parts, shown, self.fast(shown, add_special_tokens=False), strict=True):
                left, right, glued = cuts[k]
                ids = e.ids
                head = self.memo[a[0]] if len(a) < len(left) or len(a) > 1 else []
                tail = self.memo[b[-1]] if len(b) < len(right) or len(b) > 1 else []
                whole_left, whole_right = len(a) == len(left), len(b) == len(right)
                agree = ids[: len(head)] == head and ids[len(ids) - len(tail) :] == tail and len(head) + len(tail) <= len(ids)
                if not agree and not (whole_left and whole_right):
                    again.append(k)
                    continue
                if not agree:  # nothing is left to agree with: the window is both pieces
                    self.memo[said] = ids
                    out[k] = [said]
                    continue
                inner_a, inner_b = (a[1:] if head else a), (b[:-1] if tail else b)
                middle = inner_a[:-1] + ([inner_a[-1] + inner_b[0]] if glued and inner_a and inner_b else inner_a[-1:] + inner_b[:1]) + inner_b[1:]
                middle_ids = ids[len(head) : len(ids) - len(tail)]
                known = [i for u in middle if u in self.memo for i in self.memo[u]]
                lone = [u for u in middle if u not in self.memo]
                if len(lone) == 1:  # the word put together: what the window holds beside the units on its sides
                    at = middle.index(lone[0])
                    p = sum(len(self.memo[u]) for u in middle[:at])
                    q = len(middle_ids) - sum(len(self.memo[u]) for u in middle[at + 1 :])
                    self.memo[lone[0]] = middle_ids[p:q]
                    known = [i for u in middle for i in self.memo[u]]
                if known != middle_ids and whole_left and whole_right:  # agreed at its ends only, and no larger window exists
                    self.memo[said] = ids
                    out[k] = [said]
                    continue
                if known != middle_ids:
                    again.append(k)
                    continue
                out[k] = left[: len(left) - len(a)] + a[: len(a) - len(inner_a)] + middle + b[len(inner_b) :] + right[len(b) :]
            todo = again
            reach *= 2
        return out

    def _remember(self, new: list[str], run: int = 100) -> None:
        """Put the ids of words into the memo. A run of words is one text with a mark between two words, which is quicker than a text a word.

        If the marks do not count up, since a word holds one or the tokenizer has no id for it alone, the run's words are encoded on their own.
        """
        runs = [new[k : k + run] for k in range(0, len(new), run)]
        alone = []
        for some, e in zip(runs, self.fast([f" {MARK} ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = e.ids
            marks = [k for k, i in enumerate(ids) if i == self.mark]
            if len(marks) != len(some) - 1:
                alone += some
                continue
            start = 0
            for w, end in zip(some, [*marks, len(ids)], strict=True):
                self.memo[w] = ids[start:end]
                start = end + 1
        for w, e in zip(alone, self.fast(alone, add_special_tokens=False), strict=True):
            self.memo[w] = e.ids

    def units(self, texts_: list[str]) -> list[list[str]]:
        """Each text as units whose ids the memo holds; their ids in a row are the text's encoding."""
        spans = [self._leaves(t) for t in texts_]
        words, distinct = _words([t[a:b] for t, s in zip(texts_, spans, strict=True) for a, b in s])
        if len(self.memo) > self.memo_words:  # words of this batch stay
            known = {w: self.memo[w] for w in distinct if w in self.memo}
            self.memo.clear()
            self.memo.update(known)
            self.placed.clear()
        words = iter(words)
        pieces = [list(islice(words, len(s))) for s in spans]
        new = [w for w in distinct if w not in self.memo]
        for k in range(0, len(new), 5000):
            self._remember(new[k : k + 5000])
        while open_ := [t for t, p in enumerate(pieces) if len(p) > 1]:
            cuts = []
            for t in open_:
                text = texts_[t]
                for k in range(0, len(pieces[t]), 2):
                    at = spans[t][k][1]
                    cuts.append((pieces[t][k], pieces[t][k + 1], text[at - 1] not in SPACES and text[at] not in SPACES))
            done = iter(self._level(cuts))
            for t in open_:
                pieces[t] = [next(done) for _ in range(0, len(pieces[t]), 2)]
                spans[t] = [(spans[t][k][0], spans[t][k + 1][1]) for k in range(0, len(spans[t]), 2)]
        return [p[0] for p in pieces]

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units([text])[0] for i in self.memo[u]]

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)


def _words(texts_: list[str]) -> tuple[list[list[str]], list[str]]:
    """Of each text its runs without ASCII white space, and all different ones. Equal words are one object, which is hashed once."""
    split = pc.ascii_split_whitespace(pa.array(texts_, pa.large_string()))
    full = pc.greater(pc.binary_length(split.values), 0)  # white space at a text's edge leaves empty runs
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy()].tolist()
    words = split.values.filter(full).dictionary_encode()
    distinct = words.dictionary.to_numpy(zero_copy_only=False)
    flat = distinct[words.indices.to_numpy()].tolist()
    return [flat[a:b] for a, b in zip(ends, ends[1:])], distinct.tolist()  # noqa: B905 (ends is one longer)


class _Packed(dict):
    """Units to their ids as 32-bit integers in bytes, packed once."""

    def __init__(self, memo: dict[str, list[int]]):
        super().__init__()
        self.memo = memo

    def __missing__(self, unit: str) -> bytes:
        packed = self[unit] = array("i", self.memo[unit]).tobytes()
        return packed


def _shas(names: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """SHA-256 of each text, whose ids end at `ends`, with its ids put as `names`, a space at each one's end; the last space does not count."""
    said = names.take(pa.array(ids))
    at = np.frombuffer(said.buffers()[1], np.int64)[said.offset :][np.concatenate([[0], ends])].tolist()
    data = memoryview(said.buffers()[2] or b"")
    return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]  # noqa: B905 (at is one longer)


def _some(batch: pd.DataFrame, chars: int = 2_000_000):
    """Runs of rows of about so many characters: (ids, texts)."""
    ids, run, size = [], [], 0
    for i, t in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
        ids.append(i)
        run.append(t)
        size += len(t)
        if size >= chars:
            yield ids, run
            ids, run, size = [], [], 0
    if ids:
        yield ids, run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> and decoded string: the operator's own output."""

    @hands_back
    def run(batches):
        tree = TreeEncoder(path)
        for b in batches:
            for doc, some in _some(b):
                ids = [[i for u in units for i in tree.memo[u]] for units in tree.units(some)]
                yield pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "ids": ids, "decoded": [tree.decode(x) for x in ids]})

    return texts(docs).mapInPandas(run, "doc_id bigint, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded text, without the ids leaving their task.

    The ids of a run of texts are put as text together, by Arrow. The tokenizer has no decoder, so its decode() joins the tokens by
    one space; special tokens are kept.
    """

    @hands_back
    def run(batches):
        tree = TreeEncoder(path)
        packed = _Packed(tree.memo)
        known = range(max(tree.tok.get_vocab(with_added_tokens=True).values()) + 1)
        numbers = pa.array([f"{i} " for i in known], pa.large_string())
        tokens = pa.array([f"{tree.tok.id_to_token(i)} " for i in known], pa.large_string())
        for b in batches:
            for doc, some in _some(b):
                if len(packed) > tree.memo_words:
                    packed.clear()
                ids = [b"".join(map(packed.__getitem__, units)) for units in tree.units(some)]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ids, ends = np.frombuffer(b"".join(ids), np.int32), np.cumsum(n)
                yield pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "n_tokens": n, "ids_sha256": _shas(numbers, ids, ends), "decoded_sha256": _shas(tokens, ids, ends)})

    return texts(docs).mapInPandas(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
