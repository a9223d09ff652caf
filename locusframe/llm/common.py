"""What the operators share: scratch tables, stable hashing, input clean-up and packed arrays."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.sources.shared import drop_shared as drop_scratch  # noqa: F401 (for callers)
from locusframe.sources.shared import shared_folder as scratch  # noqa: F401
from locusframe.sources.shared import written  # noqa: F401

#: Java's form of the contract's word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string) only: extra columns are dropped, null text is empty. Null ids stay null."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def hashed(docs: DataFrame) -> DataFrame:
    """texts() and text_hash, which tells several texts of one id apart."""
    return texts(docs).withColumn("text_hash", F.xxhash64("text"))


def kept_whole(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, text_hash): row is the whole document as a struct, so that none of its columns' names can clash with a stage's own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(text).alias("text_hash"))


def crc_mod(col: Column, m: int) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % m


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased. bytes.split() cuts at exactly the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class HashedWords:
    """Texts to arrays of 64-bit word hashes. A word is hashed once; the memory of words is emptied between batches at `bound`."""

    def __init__(self, bound: int = 300_000):
        self.bound = bound
        self._clear()

    def _clear(self) -> None:
        self.ids: defaultdict = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.hashes = np.zeros(0, np.uint64)

    def batch(self, texts_) -> list[np.ndarray]:
        if len(self.ids) > self.bound:
            self._clear()
        get = self.ids.__getitem__
        found = [np.array(list(map(get, words_of(t))), np.int32) for t in texts_]
        if len(self.ids) > len(self.hashes):
            new = [xxhash.xxh3_64_intdigest(w) for w in islice(self.ids, len(self.hashes), None)]
            self.hashes = np.concatenate([self.hashes, np.array(new, np.uint64)])
        return [self.hashes[x] for x in found]


def hands_back(run):
    """run, a function over a task's batches, that returns its freed memory to the machine at the task's end.

    Spark keeps a Python worker between tasks and stages; what a memo or a batch took would else stay with it while other workers run.
    """

    @functools.wraps(run)
    def tidy(batches):
        yield from run(batches)
        gc.collect()  # HashedWords' table of words refers to itself
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return tidy


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of each row, concatenated."""
    if len(lengths) == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
