"""Shared helpers: tables, broadcasts behind a count, and word hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import chain

import numpy as np
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchspark.sources.scratch import cut, scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: A table with at most this many rows of some tens of bytes may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
#: A key with more than one in so many rows is hot.
HOT_KEYS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def broadcast_if_small(df: DataFrame, rows: int | None = None, wide: str | None = None) -> DataFrame:
    """Hint a broadcast only for a counted table of at most BROADCAST_ROWS rows; beyond that the
    join shuffles and adaptive execution splits skewed keys. All columns but `wide` are numbers,
    digests or words; the bytes of a `wide` column are summed, and bounded by BROADCAST_BYTES."""
    if wide is not None:
        rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(wide)), F.lit(0))).first()
        if size > BROADCAST_BYTES:
            return df
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def join_unique(rows: DataFrame, named: DataFrame, key: str, how: str = "inner", wide: str | None = None) -> DataFrame:
    """Join rows to a table that has one row a key, where a few keys may hold most of the rows. The
    keys with more than one in HOT_KEYS of the rows, so at most HOT_KEYS, are told to all tasks;
    only the rest is shuffled, so no task gets a hot key's rows. rows are read three times."""
    small = broadcast_if_small(named, wide=wide)
    if small is not named:
        return rows.join(small, key, how)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__c"))
    hot = F.broadcast(cut(counts.where(F.col("__c") * HOT_KEYS > rows.count()).select(key), "hot"))
    told = F.broadcast(cut(named.join(hot, key, "left_semi"), "told"))
    return rows.join(hot, key, "left_semi").join(told, key, how).unionByName(rows.join(hot, key, "left_anti").join(named, key, how))


def aside(docs: DataFrame, taken) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns that have one of the `taken` names under others, and what gives a frame made
    from it the columns of docs again."""
    named = {c: f"__aside_{i}" if c in taken else c for i, c in enumerate(docs.columns)}
    of = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return docs.select(*(of(c).alias(n) for c, n in named.items())), lambda out: out.select(*(of(n).alias(c) for c, n in named.items()))


class WordHash(dict):
    """word (bytes) -> first 60 bits of its MD5, remembered up to a bound (long words never).

    Words with one hash count as one word: of n distinct words, some two share a hash with a
    probability of about n ** 2 / 2 ** 61 (4e-7 for a million, 0.4 for a billion), so a billion
    distinct words may have one such pair among them."""

    def __init__(self, bound: int = 150_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.md5(word).digest()[:8], "big") >> 4
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One for all operators in a worker, whose memory outlives its tasks.
WORDS = WordHash()


def word_hashes(split: list[list[bytes]]) -> list[np.ndarray]:
    """64-bit hashes (SipHash) of the words of each list. Of a billion distinct words some two share one
    with a chance of about 3 %, and then count as one word."""
    every = np.empty(sum(map(len, split)), object)
    every[:] = list(chain.from_iterable(split))
    return np.split(hash_array(every, categorize=False), np.cumsum([len(w) for w in split])[:-1]) if split else []


def hashed_words(texts, split, chars: int = 2_000_000):
    """The word hashes of each text (null: none), cut by split; about `chars` characters are cut up at once."""
    todo, size = [], 0
    for t in texts:
        todo.append(split(t) if t else [])
        size += len(t or "")
        if size >= chars:
            yield from word_hashes(todo)
            todo, size = [], 0
    yield from word_hashes(todo)


def lower_words(text: str) -> list[bytes]:
    """The words of a text in lower case (A-Z), which ASCII white space parts."""
    return text.encode().lower().split()


def slices(batches, rows: int = 1_000):
    """Record batches in smaller ones, without a copy: what a task holds beside them stays small."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)


_ONE, _TWO, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser."""
    x = (x ^ (x >> _S)) * _ONE
    x = (x ^ (x >> np.uint64(32))) * _TWO
    return x ^ (x >> _S)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive words, in order; of the whole sequence where
    there are fewer words; nothing without words."""
    k = min(k, len(h))
    if not k:
        return h[:0]
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out + h[i : i + n])
    return out


__all__ = ["ASCII_LOWER", "ASCII_UPPER", "BROADCAST_ROWS", "WORDS", "WordHash", "ascii_lower", "aside", "broadcast_if_small", "cut", "hashed_words", "join_unique", "lower_words", "mix", "scratch_path", "shingle_hashes", "slices", "table", "word_hashes"]
