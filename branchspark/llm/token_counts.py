"""Operator 1, token counts, by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch of documents lie in one flat numpy array of symbols. In each round
every pre-token applies its own lowest-ranked pair, all pre-tokens at once; those without a
pair leave the array, and the symbols they have left are their token counts. Texts are only
scanned, nothing is shuffled, so the work is one narrow stage at any size.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchspark.llm.common import slices
from branchspark.llm.vocab import Ranks, load

#: Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of at most so many characters whose counts a worker remembers, and characters held as pre-tokens at once.
REMEMBERED, REMEMBERED_CHARS, HELD_CHARS = 400_000, 64, 2_000_000


def merged_lengths(words: list[bytes], symbols: np.ndarray, ranks: Ranks) -> np.ndarray:
    """Symbols that survive in each word (bytes, not empty) after all merges."""
    out = np.ones(len(words), np.int64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    sym = symbols[np.frombuffer(b"".join(words), np.uint8)]
    seq = np.repeat(np.arange(len(words)), lens)
    rank = _pair_ranks(sym, seq, ranks)
    while len(sym):
        starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        sizes = np.diff(np.append(starts, len(seq)))
        least = np.minimum.reduceat(rank, starts)
        done = least == ranks.none
        if done.any():
            out[seq[starts[done]]] = sizes[done]
            keep = ~np.repeat(done, sizes)
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            least, sizes = least[~done], sizes[~done]
            if not len(sym):
                break
        hit = rank == np.repeat(least, sizes)
        at = np.flatnonzero(hit)
        # a run of neighbouring hits is one symbol repeated: its pairs overlap, every other one counts, from the left
        run = np.concatenate(([True], np.diff(at) > 1))
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        sym[at] = ranks.made[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        at = moved[at]
        sym, seq, rank = sym[keep], seq[keep], rank[keep]
        for p in (at, at[at > 0] - 1):
            rank[p] = ranks.none
            q = p[p + 1 < len(sym)]
            q = q[seq[q] == seq[q + 1]]
            rank[q] = ranks.of(sym[q], sym[q + 1])
    return out


def _pair_ranks(sym: np.ndarray, seq: np.ndarray, ranks: Ranks) -> np.ndarray:
    """The rank of the pair that begins at each symbol; `none` at a word's last symbol."""
    out = np.full(len(sym), ranks.none)
    inside = np.flatnonzero(seq[1:] == seq[:-1])
    out[inside] = ranks.of(sym[inside], sym[inside + 1])
    return out


class Counter:
    """Counts tokens of texts; keeps the counts of pre-tokens seen, up to a bound."""

    def __init__(self, v: dict):
        self.ranks, self.symbols, self.known = Ranks(v), v["bytes"], {}
        if not self.ranks.ordered:
            raise ValueError("the merges aren't in the order of their products")
        self.find = regex.compile(PATTERN).findall
        # in ASCII texts the same pattern means this one
        self.find_ascii = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+""").findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(v["special"], key=len, reverse=True)))) if v["special"] else None
        self.heads = {s[:2] for s in v["special"]}

    def pieces(self, text: str):
        return self.find_ascii(text) if text.isascii() else self.find(text)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out, todo, held, size = np.zeros(len(texts), np.int64), [], set(), 0
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if any(h in text for h in self.heads):
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            for part in parts:
                words = self.pieces(part)
                todo.append((i, words))
                held.update(words)
                size += len(part)
            if size >= HELD_CHARS:
                self._flush(out, todo, held)
                todo, held, size = [], set(), 0
        self._flush(out, todo, held)
        return out

    def _flush(self, out, todo, held) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in held if w not in self.known]
        if new:
            self.known.update(zip(new, merged_lengths([w.encode() for w in new], self.symbols, self.ranks).tolist(), strict=True))
        for i, words in todo:
            out[i] += sum(map(self.known.__getitem__, words))
        for w in new:
            if len(w) > REMEMBERED_CHARS:
                del self.known[w]


_counters: dict[str, Counter] = {}


def counter(v: dict) -> Counter:
    """One counter for each vocabulary in a worker, kept over its tasks."""
    if v["id"] not in _counters:
        _counters.clear()
        _counters[v["id"]] = Counter(v)
    return _counters[v["id"]]


@lru_cache(maxsize=4)
def _loaded(path: str) -> dict:
    return load(path)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a column `out` (long): the tokens of each whole text under the byte-level BPE of
    the JSON file `tokenizer`, special strings in a text counting as one token each.

    Null and empty texts have 0 tokens; a null row key, repeated rows and empty tables pass
    through; texts of any length are counted whole, in bounded blocks of pre-tokens for each
    batch. A column of docs called `out` is replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(_loaded(tokenizer))
    rest = [c for c in docs.columns if c != out]
    schema = docs.select(*(F.col(f"`{c}`") for c in rest)).schema.add(out, "long", False)
    at = rest.index(text)

    def run(batches):
        c = counter(shipped.value)
        for b in slices(batches):
            n = c.counts(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], names=[*rest, out])

    return docs.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)
