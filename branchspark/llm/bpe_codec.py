"""Operator 10, BPE encoding and decoding, by an index of pair occurrences.

The distinct words of a partition's batch lie in one array of symbols with links to the
neighbours. An index maps each mergeable pair to all its positions. Ranks that have
positions are active; they are applied in ascending order, and each merge moves the
neighbours' pairs to the lists of their new ranks. Texts are only scanned: nothing is
shuffled, and a batch's index is bounded by HELD_WORDS distinct words.

Words are cut as the tokenizer library cuts them, whose Unicode tables differ from Python's: the
driver asks it once for its letters, numbers and forms of single characters, and texts that have a
character where the tables differ go through the library's normaliser and the exact pattern.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers
from tokenizers.normalizers import Sequence

from branchspark.llm.common import slices
from branchspark.llm.vocab import Ranks, load

#: Fixed value: the words of the normalised text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Distinct words indexed at once, words of at most so many characters remembered by a worker, words of texts held at once.
HELD_WORDS, REMEMBERED, REMEMBERED_CHARS, HELD_PARTS = 20_000, 140_000, 64, 300_000
#: `re` tests sets of characters up to this one by a table, others range by range.
LAST_LOW = "\uffff"


def _plain_form(text: str) -> str:
    """A text as the normaliser has it, by Python's tables. Capital sigma has one lower case there,
    whatever follows it; white space only parts words."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _set(chars: set[str]) -> str:
    """A character set's inside, as ranges."""
    at = sorted(map(ord, chars))
    cuts = [i for i in range(len(at)) if i == 0 or at[i] != at[i - 1] + 1] + [len(at)]
    return "".join(f"\\U{at[a]:08X}-\\U{at[z - 1]:08X}" for a, z in zip(cuts, cuts[1:], strict=False))


def unicode_differences(tokenizer: Tokenizer) -> dict[str, str]:
    """Where the library's tables aren't Python's, as insides of character sets: letters and numbers
    that it doesn't take for such or takes besides, and `odd` (`odd_high` above LAST_LOW): all these,
    characters with another form, and those newer than Unicode 3.2 that take part in compositions."""
    known = regex.findall(r"[^\p{Cn}\p{Cs}\p{Co}]", "".join(map(chr, range(0x110000))))
    out, odd = {}, set()
    for name in ("L", "N"):
        ours = set(regex.findall(rf"\p{{{name}}}", "".join(known))) | {c for c in known if unicodedata.category(c)[0] == name}
        text = "".join(sorted(ours))
        theirs = set(text)
        for part, _ in pre_tokenizers.Split(Regex(rf"\p{{{name}}}"), "removed").pre_tokenize_str(text):
            theirs -= set(part)
        for sign, differ in (("-", {c for c in ours - theirs if regex.match(rf"\p{{{name}}}", c)}), ("+", {c for c in theirs if not regex.match(rf"\p{{{name}}}", c)})):
            out[f"{name}{sign}"] = _set(differ)
            odd |= differ
    lone = [c for c in known if c != "|" and not c.isspace()]  # a bar composes with nothing
    said = tokenizer.normalizer.normalize_str("|".join(lone)).split("|")
    odd.update(c for c, form in zip(lone, said, strict=True) if form != _plain_form(c))
    for c in known:
        if unicodedata.ucd_3_2_0.category(c) == "Cn":
            parts = unicodedata.decomposition(c)
            if unicodedata.category(c) == "Cn" or unicodedata.combining(c) or parts:
                odd.add(c)
            if parts and not parts.startswith("<"):
                odd.update(chr(int(x, 16)) for x in parts.split() if unicodedata.ucd_3_2_0.category(chr(int(x, 16))) == "Cn")
    return {**out, "odd": _set({c for c in odd if c <= LAST_LOW}), "odd_high": _set({c for c in odd if c > LAST_LOW})}


@lru_cache(maxsize=4)
def loaded(path: str) -> dict:
    """What tasks need of a tokenizer's file: its tables, its text (for the normaliser) and where
    its Unicode tables differ."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    tokenizer = Tokenizer.from_str(text)
    return {**load(path), "normalizer": tokenizer.normalizer.__getstate__(), "differences": unicode_differences(tokenizer)}


class PairIndex:
    """The merge rules, and their application to a set of words through the index."""

    def __init__(self, v: dict):
        self.ranks = Ranks(v)
        self.rules = list(zip(v["left"].tolist(), v["right"].tolist(), v["made"].tolist(), strict=True))
        size = int(self.ranks.size)
        self.rank_of = {a * size + b: r for r, (a, b, _) in enumerate(self.rules)}
        self.bytes, self.ends = v["bytes"], v["ends"]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word (UTF-8, not empty); a word's last byte takes its end form."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        flat = np.frombuffer(b"".join(words), np.uint8)
        last = ends - 1
        symbols = self.bytes[flat]
        if (self.ends >= 0).all():
            symbols[last] = self.ends[flat[last]]
        # index: positions of each active rank, in ascending order
        inside = np.ones(len(flat), bool)
        inside[last] = False
        left = np.flatnonzero(inside)
        rank = self.ranks.of(symbols[left], symbols[left + 1])
        left, rank = left[rank < self.ranks.none], rank[rank < self.ranks.none]
        order = np.argsort(rank, kind="stable")
        left, rank = left[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        places = {int(r[0]): p.tolist() for r, p in zip(np.split(rank, cuts), np.split(left, cuts), strict=True) if len(r)}
        nxt = np.where(inside, np.arange(1, len(flat) + 1), -1).tolist()
        prv = np.concatenate(([-1], np.where(inside[:-1], np.arange(len(flat) - 1), -1))).tolist() if len(flat) else []
        symbols = symbols.tolist()
        self._apply(symbols, nxt, prv, places)
        out, at = [], 0
        for end in ends.tolist():
            ids = []
            while at >= 0:
                ids.append(symbols[at])
                at = nxt[at]
            out.append(ids)
            at = end
        return out

    def _apply(self, symbols: list[int], nxt: list[int], prv: list[int], places: dict[int, list[int]]) -> None:
        rules, size, rank_of = self.rules, int(self.ranks.size), self.rank_of.get
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, made = rules[rank]
            todo = places.pop(rank)
            todo.sort()
            for k, p in enumerate(todo):
                q = nxt[p]
                if symbols[p] != a or q < 0 or symbols[q] != b:
                    continue  # a neighbour's merge has taken part of this pair
                symbols[p], symbols[q] = made, -1
                nxt[p] = n = nxt[q]
                sooner = rank
                if n >= 0:
                    prv[n] = p
                    r = rank_of(made * size + symbols[n])
                    if r is not None:
                        if r in places:
                            places[r].append(p)
                        else:
                            places[r] = [p]
                            heapq.heappush(active, r)
                        sooner = min(sooner, r)
                m = prv[p]
                if m >= 0:
                    r = rank_of(symbols[m] * size + made)
                    if r is not None:
                        if r in places:
                            places[r].append(m)
                        else:
                            places[r] = [m]
                            heapq.heappush(active, r)
                        sooner = min(sooner, r)
                if sooner < rank:  # the new pair goes before the rest of this rank
                    if k + 1 < len(todo):
                        places[rank] = places.get(rank, []) + todo[k + 1 :]
                        heapq.heappush(active, rank)
                    break


class Codec:
    """Encodes and decodes texts; remembers words' ids, up to a bound."""

    def __init__(self, v: dict):
        self.index, self.strings = PairIndex(v), v["strings"]
        self.ids: dict[str, bytes] = {}
        self.find = regex.compile(PATTERN).findall
        # in lower-case ASCII texts the same pattern means this one
        self.find_ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in v["special"].items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.heads = {s[:2] for s in self.special}
        d = v["differences"]
        sets = {n: rf"[\p{{{n}}}{f'--[{d[n + "-"]}]' if d[n + '-'] else ''}{f'||[{d[n + "+"]}]' if d[n + '+'] else ''}]" for n in "LN"}
        self.find_exactly = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{sets['L']}+|{sets['N']}|(?:(?!{sets['L']}|{sets['N']})\S)+", regex.V1).findall
        self.odd, self.high, self.odd_high = (re.compile(f"[{x}]").search if x else lambda text: None for x in (d["odd"], r"\U00010000-\U0010FFFF", d["odd_high"]))
        self.normalizer = Sequence([])
        self.normalizer.__setstate__(v["normalizer"])

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.find_ascii(text.lower())
        if self.odd(text) or self.high(text) and self.odd_high(text):
            return self.find_exactly(self.normalizer.normalize_str(text))
        return self.find(_plain_form(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out, todo, n = [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            pieces = []
            for part in self.split.split(text) if any(h in text for h in self.heads) else (text,):
                pieces.append(part if part in self.special else self.words(part))
                n += len(pieces[-1])
            todo.append((i, pieces))
            if n >= HELD_PARTS:
                self._flush(out, todo)
                todo, n = [], 0
        self._flush(out, todo)
        return out

    def _flush(self, out: list[bytes], todo: list) -> None:
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        new: set[str] = set()
        for _, pieces in todo:
            for p in pieces:
                if not isinstance(p, str):
                    new.update(p)
        fresh = [w for w in new if w not in self.ids]
        for k in range(0, len(fresh), HELD_WORDS):
            some = fresh[k : k + HELD_WORDS]
            self.ids.update((w, np.array(x, "<u4").tobytes()) for w, x in zip(some, self.index.encode([w.encode() for w in some]), strict=True))
        get = self.ids.__getitem__
        for i, pieces in todo:
            out[i] = b"".join(self.special[p] if isinstance(p, str) else b"".join(map(get, p)) for p in pieces)
        for w in fresh:
            if len(w) > REMEMBERED_CHARS:
                del self.ids[w]

    def decode(self, ids: bytes) -> str:
        """The token strings, joined by a space: what a tokenizer file without a decoder gives."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec(v: dict) -> Codec:
    if v["id"] not in _codecs:
        _codecs.clear()
        _codecs[v["id"]] = Codec(v)
    return _codecs[v["id"]]


def _mapped(docs: DataFrame, tokenizer: str, text: str, added: list[tuple[str, T.DataType]], make) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(loaded(tokenizer))
    names = [n for n, _ in added]
    rest = [c for c in docs.columns if c not in names]
    docs = docs.select(*(F.col(f"`{c}`") for c in rest))
    schema = T.StructType([*docs.schema, *(T.StructField(n, t, False) for n, t in added)])
    at = rest.index(text)

    def run(batches):
        c = codec(shipped.value)
        for b in slices(batches, 500):
            yield pa.RecordBatch.from_arrays([*b.columns, *make(c, b.column(at).to_pylist())], names=[*rest, *names])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with `out` (binary): each whole text's token ids as little-endian unsigned 32-bit
    integers, as the word-end BPE of the JSON file `tokenizer` gives them without added tokens.

    Null and empty texts give no ids; null keys, repeated rows and empty tables pass through; texts of
    any length are encoded whole, in blocks of words.
    A column of docs called `out` is replaced.
    """
    return _mapped(docs, tokenizer, text, [(out, T.BinaryType())], lambda c, t: [pa.array(c.encode(t), pa.binary())])


def decode(docs: DataFrame, tokenizer: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with `out` (string): the decoded text of the binary column `ids` (null: no ids)."""
    return _mapped(docs, tokenizer, ids, [(out, T.StringType())], lambda c, t: [pa.array([c.decode(x or b"") for x in t], pa.string())])


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with token_ids and decoded, both in one go (see `encode` and `decode`)."""

    def make(c: Codec, texts):
        ids = c.encode(texts)
        return [pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.string())]

    return _mapped(docs, tokenizer, text, [("token_ids", T.BinaryType()), ("decoded", T.StringType())], make)


def encode_digests(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of each whole text, the ids and the
    decoded text themselves staying in the task (see `encode` and `decode` for them)."""

    def make(c: Codec, texts):
        ids = c.encode(texts)
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        ]

    return _mapped(docs, tokenizer, text, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], make)
