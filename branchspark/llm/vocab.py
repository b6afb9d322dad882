"""Merge tables read from a public tokenizer's JSON file, shipped to tasks as one broadcast.

The file has a fixed size (about 50,000 merges), so the broadcast doesn't grow with the data.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable in Latin-1, else the
    next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def load(path: str) -> dict:
    """What tasks need of the file: token strings, merges as ids, the ids of single bytes (with
    and without the suffix of a word's end) and the special strings."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    tok = json.loads(raw)
    model = tok["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    chars = byte_characters()
    special = {t["content"]: t["id"] for t in tok["added_tokens"]}
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in tok["added_tokens"]):
        raise ValueError("special tokens that strip or are normalised aren't supported")
    size = max([*vocab.values(), *special.values()]) + 1
    strings = [""] * size
    for s, i in [*vocab.items(), *special.items()]:
        strings[i] = s
    return {
        "id": hashlib.sha256(raw.encode()).hexdigest(), "left": left, "right": right, "made": made, "strings": strings,
        "bytes": np.array([vocab[c] for c in chars], np.int64), "ends": np.array([vocab.get(c + suffix, -1) for c in chars], np.int64), "special": special,
    }


class Ranks:
    """rank and product of a pair of symbols, found by binary search over packed pairs."""

    def __init__(self, v: dict):
        self.size = np.int64(len(v["strings"]))
        key = v["left"] * self.size + v["right"]
        self.rank_of = np.argsort(key, kind="stable")
        self.keys = key[self.rank_of]
        self.made = v["made"]
        self.none = np.int64(len(key))
        # a pair that holds the product of a later merge would have to be applied out of order
        first = np.full(len(v["strings"]), -1, np.int64)
        first[v["made"][::-1]] = np.arange(len(key) - 1, -1, -1)
        self.ordered = bool((np.maximum(first[v["left"]], first[v["right"]]) < np.arange(len(key))).all()) and len(np.unique(v["made"])) == len(key)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; `none` where it isn't a merge."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_of[at], self.none)
