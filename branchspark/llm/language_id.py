"""Operator 7, language identification by rank-order profiles.

Learning counts the character n-grams of labelled texts and keeps the PROFILE most frequent of
each language, in order. A text is ranked in the same way, and its language is the one whose
profile has the smallest out-of-place distance: the sum over the text's n-grams of how far
their ranks are apart, PROFILE for those that the profile lacks.

Learning takes a bounded sample of the labelled rows (about TRAIN_DOCS for each language, by a
hash of the key). All languages are learned; more than MAX_LANGUAGES, which no list of languages
has, are an error, so the profiles that are broadcast have a fixed bound. Prediction is one narrow
scan; texts of any length are counted whole, in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchspark.llm.common import cut, slices

#: n-grams of 1 to LONGEST characters; kept for each language, and of each text.
LONGEST, PROFILE = 3, 300
#: Labelled documents of a language that learning takes, about; languages that are an error.
TRAIN_DOCS, MAX_LANGUAGES = 2_000, 10_000
#: Characters whose n-grams are counted at once.
PIECE = 500_000

_not_letters = regex.compile(r"\P{L}+")


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text's letters (lower case, all else one blank), packed 21 bits to a
    character, and their counts. n-grams with a blank inside or of blanks only aren't taken."""
    s = " " + _not_letters.sub(" ", text.lower()).strip() + " "
    if len(s) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    return added([np.unique(_grams(code[a : a + PIECE + LONGEST - 1], PIECE), return_counts=True) for a in range(0, len(code), PIECE)])


def _grams(code: np.ndarray, starts: int) -> np.ndarray:
    """The n-grams that begin at the first `starts` characters."""
    code = code.astype(np.uint64)
    blank = code == 32
    key, grams = code, [code[:starts][~blank[:starts]]]
    for n in range(2, LONGEST + 1):
        key = (key[:-1] << np.uint64(21)) | code[n - 1 :]
        inner = blank[:-1] & blank[1:] if n == 2 else np.zeros(len(key), bool)
        for i in range(1, n - 1):
            inner |= blank[i : i + len(key)]
        grams.append(key[:starts][~inner[:starts]])
    return np.concatenate(grams)


def added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key, added up."""
    if len(found) == 1:
        return found[0]
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, np.concatenate([c for _, c in found]))
    return keys, sums


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The `most` most frequent keys, the most frequent first, ties by the smaller key."""
    if len(keys) > 4 * most:  # keys are ascending: only what reaches the last place is sorted
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))[:most]]


class Profiles:
    """Languages with their ranked n-grams, laid out for lookups."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = sorted(profiles)
        self.keys = np.unique(np.concatenate([profiles[x] for x in self.langs])) if profiles else np.empty(0, np.uint64)
        self.ranks = np.full((len(self.langs), len(self.keys)), -1, np.int64)
        for i, x in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, profiles[x])] = np.arange(len(profiles[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is 1 less the distance as a share of the largest possible."""
        if not text or not self.langs or not regex.search(r"\p{L}", text):
            return "und", 0.0
        top = ranked(*gram_counts(text))
        at = np.searchsorted(self.keys, top)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == top
        place = np.arange(len(top))
        theirs = self.ranks[:, at]
        apart = np.where(found & (theirs >= 0), np.minimum(np.abs(theirs - place), PROFILE), PROFILE).sum(axis=1)
        best = int(apart.argmin())  # the first of equals, in the order of names
        return self.langs[best], 1.0 - float(apart[best]) / (PROFILE * len(top))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Profiles:
    """Profiles of docs' non-null languages. Rows without text don't count; rows that repeat count
    each. More than MAX_LANGUAGES languages are an error."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = cut(rows.groupBy("lang").count(), "sizes")
    if sizes.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit(""))), F.lit(1 << 30)) * F.col("count") < F.lit(train_docs << 30)
    sample = rows.join(F.broadcast(sizes), "lang").where(share).select("lang", "text")

    def run(batches):
        for b in slices(batches):
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in sorted(set(names)):
                keys, sums = added([gram_counts(t) for x, t in zip(names, texts, strict=True) if x == name])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(sums)], names=["lang", "gram", "n"])

    sums = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # at most MAX_LANGUAGES x PROFILE rows come to the driver; a language's distinct n-grams are bounded by its alphabet
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("place", place).where(F.col("place") <= PROFILE).orderBy("lang", "place").toArrow().to_pylist()
    found: dict[str, list[int]] = {}
    for r in top:
        found.setdefault(r["lang"], []).append(r["gram"])
    return Profiles({k: np.array(x, np.uint64) for k, x in found.items()})


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs with lang_pred (string) and score (double, 0 to 1) of each whole text.

    `und` with score 0 where the text is null, has no letter or nothing was learned. Null keys,
    repeated rows and empty tables pass through; texts of any length count whole; equal distances go to the first name. Columns
    of docs with these names are replaced; no other column is read.
    """
    new = ["lang_pred", "score"]
    rest = [c for c in docs.columns if c not in new]
    docs = docs.select(*(F.col(f"`{c}`") for c in rest))
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    shipped, at = docs.sparkSession.sparkContext.broadcast(profiles), rest.index(text)

    def run(batches):
        p = shipped.value
        for b in slices(batches):
            said = [p.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=[*rest, *new])

    return docs.mapInArrow(run, schema)
