"""Operator 6, quality rules: plain counts, and a hashed n-gram log-likelihood ratio.

Uni- and bigrams of tokens (runs of letters and digits, runs of ASCII signs) are hashed into
BUCKETS buckets. One scan counts the buckets in the whole raw corpus and in the trusted
target documents; the two smoothed multinomials give each bucket a weight, the logarithm of
target over raw, in whole millionths. A second scan sums the weights of each document, divides
by its number of n-grams and keeps what reaches THRESHOLD: all in integers, so the verdict of
a document doesn't depend on the order of additions.

Only BUCKETS sums and at most TARGET_BOUND document ids are broadcast, at any size of input.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchspark.llm.common import WORDS, aside, slices, table

BUCKETS = 1 << 16
#: Trusted documents are labelled with quality 1; at most so many, those whose id has the smallest MD5.
TARGET_BOUND = 20_000
#: Millionths of a natural logarithm for each n-gram: a document that is less like the target than this goes.
#: Trusted documents of sf0.01 lie above -100_000, those labelled 0 below -1_430_000: it leaves room on the side of
#: the trusted, as a wrong rejection loses a document.
THRESHOLD = -400_000
SMOOTHING = 1.0
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr_micros"]

_tokens = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[!-/:-@\[-^`{-~]+").findall
_symbols = re.compile(rb"[#*$%&|<>]").findall


def gram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's token uni- and bigrams, with repeats."""
    if not text:
        return np.empty(0, np.int64)
    h = WORDS.array(_tokens(text.encode())).astype(np.int64)
    return np.concatenate((h % buckets, (h[:-1] % 1_000_003 * 1_009 + h[1:] % 999_983) % buckets))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text (null: empty)."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # of bytes: at ASCII white space, which is \x20 and \x09-\x0D
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        key = w[:-2] * len(ids) + w[1:-1]  # below n squared
        if len(ids) < 2_000_000:
            key = key * len(ids) + w[2:]
        else:
            key = np.unique(key, return_inverse=True)[1] * len(ids) + w[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        in_window = np.zeros(n, bool)
        for i in range(3):
            in_window[i : i + n - 2] |= twice
        repeats = int(in_window.sum())
    return n, chars, len(_symbols(raw)), len(lines) - len(set(lines)), repeats


def target_ids(labels: DataFrame, bound: int = TARGET_BOUND) -> DataFrame:
    """Ids of trusted documents: labelled, with no label under 1. At most `bound` rows."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(bound).select("doc_id")


def fit(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Weights of the buckets in millionths (int64). docs: all of the raw corpus (doc_id, text);
    target: a bounded table of doc_ids. The result is 8 x `buckets` bytes, whatever the corpus."""
    flagged = docs.select("doc_id", "text").join(F.broadcast(target.select("doc_id", F.lit(True).alias("trusted"))), "doc_id", "left").select("text", "trusted")

    def run(batches):
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in slices(batches):
            for text, trusted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = gram_buckets(text, buckets)
                if len(c) > buckets // 8:
                    c = np.bincount(c, minlength=buckets)
                    raw += c
                    if trusted:
                        good += c
                else:
                    np.add.at(raw, c, 1)
                    if trusted:
                        np.add.at(good, c, 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    sums = flagged.mapInArrow(run, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[sums["bucket"].to_numpy()] = sums["raw"].to_numpy()
    good[sums["bucket"].to_numpy()] = sums["good"].to_numpy()
    if not good.sum():
        return np.zeros(buckets, np.int64)
    ratio = (good + SMOOTHING) / (good.sum() + SMOOTHING * buckets) / ((raw + SMOOTHING) / (raw.sum() + SMOOTHING * buckets))
    return np.rint(np.log(ratio) * 1e6).astype(np.int64)


def judge(docs: DataFrame, weights: np.ndarray, text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    llr_micros (long: the mean weight of its n-grams, rounded down; 0 without any) and kept.

    Null and empty texts have no words, so base_failed is true. Rows that repeat are judged
    each; a null key passes through; texts of any length are judged whole; a mean of exactly `threshold`
    passes; without trusted documents, or rows, all weights are 0 and only the base rules decide. Columns of docs with these names are replaced.
    """
    new = COUNTS
    rest = [c for c in docs.columns if c not in (*new, "base_failed", "kept")]
    docs = docs.select(*(F.col(f"`{c}`") for c in rest))
    schema = T.StructType([*docs.schema, *(T.StructField(n, T.LongType(), False) for n in new)])
    shipped, at = docs.sparkSession.sparkContext.broadcast(weights), rest.index(text)

    def run(batches):
        w = shipped.value
        for b in slices(batches):
            rows = []
            for t in b.column(at).to_pylist():
                grams = gram_buckets(t, len(w))
                rows.append((*base_counts(t), math.floor(int(w[grams].sum()) / len(grams)) if len(grams) else 0))
            cols = zip(*rows, strict=True) if rows else [[]] * len(new)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in cols)], names=[*rest, *new])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return docs.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr_micros") >= threshold))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass, with the columns of docs as they were. Each row is judged by its own text, so
    rows without doc_id are judged as well, and rows that repeat go or stay together."""
    weights = fit(docs, target_ids(table(spark, sf_dir, "labels")))
    rows, back = aside(docs, (*COUNTS, "base_failed", "kept"))
    return back(judge(rows, weights).where("kept"))
