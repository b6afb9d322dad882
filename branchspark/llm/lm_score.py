"""Operator 2, language-model scores: stupid backoff, counted over all documents.

    S(w | v) = c(v w) / c(v)          where the corpus has the pair at least MIN_COUNT times
             = BACKOFF * c(w) / N     otherwise (without BACKOFF for a document's first word)

A document is scored by counts that hold itself, where each of its pairs has at least 1: with
MIN_COUNT = 1 no word would ever back off. A count of 2 is a pair that is seen elsewhere or again,
as with the one occurrence left out. A longer order backs off by one word a step.

1. `asked`: documents are cut into chunks of about CHUNK_WORDS words; a chunk's distinct n-grams
   with their numbers go out as arrays, one row for each hash part that they fall in, so an n-gram
   costs its hash on the wire and little more. The rows are dealt by part.
2. Exploded, they are the n-gram table (part, n, gram, chunk, number). Grouped by n-gram they are the
   count table, and the two are joined where they lie, without another shuffle. However often an
   n-gram occurs, its part has it at most once a chunk, so no key is hot; a part's count table is
   what a task holds, which PART_WORDS bounds.
3. The counts go back as arrays by chunk and are joined to the chunk's documents, whose words
   name their n-grams by number; there they are scored and summed for each document.

Steps 1 and 3 read the documents once each, so a document that doesn't come straight from files,
which Spark cuts up alike each time, is stored first. Logarithms are whole millionths, so sums
don't depend on their order. Words and n-grams are 64-bit hashes: of a billion distinct ones some
two collide with a chance of about 3 %, and then add their counts.
"""

from __future__ import annotations

import math
import pickle
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchspark.llm.common import cut, hashed_words, lower_words, mix, slices

BACKOFF, MIN_COUNT, ORDER = 0.4, 2, 2
PART_WORDS, CHUNK_WORDS = 250_000, 1_500_000
#: Parts that a task has, about: parts fall to tasks by a hash, and several level that out.
PARTS_A_TASK = 4
_HALF = np.uint64(32)
#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"


def _logs(c: np.ndarray) -> np.ndarray:
    return np.rint(np.log(c.astype(np.float64)) * 1e6).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    small = [a.astype(np.min_scalar_type(int(a.max()))) if len(a) and a.dtype != np.uint64 and a.min() >= 0 else a for a in arrays]
    raw = pickle.dumps(small, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    return pickle.loads(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def count_words(docs: DataFrame, text: str = "text") -> int:
    """The number of words of all documents."""
    return docs.agg(F.sum(F.regexp_count(F.col(text), F.lit(WORD)).cast("long")).alias("c")).first()["c"] or 0


def _pieces(texts: list[np.ndarray], words: int):
    """(first, last + 1) of runs of texts with at most so many words, or of one text."""
    a = n = 0
    for z, t in enumerate(texts):
        if n and n + len(t) > words:
            yield a, z
            a, n = z, 0
        n += len(t)
    yield a, len(texts)


def _places(sizes: np.ndarray) -> np.ndarray:
    """The place in its text of each word."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _parts_of(grams: np.ndarray, parts: int) -> np.ndarray:
    return (((grams >> _HALF) * np.uint64(parts)) >> _HALF).astype(np.int64)


def _distinct(grams: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The distinct grams with their numbers by part, in order of their first place, and the parts' bounds."""
    found, first, numbers = np.unique(grams, return_index=True, return_counts=True)
    bounds = np.searchsorted(_parts_of(found, parts), np.arange(parts + 1))  # found is in order of parts, too
    part = np.repeat(np.arange(parts), np.diff(bounds))
    sent = np.argsort(part * (len(grams) + 1) + first)
    return found[sent], numbers[sent], bounds.tolist()


def _named(grams: np.ndarray, parts: int) -> tuple:
    """Grams in small: which are new, the others' numbers among the new, the new ones' parts."""
    found, first, i = np.unique(grams, return_index=True, return_inverse=True)
    by_first = np.argsort(first)
    number = np.empty(len(found), np.int64)
    number[by_first] = np.arange(len(found))
    new = np.zeros(len(grams), bool)
    new[first] = True
    return np.packbits(new), number[i[~new]], _parts_of(found[by_first], parts)


def _counts_of(small: tuple, told: np.ndarray, n: int) -> np.ndarray:
    """The told count of each of n grams, from what `_named` made of them."""
    new, others, part = small
    counts = np.empty(len(part), np.int64)
    counts[np.argsort(part, kind="stable")] = told
    at = np.empty(n, np.int64)
    new = np.unpackbits(new, count=n).astype(bool)
    at[new] = np.arange(len(part))
    at[~new] = others
    return counts[at]


def _chunks(batches, at: int, chunk_words: int):
    """(chunk, rows, the words of each): whenever the task runs again, the same. at: the texts' column."""
    task, number = TaskContext.get().partitionId(), 0
    for b in slices(batches, 2_500):
        every = list(hashed_words(b.column(at).to_pylist(), lower_words))
        for first, end in _pieces(every, chunk_words):
            yield task << 24 | number, b.slice(first, end - first), every[first:end]
            number += 1


def _grams(texts: list[np.ndarray], order: int):
    """For each n up to order, the n-grams that end at the words with n - 1 before them, in order."""
    place = _places(np.array([len(w) for w in texts], np.int64))
    gram = words = mix(np.concatenate(texts)) if len(texts) else np.empty(0, np.uint64)
    for n in range(1, order + 1):
        if n > 1:  # named by the n-gram less its last word, and that
            gram = np.concatenate((gram[:1], mix(gram[:-1] + mix(words[1:]))))
        yield gram[place >= n - 1]


def _asked(parts: int, order: int, chunk_words: int):
    """Texts to the n-grams of their chunks: a row for each chunk, n and part."""

    def run(batches):
        for chunk, _, texts in _chunks(batches, 0, chunk_words):
            for n, gram in enumerate(_grams(texts, order), 1):
                grams, numbers, bounds = _distinct(gram, parts)
                has = np.flatnonzero(np.diff(bounds))
                edges = pa.array(np.append(np.array(bounds)[has], len(grams)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (grams.view(np.int64), numbers.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(np.full(len(has), chunk)), pa.array(np.full(len(has), n, np.int32)), *lists], names=["part", "chunk", "n", "grams", "numbers"])

    return run


def _listed(parts: int, order: int, chunk_words: int, keys: int):
    """Documents to chunks: a row with the chunk's documents (without texts), and their n-grams by number."""

    def run(batches):
        for chunk, rows, texts in _chunks(batches, keys, chunk_words):
            at = [x for gram in _grams(texts, order) for x in _named(gram, parts)]
            sizes = pa.array([len(w) for w in texts], pa.int64())
            docs = pa.StructArray.from_arrays([*rows.columns[:keys], sizes], fields=[*(rows.schema.field(i) for i in range(keys)), pa.field("n_words", pa.int64(), False)])
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.array([_pack(*at)], pa.binary())], names=["chunk", "docs", "at"])

    return run


def dealt(asked: DataFrame, tasks: int) -> DataFrame:
    """asked by part. Its keys are never null; said here, it is said alike on both sides of the join
    in `counted`, which then read one shuffle."""
    return asked.where("part is not null and chunk is not null and n is not null").repartition(tasks, "part")


def counted(asked: DataFrame) -> DataFrame:
    """(chunk, n, part, counts): of each n-gram that a chunk has, in its order there, how often all have it.
    asked: (part, chunk, n, grams, numbers)."""
    rows = asked.select("part", "chunk", "n", F.posexplode(F.arrays_zip("grams", "numbers")).alias("place", "g"))
    rows = rows.select("part", "chunk", "n", "place", F.col("g.grams").alias("gram"), F.col("g.numbers").alias("number"))
    # the first chunk is of no use but that both sides then read the same columns, so the same shuffle
    table = rows.groupBy("part", "n", "gram").agg(F.sum("number").alias("c"), F.min("chunk").alias("first"), F.min("place").alias("least"))
    found = rows.join(table.hint("shuffle_hash"), ["part", "n", "gram"]).where("number <= c and first <= chunk and least <= place")
    told = F.sort_array(F.collect_list(F.struct("place", "c")))
    return found.groupBy("part", "chunk", "n").agg(F.transform(told, lambda x: x["c"]).alias("counts"))


@contextmanager
def _joined_where_they_lie(spark):
    """Rows that are dealt by one of a join's keys are dealt well enough for it, and some thousand chunks
    may be gathered at once before they are sorted for that."""
    new = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096"}
    before = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _scores(sizes: np.ndarray, small: list[np.ndarray], told: list[np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray]:
    """Back-offs and summed logarithms of each text of a chunk. small: three arrays (see `_named`)
    for each n, of the n-grams that end at the words that have n - 1 before them."""
    log_n, log_b = int(_logs(np.array([total]))[0]) if total else 0, int(round(math.log(BACKOFF) * 1e6))
    place = _places(sizes)
    context = _counts_of(small[:3], told[0], len(place))  # of the (n-1)-gram that ends at each word
    value = _logs(context) - log_n
    backed = np.zeros(len(value), bool)
    for n in range(2, len(told) + 1):
        where = np.flatnonzero(place >= n - 1)
        c = _counts_of(small[3 * n - 3 : 3 * n], told[n - 1], len(where))
        seen = c >= MIN_COUNT
        value[where] += log_b
        value[where[seen]] = _logs(c[seen]) - _logs(context[where[seen] - 1])
        backed[where] = ~seen
        context = np.zeros(len(value), np.int64)
        context[where] = c
    upto = np.cumsum(sizes)
    add = lambda x: (s := np.concatenate(([0], np.cumsum(x, dtype=np.int64))))[upto] - s[upto - sizes]
    return add(backed), add(value)


def _scored(order: int, total: int):
    """Chunks with their counts (docs, at, told) to their documents with the sums."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                docs, told = b.column(0)[i].values, b.column(2)[i].values
                counts = [np.empty(0, np.int64)] * order
                if told is not None:
                    n = told.field("n").to_numpy()
                    for k in range(order):
                        counts[k] = told.filter(pa.array(n == k + 1)).field("counts").flatten().to_numpy()
                sizes = docs.field("n_words").to_numpy()
                backed, score = _scores(sizes, _unpack(b.column(1)[i].as_py()), counts, total)
                yield pa.RecordBatch.from_arrays([*docs.flatten(), pa.array(backed), pa.array(score)], names=[*(f.name for f in docs.type), "n_backoff", "score_micros"])

    return run


def _cut_up_alike(docs: DataFrame) -> bool:
    """Whether docs are rows of files, chosen and projected: Spark then deals them alike each time."""
    lines = docs._jdf.queryExecution().optimizedPlan().toString().strip().splitlines()
    return bool(docs.inputFiles()) and all(line.lstrip(" :+-").startswith(("Project ", "Filter ", "Relation ")) for line in lines)


def lm_scores(docs: DataFrame, text: str = "text", part_words: int = PART_WORDS, chunk_words: int = CHUNK_WORDS, order: int = ORDER) -> DataFrame:
    """docs without text, with n_words, n_backoff (words whose pair, or longest n-gram of up to
    `order` words, was too rare) and score_micros,
    the sum of the logarithms of S in millionths (long).

    Null and empty texts, and those of white space only, have no words and a score of 0. Rows that
    repeat count each and are scored each; keys may be null; an empty table gives an empty one. A text
    of more words than a chunk is a chunk by itself, and is scored whole. Columns of docs with these
    names are replaced.
    """
    spark, new = docs.sparkSession, ["n_words", "n_backoff", "score_micros"]
    rest = [c for c in docs.columns if c not in new and c != text]
    docs = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(text))
    if not _cut_up_alike(docs):
        docs = cut(docs, "documents")
    fields = [*docs.drop(text).schema, *(T.StructField(n, T.LongType(), False) for n in new)]
    total = count_words(docs, text)
    parts = max(1, -(-total // part_words))
    tasks = -(-parts // PARTS_A_TASK)
    asked = docs.select(text).mapInArrow(_asked(parts, order, chunk_words), "part int, chunk long, n int, grams array<long>, numbers array<int>")
    with _joined_where_they_lie(spark):
        counts = cut(counted(dealt(asked, tasks)), "counts")
    listed = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("docs", T.ArrayType(T.StructType(fields[:-2]))), T.StructField("at", T.BinaryType())])
    chunks = docs.mapInArrow(_listed(parts, order, chunk_words, len(rest)), listed).repartition(tasks, "chunk")
    told = counts.repartition(tasks, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("n", "part", "counts"))).alias("told"))
    return chunks.join(told, "chunk", "left").select("docs", "at", "told").mapInArrow(_scored(order, total), T.StructType(fields))
