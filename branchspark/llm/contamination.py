"""Operator 3, benchmark decontamination, by a prefix-filtered set join.

An item's windows are WINDOW consecutive words; a window's set is its SHINGLE-word shingles.
A document holds a window only if it holds all of them, so it must hold the rarest one: that
is the window's necessary prefix. One scan of the documents keeps the runs of words whose
shingles pass a bitmap of fixed size of all benchmark shingles (1 bit in BITS, whatever the
benchmark's size). The runs' shingles are counted for the order of rarity and joined to the
prefixes, bounds on length and position drop what can't fit, and the words themselves are
compared over the whole window. Only runs are shuffled, never texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchspark.llm.common import aside, broadcast_if_small, cut, hashed_words, shingle_hashes, slices, table, word_hashes

WINDOW, SHINGLE = 10, 5
#: Bits of the bitmap, 4 MB: more shingles make it less selective, not larger.
BITS = 1 << 25

#: Each byte of a word, in lower case; all others are a blank. Fixed: ASCII digits, letters, and all that isn't ASCII.
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("words", T.StringType())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id string, window, n, shingles, hashes): the distinct windows of each item."""

    def run(batches):
        for b in batches:
            out = set()
            for item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = words_of(text)
                n = min(window, len(w))
                out.update((item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n)
            rows = [(i, b" ".join(w).decode(), len(w), [b" ".join(w[j : j + k]).decode() for j in range(len(w) - k + 1)], shingle_hashes(word_hashes([list(w)])[0], k).astype(np.int64).tolist()) for i, w in sorted(out) for k in (min(shingle, len(w)),)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["item_id", "window", "n", "shingles", "hashes"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id string, window string, n int, shingles array<string>, hashes array<long>").distinct()


def bitmap(windows: DataFrame) -> np.ndarray:
    """The bits of all shingles' hashes, BITS / 8 bytes at most."""
    bit = F.col("h").bitwiseAND(F.lit(BITS - 1))
    parts = windows.select(F.explode("hashes").alias("h")).groupBy(F.floor(bit / 32768).alias("part")).agg(F.bitmap_construct_agg(bit % 32768).alias("bits"))
    out = np.zeros((BITS // 32768, 4096), np.uint8)
    for r in parts.toArrow().to_pylist():  # at most BITS / 32768 rows of 4 KB
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def find_runs(docs: DataFrame, bits: np.ndarray, least: dict[int, int], text: str = "text") -> DataFrame:
    """docs without text, with n_words and runs: where (word number), k and words of each run
    whose k-word shingles are all in the bitmap; `least` has the words a run needs, by k."""
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([*docs.select(*rest).schema, T.StructField("n_words", T.LongType()), T.StructField("runs", _RUNS)])
    shipped = docs.sparkSession.sparkContext.broadcast(bits)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("k", pa.int32()), ("words", pa.string())]))

    def run(batches):
        bits = shipped.value
        for b in slices(batches):
            counts, runs = [], []
            texts = b.column(len(rest)).to_pylist()
            for t, h in zip(texts, hashed_words(texts, words_of), strict=True):
                counts.append(len(h))
                found, w = [], None
                for k, need in least.items():
                    if len(h) < need:
                        continue
                    s = shingle_hashes(h, k) & np.uint64(BITS - 1)
                    hit = (bits[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8)))
                    for first, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        if end - first + k - 1 >= need:
                            w = w or words_of(t)
                            found.append({"start": first, "k": k, "words": b" ".join(w[first : end + k - 1]).decode()})
                runs.append(found)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64()), pa.array(runs, kind)], names=[*rest, "n_words", "runs"])

    return docs.select(*(F.col(f"`{c}`") for c in rest), F.col(text)).mapInArrow(run, schema)


def _occurrences(runs: DataFrame) -> DataFrame:
    """A row for each shingle of each run: row, pos (word number), shingle, and the words around
    it that a window may take (`before` of them in front)."""
    w = F.split("words", " ")
    out = runs.select("row", "start", "k", w.alias("w")).select("*", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("i"))
    before = F.least(F.col("i"), F.lit(WINDOW) - F.col("k"))
    return out.select("row", (F.col("start") + F.col("i")).alias("pos"), F.array_join(F.slice("w", F.col("i") + 1, F.col("k")), " ").alias("shingle"), before.alias("before"), F.slice("w", F.col("i") - before + 1, before + F.lit(WINDOW)).alias("around"))


def prefixes(windows: DataFrame, seen: DataFrame) -> DataFrame:
    """(shingle, at, window, n): each distinct window's rarest shingle and its place; seen has the
    number of each shingle in the documents. A window with a shingle that no run has can't occur."""
    s = windows.select("window", "n", "shingles").distinct().select("window", "n", F.posexplode("shingles").alias("at", "shingle"))
    s = s.join(broadcast_if_small(seen), "shingle", "left")
    least = s.groupBy("window", "n").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "shingle", "at")).alias("p"))
    return least.where("p.seen > 0").select(F.col("p.shingle").alias("shingle"), F.col("p.at").alias("at"), "window", "n")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with n_words, n_hit (words inside any window of an item that occurs),
    n_items, item_ids (sorted as strings) and contaminated.

    A null or empty text has no words. An item with fewer words than WINDOW is one window; one
    without words, text or id has none. Rows that repeat, or share a key, are judged each. Texts of any
    length are judged whole. Of a window's equally rare shingles the smallest is its prefix. Without
    items nothing is hit. Columns of docs with these names are replaced.
    """
    windows = cut(item_windows(benchmark), "windows")
    sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most WINDOW numbers
    least = {min(SHINGLE, n): n for n in reversed(sizes)}
    new = ["n_words", "runs", "n_hit", "n_items", "item_ids", "contaminated", "row"]
    kept = [c for c in docs.columns if c not in new and c != text]
    numbered = docs.select(*(F.col(f"`{c}`") for c in kept), F.monotonically_increasing_id().alias("row"), F.col(text))
    base = cut(find_runs(numbered, bitmap(windows), least, text), "runs")

    occurrences = _occurrences(base.where(F.size("runs") > 0).select("row", F.explode("runs").alias("r")).select("row", "r.*"))
    seen = cut(occurrences.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen")), "seen")
    prefix = cut(prefixes(windows, seen), "prefix")
    found = occurrences.join(broadcast_if_small(prefix), "shingle")
    found = found.where((F.col("at") <= F.col("before")) & (F.col("before") - F.col("at") + F.col("n") <= F.size("around")))
    found = found.where(F.array_join(F.slice("around", F.col("before") - F.col("at") + 1, F.col("n")), " ") == F.col("window"))
    hits = cut(found.select("row", (F.col("pos") - F.col("at")).alias("pos"), "n", "window"), "hits")

    spans = F.sort_array(F.collect_set(F.struct("pos", (F.col("pos") + F.col("n")).alias("end"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    covered = F.aggregate(spans, start, lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["pos"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")))["n"]
    owners = windows.select("window", "item_id")
    items = hits.select("row", "window").distinct().join(broadcast_if_small(owners), "window").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    marks = hits.groupBy("row").agg(covered.alias("n_hit")).join(items, "row", "left")
    out = base.drop("runs").join(marks, "row", "left").drop("row")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    return out.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no window of an item, with the columns of docs as they were. A row goes by its
    doc_id and text, so others that share its doc_id stay, and rows that repeat go or stay together."""
    key = F.struct(F.col("doc_id"), F.xxhash64("text"))
    judged = contamination(docs.select("text", key.alias("key")), table(spark, sf_dir, "benchmark"))
    bad = cut(judged.where("contaminated").select(F.col("key").alias("__key")).distinct(), "contaminated")
    rows, back = aside(docs, ("__key",))
    return back(null_safe(rows.withColumn("__key", key), broadcast_if_small(bad)))


def null_safe(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """rows whose __key isn't in bad, null doc_ids being equal."""
    return rows.join(bad.withColumnRenamed("__key", "__bad"), F.col("__key").eqNullSafe(F.col("__bad")), "left_anti")
