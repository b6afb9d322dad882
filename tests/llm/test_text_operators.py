"""Operators 1, 2, 6, 7 and 10 against libraries, brute force and held-out accuracy."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from branchspark.llm import bpe_codec, language_id, lm_score, quality, token_counts
from branchspark.llm.bpe_codec import Codec
from branchspark.llm.common import WordHash
from branchspark.llm.token_counts import Counter as TokenCounter
from branchspark.llm.token_counts import _loaded

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
EDGES = [None, "", " ", "\n\n", "a", "aaaaaaaaaaaaaaaaaaaa", "The the\tthe", "<|endoftext|>x<|endoftext|>", "<|startoftext|> Hi", "ΑΣ Straße İ", "é é", "\x00\x1c \x85　", "x" * 5000, "ab " * 20000, "😀👍🏽", "it's 1234 we'll"]


def odd_texts(n, seed=0):
    rnd = random.Random(seed)
    alphabet = ["a", "A", "é", "Σ", "İ", " ", "  ", "\n", "\t", "\x1f", "\xa0", "'s", "'LL", "1", "½", "中", "😀", "<|endoftext|>", "<|", "%", "***", "the", "aaaa", "\x00", "_", "ing"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def library(path, texts):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)], t


def test_token_counts_are_the_librarys():
    texts = EDGES + odd_texts(1500)
    assert TokenCounter(_loaded(BYTE)).counts(texts).tolist() == [len(x) for x in library(BYTE, texts)[0]]


def test_codec_is_the_librarys():
    texts = EDGES + odd_texts(1500, 1)
    want, t = library(WORD, texts)
    codec = Codec(bpe_codec.loaded(WORD))
    got = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [codec.decode(x) for x in got] == [t.decode(x, skip_special_tokens=False) for x in want]


def test_codec_cuts_all_of_unicode_as_the_library_does():
    codec, tok = Codec(bpe_codec.loaded(WORD)), library(WORD, [])[1]
    rnd = random.Random(3)
    points = [chr(x) for x in [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 31)]]
    marks = [c for c in points if unicodedata.combining(c)]
    texts = [f"a{c}b" for c in points]
    texts += ["".join(rnd.choice(marks if rnd.random() < 0.4 else points if rnd.random() < 0.5 else "aeΣ Skا") for _ in range(rnd.randint(1, 12))) for _ in range(20_000)]
    for k in range(0, len(texts), 20_000):
        some = texts[k : k + 20_000]
        want = [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]
        wrong = [ascii(t) for t, got, ids in zip(some, codec.encode(some), want, strict=True) if np.frombuffer(got, "<u4").tolist() != ids]
        assert not wrong


def test_long_words_are_not_remembered():
    codec, counter = Codec(bpe_codec.loaded(WORD)), TokenCounter(_loaded(BYTE))
    texts = ["q" * 3000 + " end", "b64" * 50 + "é" * 90]
    codec.encode(texts), counter.counts(texts)
    assert codec.ids and max(map(len, codec.ids)) <= bpe_codec.REMEMBERED_CHARS
    assert counter.known and max(map(len, counter.known)) <= token_counts.REMEMBERED_CHARS
    words = WordHash(10)
    words.array([b"x" * 65, b"short"])
    assert list(words) == [b"short"]


def test_pair_index_applies_a_sooner_pair_first():
    # merging b+c makes a pair of a lower rank; it goes before the other places of b+c
    names = ["a", "b", "c", "bc", "abc"]
    v = {"id": "x", "left": np.array([0, 1]), "right": np.array([3, 2]), "made": np.array([4, 3]), "strings": names, "bytes": np.array([0] * 97 + [0, 1, 2] + [0] * 156), "ends": np.full(256, -1), "special": {}}
    assert bpe_codec.PairIndex(v).encode([b"abcbc", b"bcabc"]) == [[4, 3], [3, 4]]


def test_token_and_codec_queries_keep_rows_and_columns(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(EDGES)] + [(None, "x", 7), (3, "same", 7), (3, "same", 7)], "doc_id long, text string, n_tokens int")
    out = token_counts.count_tokens(df, BYTE)
    assert out.columns == ["doc_id", "text", "n_tokens"] and out.count() == len(EDGES) + 3
    coded = bpe_codec.decode(bpe_codec.encode(df, WORD), WORD)
    want = library(WORD, [r["text"] for r in coded.collect()])[0]
    assert [np.frombuffer(r["token_ids"], "<u4").tolist() for r in coded.collect()] == want
    digests = {(r["doc_id"], r["text"]): r["ids_sha256"] for r in bpe_codec.encode_digests(df, WORD).collect()}
    assert digests[None, "x"] == hashlib.sha256(np.array(library(WORD, ["x"])[0][0], "<u4").tobytes()).hexdigest()
    assert token_counts.count_tokens(df.limit(0), BYTE).count() == 0 and bpe_codec.encode(df.limit(0), WORD).count() == 0


def brute_lm(texts):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    one, two = Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(d, d[1:], strict=False))
    log = lambda x: round(math.log(x) * 1e6)
    n = sum(one.values())
    out = []
    for d in docs:
        score = log(one[d[0]]) - log(n) if d else 0
        backed = 0
        for p in zip(d, d[1:], strict=False):
            if two[p] >= lm_score.MIN_COUNT:
                score += log(two[p]) - log(one[p[0]])
            else:
                score, backed = score + log(lm_score.BACKOFF) + log(one[p[1]]) - log(n), backed + 1
        out.append((len(d), backed, score))
    return out


@pytest.mark.parametrize("part_words", [lm_score.PART_WORDS, 300])
def test_lm_scores(spark, part_words):
    rnd = random.Random(3)
    words = ["the"] * 40 + [f"w{i}" for i in range(60)] + ["É", "Z"]
    texts = [*EDGES[:7], "x" * 5000, "ab " * 2000] + [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(150)] + ["the same text twice"] * 20
    df = spark.createDataFrame([(i if i % 9 else None, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    got = lm_score.lm_scores(df.withColumn("t", df["text"]), part_words=part_words)
    assert got.columns == ["doc_id", "t", "n_words", "n_backoff", "score_micros"]
    want = Counter((t, *x) for t, x in zip(texts, brute_lm(texts), strict=True))
    assert Counter((r["t"], r["n_words"], r["n_backoff"], r["score_micros"]) for r in got.collect()) == want
    assert lm_score.lm_scores(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["of the", "tick " * 50])
def test_lm_parts_are_bounded_whatever_a_pair_repeats(monkeypatch, text):
    # all of the corpus is one pair (and its turn): what a part gets grows with chunks, not with occurrences
    class Task:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(lm_score.TaskContext, "get", staticmethod(Task))
    batches = [pa.RecordBatch.from_arrays([pa.array([f"{text} {text}"] * 400)], names=["text"]) for _ in range(20)]
    entries = Counter()
    for b in lm_score._asked(8, 2, 10**6)(batches):
        for part, grams in zip(*(b.column(n).to_pylist() for n in ("part", "grams")), strict=True):
            entries[part] += len(grams)
    assert max(entries.values()) <= 20 * 4


def test_lm_plan_joins_where_the_rows_lie(spark):
    """One shuffle feeds the n-gram table, the count table and their join."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    asked = df.mapInArrow(lm_score._asked(4, 2, 1000), "part int, chunk long, n int, grams array<long>, numbers array<int>")
    with lm_score._joined_where_they_lie(spark):
        found = lm_score.counted(lm_score.dealt(asked, 4))
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("== Initial Plan ==")]
    assert len(re.findall(r"- Exchange hashpartitioning", plan)) == 1 and "ReusedExchange" in plan
    assert re.search("(SortMerge|ShuffledHash|BroadcastHash)Join", plan) and "Generate posexplode" in plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_lm_documents_that_are_not_files_are_stored_first(spark):
    files = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id > 3").select("doc_id", "text")
    assert lm_score._cut_up_alike(files) and not lm_score._cut_up_alike(files.repartition(3))
    assert not lm_score._cut_up_alike(files.distinct()) and not lm_score._cut_up_alike(spark.createDataFrame([("a",)], "text string"))


def test_words_are_counted_alike(spark):
    df = spark.createDataFrame([(t,) for t in EDGES + odd_texts(300)], "text string")
    assert lm_score.count_words(df) == sum(len(t.encode().split()) for t in EDGES + odd_texts(300) if t)


@pytest.mark.parametrize("chunk_words", [1, 50])
def test_lm_scores_of_small_chunks(spark, chunk_words):
    rnd = random.Random(4)
    texts = [None, "", "a", "of the " * 300] + [" ".join(rnd.choice(["of", "the", "Of", "x", "y", f"w{rnd.randrange(90)}"]) for _ in range(rnd.randint(0, 30))) for _ in range(80)]
    got = lm_score.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), part_words=200, chunk_words=chunk_words)
    assert sorted((r["doc_id"], r["n_words"], r["n_backoff"], r["score_micros"]) for r in got.collect()) == [(i, *x) for i, x in enumerate(brute_lm(texts))]


def test_lm_scores_with_trigrams(spark):
    rnd = random.Random(6)
    docs = [[rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 25))] for _ in range(60)]
    count = Counter(tuple(d[i : i + n]) for d in docs for n in (1, 2, 3) for i in range(len(d) - n + 1))
    log = lambda x: round(math.log(x) * 1e6)
    total = sum(map(len, docs))
    want = []
    for i, d in enumerate(docs):
        score = backed = 0
        for k in range(len(d)):
            n = longest = min(3, k + 1)
            while n > 1 and count[tuple(d[k - n + 1 : k + 1])] < lm_score.MIN_COUNT:
                n -= 1
            gram = tuple(d[k - n + 1 : k + 1])
            score += (longest - n) * log(lm_score.BACKOFF) + log(count[gram]) - log(count[gram[:-1]] if n > 1 else total)
            backed += n < longest
        want.append((i, len(d), backed, score))
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = lm_score.lm_scores(df, part_words=300, order=3)
    assert sorted((r["doc_id"], r["n_words"], r["n_backoff"], r["score_micros"]) for r in got.collect()) == want


def test_base_counts_by_brute_force():
    rnd = random.Random(5)
    texts = EDGES + ["".join(rnd.choice(["a ", "b ", "c#", "\n", " ", "a b c ", "é\t"]) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {i + j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality.base_counts(t) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))


def test_quality_learns_the_target(spark):
    rnd = random.Random(1)
    good = [" ".join(rnd.choice(["ox", "cat", "dog", "the", "ran"]) + str(rnd.randrange(40)) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(f"{rnd.randrange(900)} | ###" for _ in range(60)) for _ in range(30)]
    rows = [(i, t, "src") for i, t in enumerate(good + bad + EDGES)] + [(None, good[0], "s"), (5, good[5], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(61, 0), (3, 0), (None, 1)], "doc_id long, quality int")
    out = quality.judge(df, quality.fit(df, quality.target_ids(labels))).collect()
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert kept == {*range(60), None} and len(out) == len(rows)
    assert quality.judge(df.limit(0), np.zeros(quality.BUCKETS, np.int64)).count() == 0
    # no label, no verdict but that of the base rules
    none = quality.fit(df, quality.target_ids(labels.limit(0)))
    assert not none.any() and quality.judge(df, none).where("kept").count() == sum(1 for _, t, _ in rows if (c := quality.base_counts(t))[0] >= 50 and 2 * c[4] <= c[0])


def test_language_of_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    p = language_id.learn(d.where(~held))
    said = language_id.predict(d.where(held).select("text", F.col("lang").alias("is")), p).collect()
    assert sum(r["is"] == r["lang_pred"] for r in said) >= 0.97 * len(said)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "123 !"), (3, "der die und"), (3, "der die und")], "doc_id long, text string")
    got = [(r["lang_pred"], 0 <= r["score"] <= 1) for r in language_id.predict(odd, p).orderBy("doc_id").collect()]
    assert got == [("und", True), ("und", True), ("und", True), ("de", True), ("de", True)]
    empty = language_id.learn(d.limit(0))
    assert language_id.predict(odd, empty).where("lang_pred = 'und'").count() == 5
    assert language_id.learn(d.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))).langs == []


def brute_grams(text):
    """Of each n-gram the number, by plain strings; named by the same packing, which orders ties."""
    s = " " + re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0][0].isalpha() else " ", text.lower(), flags=re.S)
    s = " " + " ".join(s.split()) + " "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if " " not in g[1:-1] and g.strip() and len(s) > 2:
                out[sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(g))] += 1
    return out


def brute_ranks(counts, most):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


@pytest.mark.parametrize("piece", [language_id.PIECE, 7])
def test_grams_by_brute_force(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    rnd = random.Random(9)
    texts = ["", "a", "1 2", "Añb c'est  l'été\n\nq", "x" * 50, "ab1cd_ef"] + ["".join(rnd.choice("abcéñ 1.\n") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    for t in texts:
        keys, counts = language_id.gram_counts(t)
        want = brute_grams(t)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want
        for most in (5, 300):
            assert language_id.ranked(keys, counts, most).tolist() == brute_ranks(want, most)


def test_language_query_by_brute_force(spark, tmp_path):
    """The registered query on a small table: learning, folds and predictions by plain Python."""
    import zlib

    from branchspark.llm import queries

    rnd = random.Random(11)
    alphabets = {"aa": "abcde ", "bb": "cdefg ", "cc": "éabxy  "}
    rows = [(i, "".join(rnd.choice(alphabets[x]) for _ in range(rnd.randint(0, 80))), x) for i in range(240) for x in [rnd.choice(list(alphabets))]]
    rows += [(None, "abc", "aa"), (500, None, "bb"), (501, "12 !", "cc"), (502, "abc abc", None), (3, "xxyy", "cc"), (3, "xxyy", "cc")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    learned = {}
    for i, t, x in rows:
        if not held(i) and t is not None and x is not None:
            learned.setdefault(x, Counter()).update(brute_grams(t))
    profiles = {x: brute_ranks(c, language_id.PROFILE) for x, c in learned.items()}
    want = []
    for i, t, _ in rows:
        top = brute_ranks(brute_grams(t or ""), language_id.PROFILE)
        if not top:
            want.append((i, held(i), "und", 0.0))
            continue
        far = {x: sum(abs(p.index(g) - k) if g in p else language_id.PROFILE for k, g in enumerate(top)) for x, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want.append((i, held(i), best, 1 - far[best] / (language_id.PROFILE * len(top))))
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in queries.op7_language_id(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(spark.createDataFrame([(i, "abc", f"l{i}") for i in range(3)], "doc_id long, text string, lang string"))


def test_rank_distance_by_brute_force():
    profiles = {"a": np.array([5, 3, 9], np.uint64), "b": np.array([9, 5], np.uint64)}
    p = language_id.Profiles(profiles)
    text = "banana bandana"
    top = language_id.ranked(*language_id.gram_counts(text)).tolist()
    profiles["c"] = np.array(top[:4][::-1], np.uint64)
    p = language_id.Profiles(profiles)
    far = lambda lang: sum(abs(profiles[lang].tolist().index(g) - i) if g in profiles[lang].tolist() else language_id.PROFILE for i, g in enumerate(top))
    lang, score = p.predict(text)
    assert lang == min(profiles, key=far) == "c" and score == 1 - far("c") / (language_id.PROFILE * len(top))
