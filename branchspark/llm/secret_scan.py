"""Operator 4, secret scans, in SQL functions only.

Three patterns find known kinds of secrets. Beside them, candidate strings (runs of a
character class) are scanned with a sliding window: the counts of the class's characters are kept
from step to step and change by the one character that enters and the one that leaves, so the sum
of c * log2(c) over the window's characters follows by lookups in a table, in whole millionths of a
bit; the window of the highest Shannon entropy decides. An allow-list takes candidates out first.
Everything is one narrow projection, whose work grows with a text's length and n * log(n) of its n
matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchspark.llm.common import aside

#: Kind, pattern, group whose length counts (0: all of it), least length. Kinds are listed in this order.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 18 or 16 characters is what the longest match of at least as many is: nothing shorter takes any of it.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
WIDTH = 20
#: Character classes: kind, pattern of a candidate, least entropy of its best window in millionths of a bit a character.
CLASSES = [("entropy_hex", r"[0-9A-Fa-f]{20,}", 3_000_000), ("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", 3_800_000)]
#: All characters of the classes.
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Counts kept in one number, and the bits of each.
PER_WORD, BITS = 12, 5
#: Candidates that are no secrets: words, numbers, UUIDs, alphabets, placeholders, paths of words; and for the second class what is of the first.
ALLOW = r"^[A-Za-z_=-]+$|^[0-9_=-]+$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|0123456789|abcdefghij|ABCDEFGHIJ|[eE][xX][aA][mM][pP][lL][eE]|[pP][lL][aA][cC][eE][hH][oO][lL][dD][eE][rR]|[cC][hH][aA][nN][gG][eE][mM][eE]|[xX]{8}|^/?([A-Za-z]+[/_-])+[A-Za-z]+$"
#: Where a candidate is cut for `scan` by pieces, and pieces that are no secrets: of one case, camel case, numbers.
CUTS = r"[/_=-]|0123456789|abcdefghij|ABCDEFGHIJ|[eE][xX][aA][mM][pP][lL][eE]|[pP][lL][aA][cC][eE][hH][oO][lL][dD][eE][rR]|[cC][hH][aA][nN][gG][eE][mM][eE]|[xX]{8}"
PLAIN = r"^[A-Z]+$|^[a-z]*([A-Z][a-z]{2,})*$|^[0-9]+$"
ONLY_HEX = r"^[0-9A-Fa-f]+$"
KINDS = ["assign", "access", "hex", *(k for k, _, _ in CLASSES)]
#: c * log2(c) in millionths, for counts in a window
TERMS = [round(c * math.log2(c) * 1e6) if c else 0 for c in range(WIDTH + 1)]
_SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, combine) -> Column:
    """The running totals of an array under an associative function, in log2(n) passes over it."""
    powers = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda p: p < F.size(values))
    return F.aggregate(powers, values, lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, combine(x, F.element_at(acc, i - p + 1))).otherwise(x)))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, found, part): the leftmost non-overlapping matches, in code points.
    The pieces between the matches give the places."""

    def placed(found):
        part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        sizes = F.zip_with(gaps, found, lambda g, x: F.char_length(g) + F.char_length(x))
        rows = F.arrays_zip(_let(sizes, lambda n: _running(n, lambda x, y: x + y)).alias("end"), found.alias("found"), part.alias("part"))
        return F.transform(rows, lambda x: F.struct((x["end"] - F.char_length(x["found"])).alias("start"), x["end"].alias("end"), x["found"].alias("found"), x["part"].alias("part")))

    none = F.array().cast("array<struct<start:int,end:int,found:string,part:string>>")
    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def best_entropy(candidate: Column) -> Column:
    """The highest entropy of a window of WIDTH characters, times WIDTH, in millionths. The counts of
    the window's characters are the fold's state, PER_WORD of them in each number of an array."""
    terms = F.array(*(F.lit(t).cast("long") for t in TERMS))
    term = lambda c: F.element_at(terms, c + 1)
    words = -(-len(ALPHABET) // PER_WORD)
    ones = F.array(*(F.lit(1 << BITS * k).cast("long") for k in range(PER_WORD)))

    def folded(codes):
        word = lambda c: F.floor(c / PER_WORD).cast("int")
        one = lambda c: F.element_at(ones, c % PER_WORD + 1)
        count = lambda counts, c: F.call_function("shiftright", F.element_at(counts, word(c) + 1), (c % PER_WORD) * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

        def step(acc, i):
            full = i > WIDTH
            enters, leaves = F.element_at(codes, i), F.element_at(codes, F.greatest(i - WIDTH, F.lit(1)))
            less = F.when(full, count(acc["counts"], leaves)).otherwise(0)
            had = count(acc["counts"], enters) - F.when(full & (enters == leaves), 1).otherwise(0)
            counts = F.transform(acc["counts"], lambda w, k: w + F.when(k == word(enters), one(enters)).otherwise(0) - F.when(full & (k == word(leaves)), one(leaves)).otherwise(0))
            total = acc["sum"] + F.when(full, term(less - 1) - term(less)).otherwise(0) + term(had + 1) - term(had)
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when(i >= WIDTH, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

        begin = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(1 << 60).cast("long").alias("least"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), begin, step, lambda acc: F.lit(TERMS[WIDTH]).cast("long") - acc["least"])

    return _let(F.transform(F.split(candidate, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1), folded)


def _spans(found: Column, kind: str, keep) -> Column:
    span = lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    return F.transform(F.filter(found, keep), span).cast(f"array<{_SPAN}>")


def _random_enough(allowed: str, least: int):
    """The test of a candidate; the fold runs only where the allow-list lets it."""
    return lambda x: F.when(x["found"].rlike(allowed), F.lit(False)).otherwise(best_entropy(x["found"]) >= least * WIDTH)


def _random_piece(plain: str, least: int):
    """Whether a piece of a candidate, between words of the allow-list and separators, is random enough."""
    long = lambda p: (F.char_length(p) >= WIDTH) & ~p.rlike(plain)
    return lambda x: F.exists(F.filter(F.split(x["found"], CUTS, -1), long), lambda p: best_entropy(p) >= least * WIDTH)


def _either(a, b):
    return lambda x: a(x) | b(x)


def scan(docs: DataFrame, text: str = "text", pieces: bool = False) -> DataFrame:
    """docs with base_spans and spans: arrays of (start, rank, end, kind) by start, then kind as
    listed in KINDS; places are code points, the end exclusive. spans holds the base ones too.
    With pieces, a candidate that the allow-list takes out counts all the same where a piece of it,
    beside the harmless words, is random enough.

    A null or empty text has none; one of any length is scanned whole. Keys may be null, rows repeat, the
    table be empty: each row stands for itself. Spans may overlap; those that begin together go by kind. Columns of docs with these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(
        _spans(_matches(t, ASSIGN, 2), "assign", lambda x: F.char_length(x["part"]) >= 12),
        _spans(_matches(t, ACCESS), "access", lambda x: F.lit(True)),
        _spans(_matches(t, HEX), "hex", lambda x: F.lit(True)),
    )
    more = []
    for kind, pattern, least in CLASSES:
        also = "" if kind == "entropy_hex" else f"|{ONLY_HEX}"
        whole, piece = _random_enough(ALLOW + also, least), _random_piece(PLAIN + also, least)
        more.append(_spans(_matches(t, pattern), kind, _either(whole, piece) if pieces else whole))
    out = docs.withColumn("base_spans", F.sort_array(base))
    return out.withColumn("spans", F.sort_array(F.concat("base_spans", *more)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Scanned docs (see `scan`) with each run of overlapping spans replaced by `mark`; a text
    without spans, or null, stays as it is."""
    source = F.col(text)

    def pieces(chars, upto):
        part = lambda a, z: F.array_join(F.slice(chars, a + 1, z - a), "")
        before = lambda i: F.when(i > 0, F.element_at(upto, i)).otherwise(0)
        shown = F.transform("spans", lambda x, i: F.when(x["start"] >= before(i), F.concat(part(before(i), x["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(shown, ""), part(F.element_at(upto, -1), F.size(chars)))

    ends = F.transform("spans", lambda x: x["end"])
    done = _let(F.split(source, ""), lambda chars: _let(_let(ends, lambda e: _running(e, F.greatest)), lambda upto: pieces(chars, upto)))
    return docs.withColumn(text, F.when(F.size("spans") > 0, done).otherwise(source))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their secrets redacted and n_chars as it is then, other columns as they were. Rows
    without doc_id or text, and rows that repeat, stand for themselves."""
    rows, back = aside(docs, ("base_spans", "spans"))
    clean = redact(scan(rows, pieces=True))
    return back(clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))))
