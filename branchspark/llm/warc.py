"""Operator 9, WARC archives with a two-level capture index.

Tasks write their pages as gzip members of archive files in a shared folder and say where each
record lies; payloads aren't shuffled for it, but those that may be duplicates where there are too
many duplicates to tell all tasks. The captures' keys (reversed host first, the record's own place
last, so no two are equal) are sorted over the cluster into compressed blocks of lines; a sparse
directory holds the first key of each block. A lookup searches the directory, reads the one block,
searches it, and reads the one record. A directory that is too long to be held is itself kept in
such blocks, with a directory of its own, so what a task holds is bounded at any size. Whatever a
lost executor had written is left out: only the rows of attempts that ended name files, and
attempts never share one.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchspark.llm.common import broadcast_if_small, cut, join_unique, scratch_path

#: Bytes after which a task begins another archive; lines of a block of the index; blocks that the directory lists at most.
ARCHIVE_BYTES, BLOCK_LINES, ROOT_LINES = 1 << 30, 1_000, 20_000
#: Words of the bitmap of duplicates (2 MB).
WORDS = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURES = "page_id long, key string, archive string, offset long, length long"
_RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_key string"
_DIRECTORY = "first_key string, shard string, offset long, length long"


def surt(url: str | None) -> str:
    """The sort key of a URL: its host's labels reversed, then path and query."""
    m = re.match(r"(?s).*?://([^/?#]*)([^#]*)", url or "")
    if not m:
        return ")" + (url or "")
    return ",".join(reversed(m[1].lower().split("."))) + ")" + m[2]


def _escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def capture_key(url: str | None, page_id: int | None, record: str | None = None) -> str:
    """What a page's captures begin with; with a record's id, the key of that one."""
    return f"{_escaped(surt(url))} {'-' if page_id is None else f'{page_id:020d}'}{f' {record}' if record else ''}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def page_record(record_id: str, page_id, url, payload: bytes, digest: str, refers_to, refers_url) -> bytes:
    """The gzip member of a page: a response, or a revisit without payload."""
    headers = [("WARC-Record-ID", f"<urn:capture:{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _escaped(url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    headers += [("X-Page-ID", str(page_id))] if page_id is not None else []
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        return record("response", headers, http + payload)
    more = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _escaped(refers_url or "")), ("X-Refers-To-Page", str(refers_to)), ("X-Refers-To-Key", capture_key(refers_url, refers_to))]
    return record("revisit", headers + more, http)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record's gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _store(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else re.sub("^file:/+", "file:///", uri))
    return fs, path


class _Ranges:
    """Reads ranges of files; keeps the last file open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            fs, path = _store(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self):
        if self.file is not None:
            self.file.close()
        self.uri = self.file = None


def duplicates(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(digest, refers_to, refers_url): for each payload of at least min_bytes bytes that occurs
    more than once, its record with the smallest page_id."""
    digests = pages.select("page_id", "url", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    first = digests.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("page_id", "url")).alias("first"))
    return first.where("c > 1").select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))


def _with_duplicates(rows: DataFrame, dups: DataFrame) -> DataFrame:
    """rows with refers_to and refers_url of their digest. Duplicates that are too many to be told to
    all tasks are told as a bitmap of 64 * WORDS bits, of fixed size; only rows that it lets pass, and
    whose digest isn't a hot one, are shuffled."""
    if broadcast_if_small(dups, wide="refers_url") is not dups:
        return join_unique(rows, dups, "digest", "left", "refers_url")
    h = F.xxhash64("digest")
    word, bit = F.pmod(h, F.lit(WORDS)), F.shiftright(h, 58).bitwiseAND(F.lit(63)).cast("int")
    words = cut(dups.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits")), "words")
    marked = rows.withColumn("__word", word).join(F.broadcast(words), "__word", "left")
    marked = marked.withColumn("__may", F.coalesce(F.call_function("getbit", F.col("__bits"), bit) == 1, F.lit(False))).drop("__word", "__bits")
    other = marked.where("not __may").drop("__may")
    return join_unique(marked.where("__may").drop("__may"), dups, "digest", "left", "refers_url").unionByName(other, allowMissingColumns=True)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) under `folder`; returns the
    captures (page_id, key, archive, offset, length), themselves kept in shared storage.

    A null html is an empty payload, a null url an empty one. Of equal payloads of at least
    min_bytes bytes the record with the smallest page_id is the response (rows that repeat that
    page_id are responses too), the others revisit it; a row without page_id is a response. Each
    record has an id and a key of its own, whatever rows repeat.
    """
    dups = cut(duplicates(pages, min_bytes), "dups")
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
    rows = _with_duplicates(rows, dups)
    rows = rows.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("refers_to"), F.col("refers_to")).alias("refers_to"), "refers_url")

    def run(batches):
        fs, path = _store(folder)
        fs.create_dir(path, recursive=True)
        name, file, at = "", None, 0
        try:
            for b in batches:
                out = []
                for page_id, url, html, refers_to, refers_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if file is None or at >= archive_bytes:
                        if file is not None:
                            file.close()
                        archive = uuid.uuid4().hex
                        name = f"{archive}.warc.gz"
                        file, at = fs.open_output_stream(f"{path}/{name}", compression=None), 0
                        info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        file.write(info)
                        at = len(info)
                    payload = (html or "").encode()
                    record_id = f"{archive}:{at:013d}"
                    member = page_record(record_id, page_id, url, payload, payload_digest(payload), refers_to, refers_url)
                    file.write(member)
                    out.append((page_id, capture_key(url, page_id, record_id), f"{folder}/{name}", at, len(member)))
                    at += len(member)
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "key", "archive", "offset", "length"])
        finally:
            if file is not None:
                file.close()

    return cut(rows.mapInArrow(run, _CAPTURES), "captures")


def _write_blocks(lines: DataFrame, folder: str, block_lines: int) -> DataFrame:
    """Sort lines (key, line) by key into compressed blocks of files under `folder`; returns a row of
    the directory for each block."""

    def run(batches):
        fs, path = _store(folder)
        fs.create_dir(path, recursive=True)
        name, file, at, held, found = f"{uuid.uuid4().hex}.cdx.gz", None, 0, [], []

        def flush(some):
            nonlocal file, at
            if file is None:
                file = fs.open_output_stream(f"{path}/{name}", compression=None)
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            block = z.compress("\n".join(some).encode()) + z.flush()
            file.write(block)
            found.append((some[0].split("\t", 1)[0], f"{folder}/{name}", at, len(block)))
            at += len(block)

        try:
            for b in batches:
                for line in b.column(0).to_pylist():
                    held.append(line)
                    if len(held) == block_lines:
                        flush(held)
                        held = []
            if held:
                flush(held)
        finally:
            if file is not None:
                file.close()
        cols = list(zip(*found, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["first_key", "shard", "offset", "length"])

    ordered = lines.repartitionByRange("key").sortWithinPartitions("key").select("line")
    return cut(ordered.mapInArrow(run, _DIRECTORY), "directory")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, root_lines: int = ROOT_LINES) -> DataFrame:
    """The index of captures: blocks of lines under `folder`, and the directory (first_key, shard,
    offset, length, level), a row for each block. While it lists more than root_lines blocks, its
    rows are themselves put into blocks; level says how often that was done. An empty table of
    captures has an empty directory."""
    place = lambda d, *cols: d.select(F.col(cols[0]).alias("key"), F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)).alias("line"))
    directory, level = _write_blocks(place(captures, "key", "page_id", "archive", "offset", "length"), folder, block_lines), 0
    while directory.count() > root_lines:
        directory, level = _write_blocks(place(directory, "first_key", "shard", "offset", "length"), folder, block_lines), level + 1
    return directory.withColumn("level", F.lit(level))


def _lines(block: bytes) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(block, 31).decode().split("\n")]


def _place(line: list[str]) -> tuple[str, int, int]:
    return line[1], int(line[2]), int(line[3])


def _capture(line: list[str]) -> tuple:
    key, page_id, archive, offset, length = line
    return int(page_id) if page_id else None, key, archive, int(offset), int(length)


def _captures_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "key", "archive", "offset", "length"])


def _block_captures(batches):
    """The captures under blocks (shard, offset, length, level)."""
    ranges = _Ranges()

    def below(place, level):
        lines = _lines(ranges.read(*place))
        if level:
            for x in lines:
                yield from below(_place(x), level - 1)
        else:
            yield _captures_batch([_capture(x) for x in lines])

    for b in batches:
        for *place, level in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield from below(place, level)
    ranges.close()


def _searched(shipped):
    """Of each key the capture, by binary search in the directory and then in the blocks that it
    leads to; of a page's captures the last one, of a record's key that record."""

    def run(batches):
        firsts, places, level = shipped.value
        ranges, held = _Ranges(), {}

        def block(depth, place):
            if depth not in held or held[depth][0] != place:
                lines = _lines(ranges.read(*place))
                held[depth] = place, [x[0] for x in lines], lines
            return held[depth][1:]

        for b in batches:
            found = []
            for k in b.column(0).to_pylist():
                upto = k + "\x7f"  # after all keys that go on with a record's id
                at = bisect.bisect_right(firsts, upto) - 1
                if at < 0:
                    continue
                place = places[at]
                for depth in range(level, 0, -1):
                    names, lines = block(depth, place)
                    place = _place(lines[bisect.bisect_right(names, upto) - 1])
                names, lines = block(0, place)
                i = bisect.bisect_right(names, upto) - 1
                if names[i] == k or names[i].startswith(k + " "):
                    found.append(_capture(lines[i]))
            yield _captures_batch(found)
        ranges.close()

    return run


def _records(batches):
    """The records of captures (page_id, key, archive, offset, length), each read by its range."""
    ranges = _Ranges()
    for b in batches:
        out = []
        for archive, offset, length in sorted(zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)):
            headers, payload = parse(ranges.read(archive, offset, length))
            page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
            out.append((int(page) if page else None, headers["WARC-Type"], len(payload), payload_digest(payload), int(refers) if refers else None, headers.get("X-Refers-To-Key")))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "refers_key"])
    ranges.close()


def all_captures(directory: DataFrame) -> DataFrame:
    """The captures that the index lists, read block by block."""
    blocks = directory.select("shard", "offset", "length", "level").repartition(F.col("shard"), F.col("offset"))
    return blocks.mapInArrow(_block_captures, _CAPTURES)


def _search(directory: DataFrame, keys: DataFrame, key: str):
    rows = directory.orderBy("first_key").toArrow().to_pylist()  # at most ROOT_LINES
    shipped = directory.sparkSession.sparkContext.broadcast(([r["first_key"] for r in rows], [(r["shard"], r["offset"], r["length"]) for r in rows], rows[0]["level"] if rows else 0))
    wanted = keys.select(F.col(key).alias("key")).where("key is not null").distinct()
    return wanted.repartitionByRange("key").sortWithinPartitions("key"), _searched(shipped)


def lookup(directory: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The captures of the distinct non-null keys: binary search in the directory, then in the
    block it names. A key is a record's own (see `write_archives`) or a page's (`capture_key`), which
    finds the last of the page's captures; keys that the index lacks give no row."""
    wanted, search = _search(directory, keys, key)
    return wanted.mapInArrow(search, _CAPTURES)


def read_named(directory: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Look up the distinct keys (see `lookup`) and read their records, in the same tasks: page_id,
    record_type, the length and digest of the payload that the record holds (a revisit holds none),
    and what a revisit refers to."""
    wanted, search = _search(directory, keys, key)
    return wanted.mapInArrow(lambda batches: _records(search(batches)), _RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives with their index, look up each record's key in the index and read the
    record, and give page_id, payload_bytes, payload_digest, record_type and refers_to of each. The
    payload of a revisit is that of the record it names, looked up in the index and read again.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, min_bytes)
    directory = build_index(captures, folder)
    records = cut(read_named(directory, captures), "records")
    revisits = records.where("record_type = 'revisit'")
    named = read_named(directory, revisits, "refers_key").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"))
    named = cut(named.dropDuplicates(["refers_to"]), "named")
    full = join_unique(revisits, named, "refers_to", "left").select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to")
    return records.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").union(full)
