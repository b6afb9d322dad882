"""Operator 5, near-duplicates, by a chosen-path set similarity join over minwise tokens.

1. One scan turns each text into its set of word shingles: a digest of the set and a signature
   of COORDINATES minwise tokens. Texts with equal sets are one class, held by its smallest id.
2. TREES independent trees branch the classes: a root branches by one minwise token, a node with
   more than LEAF classes by two tokens that its path selects, as many ways as the target recall
   asks for (`ways_for`). Before it branches, a large node is compared with its smallest member:
   what is `sure` to be alike leaves the node and is linked to that member, as is all that may be
   linked to what leaves. Small nodes are compared exhaustively, by signature.
3. The candidates' connected components are coarse groups. Their members' full sets go to their
   group, where links are confirmed on the sets; groups that are too large for a task are searched
   in parts (see `_large_groups`). Only a spanning forest of links comes out.
4. Connected components over the confirmed links give each class its smallest id.

Recall. Links are confirmed on full sets, so none is wrong; one can be lost in two ways:

* two sets at the threshold agree in fewer than `coarse` of the 128 coordinates: 1e-10 or less at
  0.85 or 0.80. Equal coordinates obey the triangle inequality (x and y differ in no more
  coordinates than x and p, and p and y, together), so a pair that reaches `coarse` isn't lost when
  one of its sets leaves a node and the other stays;
* no tree keeps them together: they share a root with probability s in each, so all of 12 trees
  miss a pair at 0.85 with 1e-10, where roots are small. Below roots that are large because
  many documents share a passage, a tree keeps a pair with a chance that falls slowly by level;
  the ways are as many as RECALL asks for after DEPTH such levels, for a pair exactly at the
  threshold that no third document links.

Shingles are hashed (see `common.word_hashes`), so sets are equal up to collisions of hashes.
No pair within a group is ever emitted in full, and no group meets in one task.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchspark.llm.common import aside, broadcast_if_small, cut, hashed_words, join_unique, lower_words, mix, shingle_hashes, slices
from branchspark.llm.components import connected_components

COORDINATES, TREES, LEAF = 128, 12, 256
#: What trees find of pairs at the threshold that large nodes part, and the levels of such nodes.
RECALL, DEPTH = 0.99, 10
#: Classes, and bytes of sets, of a coarse group that a task holds, or of a block of a larger one.
BLOCK_CLASSES, BLOCK_BYTES = 2_048, 48 << 20
#: Shingles hashed at once, and the most bits of the second scan's filter (128 MB; it has 16 for each member).
CHUNK, FILTER_BITS = 200_000, 1 << 30

_draw = np.random.default_rng(20_240_229)
_A = _draw.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def ways_for(s: float, trees: int, recall: float = RECALL, depth: int = DEPTH) -> float:
    """How many ways a large node branches, on average, so that `trees` trees keep a pair of
    similarity s together with probability `recall` through a root and `depth` large nodes. Two sets
    go one way together with probability s ** 2."""
    for tenth in range(10, 161):
        ways, held = tenth / 10, 1.0
        for _ in range(depth):
            apart = 1 - s * s * held
            held = 1 - apart ** int(ways) * (1 - (ways - int(ways)) * (1 - apart))
        if 1 - (1 - s * held) ** trees >= recall:
            return ways
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at a similarity of {s}")


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text in lower case (A-Z)."""
    return [np.unique(shingle_hashes(h, k)) for h in hashed_words(texts, lower_words)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES minwise tokens (32 bits) of each set; of no use for an empty one."""
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    todo, size = [], 0
    for i, s in enumerate(sets):
        if len(s):
            todo.append(i)
            size += len(s)
        if size >= CHUNK or i + 1 == len(sets) and todo:
            flat = np.concatenate([sets[j] for j in todo])
            starts = np.concatenate(([0], np.cumsum([len(sets[j]) for j in todo])[:-1]))
            for c in range(COORDINATES):
                out[todo, c] = np.minimum.reduceat(((flat * _A[c]) + _B[c]) >> np.uint64(32), starts)
            todo, size = [], 0
    return out


def features(docs: DataFrame, k: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, h, n, digest, sig, low) of each row: h is a hash of its text, and low has the low byte of each coordinate, which is
    enough for comparisons."""

    def run(batches):
        for b in slices(batches):
            sets = shingle_sets(b.column(1).to_pylist(), k)
            sigs = signatures(sets)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in sigs], pa.binary()), pa.array([s.astype(np.uint8).tobytes() for s in sigs], pa.binary())], names=["doc_id", "h", "n", "digest", "sig", "low"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).mapInArrow(run, "doc_id long, h long, n long, digest binary, sig binary, low binary")


def _bytes_of(column: pa.Array) -> np.ndarray:
    """The low bytes of each row's coordinates: (rows, COORDINATES), of a column of sig or low."""
    raw = b"".join(column.to_pylist())
    if len(raw) == 4 * COORDINATES * len(column):
        return np.frombuffer(raw, "<u4").astype(np.uint8).reshape(-1, COORDINATES)
    return np.frombuffer(raw, np.uint8).reshape(-1, COORDINATES)


def _forest(pairs) -> list[tuple[int, int]]:
    """A spanning forest of pairs, as (root, member)."""
    up: dict[int, int] = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(top(x), x) for x in list(up) if top(x) != x]


def _edges(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["src", "dst"])


def _groups(batches, keys: int):
    """Tables of whole groups: consecutive rows with equal first `keys` columns stay together."""
    held = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not len(t):
            continue
        change = np.zeros(len(t), bool)
        last = [held[-1].column(i)[-1].as_py() for i in range(keys)] if held else None
        for i in range(keys):
            c = t.column(i).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and last != [t.column(i)[0].as_py() for i in range(keys)]
        cuts = np.flatnonzero(change)
        if len(cuts):  # what comes before the last change is whole
            at = int(cuts[-1])
            yield pa.concat_tables([*held, t.slice(0, at)])
            held = [t.slice(at)]
        else:
            held.append(t)
    if held:
        yield pa.concat_tables(held)


def _leaf_links(least: int):
    """Compares all pairs of each small node: rows (node, rep, low or sig) in order of nodes."""

    def run(batches):
        for t in _groups(batches, 1):
            node, rep = t.column(0).to_numpy(), t.column(1).to_numpy()
            sig = _bytes_of(t.column(2))
            pairs, shift = [], 1
            while shift < len(node):
                at = np.flatnonzero(node[shift:] == node[:-shift])
                if not len(at):
                    break
                for some in np.array_split(at, len(at) // 100_000 + 1):
                    good = some[(sig[some] == sig[some + shift]).sum(axis=1) >= least]
                    pairs += zip(rep[good].tolist(), rep[good + shift].tolist(), strict=True)
                shift += 1
            yield _edges(_forest(pairs))

    return run


def _branch(trees: int, sure: int, ways: float):
    """(node, rep, pivot, sig, pivot_sig) to node, rep, pivot, sig, alike (equal coordinates) and the
    child nodes of what stays: two selected tokens name one, in int(ways) ways, and in one more way
    for so many of the nodes that it makes up the rest."""

    def run(batches):
        free = np.uint64(COORDINATES - trees)
        for b in batches:
            n = len(b)
            sig, other = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u4").reshape(n, COORDINATES) for i in (3, 4))
            alike = (sig == other).sum(axis=1).astype(np.int32)
            node = b.column(0).to_numpy().astype(np.uint64)
            children = [[] for _ in range(n)]
            for way in range(math.ceil(ways)):
                at = [(trees + (mix(node + np.uint64(1 + 2 * way + i)) % free).astype(np.int64)) for i in range(2)]
                name = mix(node + np.uint64(100 + way))
                for c in at:
                    name = mix(name + sig[np.arange(n), c] + (c.astype(np.uint64) << np.uint64(33)))
                goes = (alike < sure) & ((mix(node + np.uint64(200)) % np.uint64(1_000) < (ways - int(ways)) * 1_000) if way >= int(ways) else True)
                for i in np.flatnonzero(goes).tolist():
                    children[i].append(int(name[i].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(alike), pa.array(children, pa.list_(pa.int64()))], names=["node", "rep", "pivot", "sig", "alike", "children"])

    return run


def _coarse(t: float) -> int:
    """Coordinates in which two sets of similarity t agree at least, but for a chance of 1e-10."""
    return int(COORDINATES * max(0.2, 2 * t - 1.08))


def candidates(reps: DataFrame, percent: int, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(src, dst): links between classes whose signatures make a similarity of percent / 100
    possible, few enough to span each coarse group. reps: (rep, sig, low), one row a class.

    A class that agrees with its node's pivot in `sure` coordinates leaves the node. What it agrees
    with in `coarse` ones agrees with the pivot in to_pivot ones at least, and is linked to that.
    """
    t = percent / 100
    coarse, sure, ways = _coarse(t), int(COORDINATES * (t - 0.05)), ways_for(t, trees)
    to_pivot = max(1, sure + coarse - COORDINATES)
    roots = F.array(*(F.xxhash64(F.lit(k), F.substring("sig", 4 * k + 1, 4)) for k in range(trees)))
    frontier = reps.select("rep", F.explode(roots).alias("node"))
    # at the roots, ids only: most nodes hold one class and end here
    sizes = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    level = cut(frontier.join(sizes, "node").select("node", "rep", "c"), "roots")
    small = level.where(F.col("c") <= leaf).join(reps.select("rep", "low"), "rep").select("node", "rep", "low")
    big = cut(level.where(F.col("c") > leaf).join(reps.select("rep", "sig"), "rep").select("node", "rep", "sig"), "large")
    found = []
    while True:
        small = small.repartition("node").sortWithinPartitions("node", "rep")
        found.append(cut(small.mapInArrow(_leaf_links(coarse), "src long, dst long"), "leaf"))
        pivots = cut(big.groupBy("node").agg(F.min(F.struct("rep", "sig")).alias("p")).select("node", F.col("p.rep").alias("pivot"), F.col("p.sig").alias("pivot_sig")), "pivots")
        n = pivots.count()
        if not n:
            break
        near = big.join(broadcast_if_small(pivots, 10 * n), "node").select("node", "rep", "pivot", "sig", "pivot_sig")
        near = cut(near.mapInArrow(_branch(trees, sure, ways), "node long, rep long, pivot long, sig binary, alike int, children array<long>"), "near")
        found.append(near.where((F.col("alike") >= to_pivot) & (F.col("rep") != F.col("pivot"))).select(F.col("pivot").alias("src"), F.col("rep").alias("dst")))
        frontier = near.select("rep", "sig", F.explode("children").alias("node"))
        sizes = cut(frontier.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "sizes")
        level = cut(frontier.join(broadcast_if_small(sizes), "node").select("node", "rep", "sig", "c"), "level")
        small = level.where(F.col("c") <= leaf).select("node", "rep", "sig")
        big = level.where(F.col("c") > leaf).drop("c")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _filter_bits(ids: DataFrame, size: int) -> np.ndarray:
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    parts = ids.groupBy(F.floor(bit / 32768).alias("part")).agg(F.bitmap_construct_agg(bit % 32768).alias("bits")).toArrow().to_pylist()
    out = np.zeros((size // 32768, 4096), np.uint8)
    for r in parts:  # at most FILTER_BITS / 32768 rows of 4 KB
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _sets_of(docs: DataFrame, members: DataFrame, k: int, text: str, key: str) -> DataFrame:
    """(doc_id, digest, set) of the rows whose key may be a member's: a second scan, so that sets of
    most texts that have no candidate are never stored or shuffled. The filter has 16 bits for each member
    up to FILTER_BITS; beyond some 10 ** 9 members it lets more texts pass, and the join drops them."""
    size = min(FILTER_BITS, max(1 << 20, 1 << (16 * members.count()).bit_length()))
    shipped = docs.sparkSession.sparkContext.broadcast(_filter_bits(members, size))

    def run(batches):
        bits = shipped.value
        for b in slices(batches):
            at = b.column(2).to_numpy()
            hit = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            texts = b.column(1).take(pa.array(hit)).to_pylist()
            sets = shingle_sets(texts, k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit)), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "digest", "set"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(size))).mapInArrow(run, "doc_id long, digest binary, set binary")


class _Sets:
    """Sets laid out to count what one of them shares with many."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.starts = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        tokens, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mine = np.zeros(len(tokens), bool)

    def linked(self, p: int, some: np.ndarray, percent: int) -> np.ndarray:
        """Those of `some` that are linked to p."""
        own = self.flat[self.starts[p] : self.starts[p] + self.size[p]]
        self.mine[own] = True
        if len(some) > 200:  # the shingles that p has of every set, at once
            common = np.add.reduceat(self.mine[self.flat], self.starts, dtype=np.int64)[some]
        else:
            common = np.array([np.count_nonzero(self.mine[self.flat[self.starts[x] : self.starts[x] + self.size[x]]]) for x in some.tolist()], np.int64)
        self.mine[own] = False
        return some[100 * common >= percent * (self.size[p] + self.size[some] - common)]

    def fit(self, p: int, some: np.ndarray, sig: np.ndarray, percent: int) -> np.ndarray:
        """Those of `some` that may be linked to p by their sizes and signatures."""
        size = self.size
        return some[(100 * np.minimum(size[some], size[p]) >= percent * np.maximum(size[some], size[p])) & ((sig[some] == sig[p]).sum(axis=1) >= _coarse(percent / 100))]


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), np.uint64) for s in column]


def _cut_up(t: pa.Table, keys: int):
    """(first, last + 1) of each group of a table of whole groups."""
    named = np.stack([t.column(i).to_numpy() for i in range(keys)])
    cuts = [0, *(np.flatnonzero((named[:, 1:] != named[:, :-1]).any(axis=0)) + 1).tolist(), len(t)]
    return zip(cuts, cuts[1:], strict=False)


def _confirm(percent: int):
    """Searches each group by its confirmed links and gives those that it went along. Rows: (component,
    rep, low, set), in order."""

    def group(rep, sig, sets):
        left, links = np.arange(len(rep)), []
        while len(left):
            stack, left = [int(left[0])], left[1:]
            while stack and len(left):
                p = stack.pop()
                some = sets.fit(p, left, sig, percent)
                if len(some):
                    linked = sets.linked(p, some, percent)
                    links += [(int(rep[p]), int(rep[x])) for x in linked]
                    stack += linked.tolist()
                    left = left[~np.isin(left, linked, assume_unique=True)]
        return links

    def run(batches):
        for t in _groups(batches, 1):
            rep, sig = t.column(1).to_numpy(), _bytes_of(t.column(2))
            for a, z in _cut_up(t, 1):
                if z - a > 1:
                    yield _edges(group(rep[a:z], sig[a:z], _Sets(_arrays(t.column(3).slice(a, z - a)))))

    return run


def _star(percent: int):
    """(rep, pivot, set, pivot_set) to rep, pivot and whether they are linked."""

    def run(batches):
        for b in batches:
            linked = []
            for mine, other in zip(_arrays(b.column(2)), _arrays(b.column(3)), strict=True):
                common = len(np.intersect1d(mine, other, assume_unique=True))
                linked.append(100 * common >= percent * (len(mine) + len(other) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["rep", "pivot", "linked"])

    return run


def _against(percent: int):
    """Links between the asking and the other classes of each pair of blocks. Rows: (node, i, j, other, rep,
    low, set), in order; those with other = 0 ask."""

    def run(batches):
        for t in _groups(batches, 3):
            other, rep, sig = t.column(3).to_numpy(), t.column(4).to_numpy(), _bytes_of(t.column(5))
            for a, z in _cut_up(t, 3):
                asking = int((other[a:z] == 0).sum())
                if not asking or asking == z - a:
                    continue
                sets, links = _Sets(_arrays(t.column(6).slice(a, z - a))), []
                rest = np.arange(asking, z - a)
                for p in range(asking):
                    some = sets.fit(p, rest[rep[a + asking : z] != rep[a + p]], sig[a:z], percent)
                    if len(some):
                        links += [(int(rep[a + p]), int(rep[a + x])) for x in sets.linked(p, some, percent)]
                yield _edges(_forest(links))

    return run


def _blocks(number, shingles):
    return F.greatest(F.ceil(number / BLOCK_CLASSES), F.ceil(shingles * 8 / BLOCK_BYTES), F.lit(1)).cast("int")


def confirmed(docs: DataFrame, reps: DataFrame, coarse: DataFrame, k: int, percent: int, text: str, key: str, trees: int) -> DataFrame:
    """(src, dst): confirmed links that span each group. coarse: (node, component). A coarse group that fits
    a task is searched there; of the others see `_large_groups`."""
    roots = F.array(*(F.substring("sig", 4 * i + 1, 4) for i in range(trees))).alias("roots")
    members = cut(reps.join(broadcast_if_small(coarse.withColumnRenamed("node", "rep")), "rep").select("rep", "component", "doc_id", "digest", "n", "low", roots), "members")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("shingles"))
    large = cut(sizes.where(_blocks(F.col("c"), F.col("shingles")) > 1).select("component"), "large")
    found = _sets_of(docs, members.select("doc_id"), k, text, key).dropDuplicates(["doc_id", "digest"])
    sets = members.join(found, ["doc_id", "digest"]).select("component", "rep", "low", "set", "n", "roots")
    n = large.count()
    if not n:
        small = sets
    else:
        sets = cut(sets, "sets")
        small = sets.join(broadcast_if_small(large, n), "component", "left_anti")
    links = small.select("component", "rep", "low", "set").repartition("component").sortWithinPartitions("component", "rep").mapInArrow(_confirm(percent), "src long, dst long")
    return links.union(_large_groups(sets.join(broadcast_if_small(large, n), "component", "left_semi"), percent)) if n else links


def _large_groups(sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): confirmed links that span each of the groups that are too large for a task.

    All of a group are compared with its smallest class; what is linked to that is connected already, so
    only the others ask for links, among all that share a minwise token with them in one of the trees.
    Of such nodes the asking classes and all classes meet as pairs of blocks, so a set is sent to a tree
    once for each block of asking classes: few in a group of near copies, where few ask, and in a chain,
    whose nodes are small."""
    pivots = sets.groupBy("component").agg(F.min("rep").alias("rep"))
    pivots = cut(sets.join(broadcast_if_small(pivots), ["component", "rep"]).select("component", F.col("rep").alias("pivot"), F.col("set").alias("pivot_set")), "pivots")
    star = join_unique(sets.select("component", "rep", "set"), pivots, "component", wide="pivot_set").select("rep", "pivot", "set", "pivot_set")
    star = cut(star.mapInArrow(_star(percent), "rep long, pivot long, linked boolean"), "star")
    asking = star.where("not linked").select("rep", F.lit(True).alias("asks"))
    nodes = sets.select("component", "rep", "n", F.posexplode("roots").alias("tree", "token")).select("rep", "n", F.xxhash64("component", "tree", "token").alias("node"))
    nodes = cut(nodes.join(broadcast_if_small(asking), "rep", "left").withColumn("asks", F.coalesce("asks", F.lit(False))), "nodes")
    sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.count_if("asks").alias("a"), F.sum("n").alias("s"), F.sum(F.when(F.col("asks"), F.col("n")).otherwise(0)).alias("sa")).where("a > 0 and c > 1")
    sizes = cut(sizes.select("node", _blocks(F.col("a"), F.col("sa")).alias("rows"), _blocks(F.col("c"), F.col("s")).alias("columns")), "sizes")
    placed = join_unique(nodes, sizes, "node")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = placed.where("asks").select("node", F.pmod(F.xxhash64("rep"), F.col("rows")).cast("int").alias("i"), upto("columns").alias("j"), F.lit(0).alias("other"), "rep")
    others = placed.select("node", upto("rows").alias("i"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("columns")).cast("int").alias("j"), F.lit(1).alias("other"), "rep")
    rows = asked.unionByName(others).join(sets.select("rep", "low", "set"), "rep").select("node", "i", "j", "other", "rep", "low", "set")
    links = rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "other", "rep").mapInArrow(_against(percent), "src long, dst long")
    return star.where("linked and rep <> pivot").select(F.col("pivot").alias("src"), F.col("rep").alias("dst")).union(links)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs: documents whose
    k-word shingle sets have a Jaccard similarity of at least percent / 100 are linked, and
    component_id is the smallest doc_id reachable.

    A null text, or one without words, has an empty set and no links; one with fewer than k words
    has its whole sequence as its shingle. A row without doc_id is linked with nothing, has no
    component_id and is kept. Rows that share a doc_id count with the text of each; equal rows are
    kept alike. A text of any length counts with all its shingles. An empty table gives an empty one.
    Other columns of docs aren't read, whatever their names.
    """
    out = _judged(docs, k, percent, text, key, trees, leaf)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _judged(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(doc_id, h, n, component_id, head) of each row of docs: head is the (doc_id, h) of the row
    that stands for its group, null where a row has no group."""
    feat = cut(features(docs, k, text, key), "features")
    full = feat.where("n > 0 and doc_id is not null")
    reps = full.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("head"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"), F.any_value("low").alias("low"))
    reps = cut(reps.withColumn("doc_id", F.col("head.doc_id")).withColumn("rep", F.monotonically_increasing_id()), "reps")  # an id of its own, as rows may share a doc_id
    coarse = cut(connected_components(cut(candidates(reps.select("rep", "sig", "low"), percent, trees, leaf), "candidates")), "coarse")
    links = cut(confirmed(docs, reps.drop("head"), coarse, k, percent, text, key, trees), "links")
    parts = cut(connected_components(links).withColumnRenamed("node", "rep").join(reps.select("rep", "digest", "head"), "rep"), "parts")
    least = parts.groupBy("component").agg(F.min("head").alias("least"))  # several groups may have one smallest id
    named = parts.join(least, "component").select("digest", "least")
    named = cut(reps.select("digest", "head").join(named, "digest", "left").select("digest", F.coalesce("least", "head").alias("head")), "named")
    rows = feat.select("doc_id", "h", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = join_unique(rows.where("digest is not null"), named, "digest").select("doc_id", "h", "n", F.col("head.doc_id").alias("component_id"), "head")
    return out.unionByName(rows.where("digest is null").select("doc_id", "h", "n", F.col("doc_id").alias("component_id")), allowMissingColumns=True)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of documents: the one with
    the smallest id, of several texts with that id the one with the smallest hash, and of rows
    equal in both any one. Rows without doc_id or words are in no group and stay."""
    judged = cut(_judged(docs).where("head is not null").select(F.struct("doc_id", "h").alias("__key"), "head"), "judged")
    gone = cut(judged.where("__key <> head").select("__key").distinct(), "gone")
    again = cut(judged.where("__key = head").groupBy("__key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("__key"), "again")
    rows, back = aside(docs, ("__key",))
    left = rows.withColumn("__key", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")))
    left = left.join(broadcast_if_small(gone), "__key", "left_anti")
    n = again.count()
    if n:  # equal rows
        again = broadcast_if_small(again, n)
        left = left.join(again, "__key", "left_anti").unionByName(left.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return back(left)
