"""Near-duplicate documents by ProbMinHash.

A text is its set of five-word shingles, weighted by how often they occur
(damped). Every shingle is a Poisson process whose rate is its weight; each
arrival falls on a random register, and a register keeps the shingle that
arrived first. A process stops once it is later than all registers of its text
(early termination). Two texts agree on a register with their probability
Jaccard similarity. Bands of registers give candidate buckets.

Links are defined on plain sets of shingles, and weights can hide them: texts
that differ in how often a passage is repeated have a low probability Jaccard.
So a text with repeated shingles has a second set of registers with equal
weights, and their bands as well; in a text without repeats both are the same.

Buckets of any size are compared block against block inside tasks, on the
registers only; what leaves a task is a spanning forest of the likely pairs.
Those pairs are verified exactly, linked texts become components, and a closing
round verifies, inside the tasks, every likely pair that still lies across two
components of a bucket. So copies by the thousand cost a forest, not all pairs, and no link
between candidates is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.common import map_texts
from motefield.session import only_row, written

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
#: Pairs that agree on fewer registers of equal weights are not verified: more than six deviations below the threshold, one link in 50 million.
LIKELY = 55
#: Texts and bytes of shingles in one block of a bucket.
BLOCK, BLOCK_BYTES = 4096, 64 << 20
#: Bits of the filter that tells which texts are needed for verification (16 MB).
FILTER_BITS = 1 << 27
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of all windows of five words; a shorter text is one shingle."""
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(words))):
        out = (out + h[j : j + n]) * _C1
        out ^= out >> np.uint64(32)
    return _mix(out)


def prob_min_hash(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Registers of ``n`` weighted sets: element ``i`` of set ``owner[i]`` has ``weight[i]``."""
    first = np.full(n * m, np.inf)
    register = np.zeros(n * m, np.uint64)
    element, weight, owner = element, weight.astype(np.float64), owner.astype(np.int64)
    time = np.zeros(len(element))
    step = 0
    while len(element):
        step += 1
        draw = _mix(element + np.uint64(2 * step) * _C1)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight
        at = owner * m + (_mix(draw ^ _C3) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        register[at[won]] = element[won]
        sets = np.unique(owner)
        last = np.full(n, -1.0)
        last[sets] = first.reshape(n, m)[sets].max(axis=1)
        alive = time < last[owner]
        element, weight, owner, time = element[alive], weight[alive], owner[alive], time[alive]
    return register.reshape(n, m)


def _parse(text: str) -> tuple[list[bytes], bytes]:
    words = text.encode("utf-8", "replace").split()
    return words, hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, node, n, bands, registers)`` of every row; ``node`` names the text by its words and is null without any.

    ``registers`` are those of equal weights; ``bands`` are of both kinds, each once.
    """

    def bands_of(register: np.ndarray) -> np.ndarray:
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _C3, (len(register), 1))
        for r in range(ROWS):
            key = _mix((key + register.reshape(-1, BANDS, ROWS)[:, :, r]) * _C1)
        return key

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        nodes, sizes, parts, weights = [], [], [], []
        with np.errstate(over="ignore"):
            for text in batch.column(1).to_pylist():
                words, node = _parse(text)
                if not words:
                    nodes.append(None)
                    sizes.append(0)
                    continue
                found, times = np.unique(shingles(words, known), return_counts=True)
                nodes.append(node)
                sizes.append(len(found))
                parts.append(found)
                weights.append(1.0 + np.log(times))
            full = [i for i, s in enumerate(sizes) if s]
            element = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            weight = np.concatenate(weights) if weights else np.zeros(0)
            size = np.array([sizes[i] for i in full], np.int64)
            owner = np.repeat(np.arange(len(full)), size)
            plain = prob_min_hash(element, np.ones(len(element)), owner, len(full))
            again = np.flatnonzero(np.bincount(owner, weights=weight > 1, minlength=len(full)))
            inside = np.isin(owner, again)
            weighted = prob_min_hash(element[inside], weight[inside], np.searchsorted(again, owner[inside]), len(again))
            key, more = bands_of(plain), dict(zip(again.tolist(), bands_of(weighted), strict=True))
            short = (_mix(plain) & np.uint64(0xFFFF)).astype(np.uint16)
        bands, registers = [None] * len(nodes), [None] * len(nodes)
        for j, i in enumerate(full):
            own = np.union1d(key[j], more[j]) if j in more else key[j]
            bands[i], registers[i] = own.astype(np.int64), short[j].tobytes()
        columns = [batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(registers, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "bands", "registers"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, {"doc_id": id_col, "text": text_col}, run, f"doc_id {kind}, node binary, n int, bands array<bigint>, registers binary")


def _likely(one: np.ndarray, many: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """Registers shared with each of many texts, 0 where the sizes alone rule a pair out."""
    same = (many == one).sum(axis=1)
    fits = np.minimum(sizes, n) >= THRESHOLD * np.maximum(sizes, n)
    return np.where(fits & (same >= LIKELY), same, 0)


def forest(registers: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Maximum spanning forest of the likely pairs, grown text by text in linear memory."""
    g = len(sizes)
    best, source = np.full(g, -1), np.full(g, -1)
    open_ = np.ones(g, bool)
    edges = []
    for _ in range(g):
        i = int(np.argmax(np.where(open_, best, -2)))
        open_[i] = False
        if best[i] > 0:
            edges.append((int(source[i]), i))
        same = _likely(registers[i], registers, int(sizes[i]), sizes)
        better = open_ & (same > best)
        best[better], source[better] = same[better], i
    return edges


def links_across(registers: np.ndarray, sizes: np.ndarray, group: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between texts of different groups: likely pairs, verified on the shingles, until their groups are joined."""
    root = list(range(int(group.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for i in range(len(sizes) - 1):
        same = _likely(registers[i], registers[i + 1 :], int(sizes[i]), sizes[i + 1 :])
        for j in (np.flatnonzero((same > 0) & (group[i + 1 :] != group[i])) + i + 1).tolist():
            x, y = find(int(group[i])), find(int(group[j]))
            if x != y and _alike(sets[i], sets[j]):
                root[y] = x
                edges.append((i, j))
    return edges


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= THRESHOLD * (len(x) + len(y) - both)


def _per_bucket(members: DataFrame, columns: list[str], edges_of) -> DataFrame:
    """Distinct pairs ``(a, b)`` that ``edges_of(rows)`` finds in each block pair of a bucket; rows begin with the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], set()

        def close() -> None:
            if len(rows) > 1:
                for i, j in edges_of(rows):
                    found.add((min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])))

        def emit() -> pa.RecordBatch:
            pairs = sorted(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])

        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("key", "lo", "hi")], strict=True)
            for k, row in zip(keys, zip(*[batch.column(c).to_pylist() for c in columns], strict=True), strict=True):
                if k != key:
                    close()
                    key, rows = k, []
                rows.append(row)
            yield emit()
        close()
        yield emit()

    near = members.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return near.select("key", "lo", "hi", *columns).mapInArrow(run, "a binary, b binary").distinct()


def _registers(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join([r[2] for r in rows]), np.uint16).reshape(len(rows), -1), np.array([r[1] for r in rows])


def likely_forests(members: DataFrame) -> DataFrame:
    """Pairs of a spanning forest of the likely pairs of every bucket."""
    return _per_bucket(members, ["node", "n", "registers"], lambda rows: forest(*_registers(rows)))


def closing_links(members: DataFrame, groups: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Verified links between different components that still share a bucket.

    Only buckets of several components are looked at. Their shingle sets go to
    the bucket's tasks, which verify there and return links, never pairs.
    """
    named = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    open_ = written(named.join(mixed, "key", "left_semi"), "open-buckets")
    sets = shingle_sets(df, open_.select("node").distinct(), id_col, text_col)

    def edges_of(rows: list[tuple]) -> list[tuple[int, int]]:
        names = {c: i for i, c in enumerate(dict.fromkeys(r[3] for r in rows))}
        if len(names) < 2:
            return []
        return links_across(*_registers(rows), np.array([names[r[3]] for r in rows]), [np.frombuffer(r[4], np.uint64) for r in rows])

    return _per_bucket(open_.join(sets, "node"), ["node", "n", "registers", "component", "shingles"], edges_of)


def _members(nodes: DataFrame) -> DataFrame:
    """Nodes of every bucket that holds at least two, cut into blocks; a bucket of many blocks has every pair of them."""
    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("shingles")).filter(F.col("g") > 1)
    sizes = sizes.select("key", F.greatest(F.ceil(F.col("g") / BLOCK), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = banded.drop("n").join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return placed.select("key", "node", "own", other).select("key", "node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _needed(nodes: DataFrame) -> np.ndarray:
    """Bit filter of the wanted texts: 16 MB at most, whatever their number."""
    bit = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    ends = nodes.select((bit / 64).cast("long").alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(node), 64) as int))").alias("v"))
    table = ends.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[table["w"].to_numpy()] = table["v"].to_numpy()
    return out


def shingle_sets(df: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(node, shingles)``: sorted 64-bit shingle hashes of the wanted texts, and of few others."""
    sent = df.sparkSession.sparkContext.broadcast(_needed(nodes))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        parsed = {}
        for text in batch.column(1).to_pylist():
            words, node = _parse(text)
            if words:
                parsed[node] = words
        nodes = list(parsed)
        h = np.array([_spark_hash(x) for x in nodes], np.int64)
        needed = (sent.value[(h % FILTER_BITS) // 64] >> (h % 64)) & 1 if len(nodes) else np.zeros(0, np.int64)
        nodes = [x for x, keep in zip(nodes, needed.tolist(), strict=True) if keep]
        with np.errstate(over="ignore"):
            sets = [np.unique(shingles(parsed[x], known)).tobytes() for x in nodes]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return map_texts(df, {"doc_id": id_col, "text": text_col}, run, "node binary, shingles binary").dropDuplicates(["node"])


def _spark_hash(node: bytes) -> int:
    """``xxhash64`` of Spark for a binary value."""
    h = xxhash.xxh64_intdigest(node, seed=42)
    return h - (1 << 64) if h >> 63 else h


def verified(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs ``(a, b)`` whose shingle sets have a Jaccard similarity of at least the threshold."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = shingle_sets(df, ends, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of an edge list: the least node it is linked to, over any number of steps.

    Large-star and small-star rounds on tables in the shared folder until nothing moves.
    """
    edges = written(edges.select("a", "b"), "links")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(root.select("a", F.col("m").alias("b"))).distinct()
        nxt = written(small, "links")
        moved = only_row(nxt.join(edges, ["a", "b"], "left_anti").agg(F.count(F.lit(1)).alias("n")))["n"]
        gone = only_row(nxt.agg(F.count(F.lit(1)).alias("n")))["n"] != only_row(edges.agg(F.count(F.lit(1)).alias("n")))["n"]
        edges = nxt
        if not moved and not gone:
            roots = edges.select(F.col("b").alias("a"), "b").distinct()
            return edges.union(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id)`` for every row: the least id of all rows its text is linked to.

    Texts are linked if their sets of five-word shingles have a Jaccard
    similarity of 0.8 or more; classes are what links connect. Words stand
    between ASCII white space, and a text of fewer than five words is one
    shingle. Texts of equal words are one class. A row whose text is null,
    empty or blank has nothing to compare and is a class of its own. A null id
    is never a class id unless all ids of the class are null. Repeated rows
    are all returned. Other columns are left out.
    """
    signed = written(signatures(df, id_col, text_col), "signatures")
    nodes = signed.filter(F.col("node").isNotNull()).drop("doc_id").dropDuplicates(["node"])
    members = written(_members(nodes).join(nodes.select("node", "n", "registers"), "node"), "members")
    pairs = written(likely_forests(members), "pairs")
    links = written(verified(pairs, df, id_col, text_col), "verified")
    groups = written(components(links), "components")
    closed = written(closing_links(members, groups, df, id_col, text_col), "closing")
    if only_row(closed.agg(F.count(F.lit(1)).alias("n")))["n"]:
        groups = written(components(links.union(closed)), "components")
    named = signed.select("doc_id", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return named.join(least, "component", "left").select("doc_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
