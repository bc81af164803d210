"""Near-duplicate vectors by an exact metric range join.

Unit vectors with a cosine of at least ``c`` lie within ``r = sqrt(2 - 2c)`` of
each other. The vectors of a label are cut into cells, each vector going to its
nearest pivot. For a vector ``x`` and a later cell with pivot ``p`` and radius
``R`` the triangle inequality leaves three cases:

* ``d(x, p) - R > r``, or ``x`` lies further than ``r`` beyond the plane between
  the pivots: no link, nothing is sent;
* ``d(x, p) + R <= r``: all vectors of the cell are linked, which is a count and
  a line to the pivot, nothing is sent;
* else ``x`` is replicated into the cell.

Cells then join independently. A cell of any size is cut into blocks, and a
task multiplies one pair of blocks, leaving out what the distances to the pivot
rule out. What leaves a task is a count for each vector and a spanning forest,
never pairs. Equal vectors are one node with a weight.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.common import looked_up
from motefield.llm.neardup import components
from motefield.session import only_row, written

COSINE = 0.98
#: Vectors of a cell on average, and of a block at most on average.
CELL, BLOCK = 2048, 4096
#: Bytes of pivots that travel to the tasks; beyond them cells grow.
PIVOT_BYTES = 32 << 20
#: Rows of a block multiplied at once, and distances to pivots held at once.
STRIP, HELD = 1024, 1 << 22
#: Distances on unit vectors are this exact at least, so bounds keep this margin.
MARGIN = 1e-6
_NODE = "node binary, group string, w long, vector binary"


def _units(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None where a vector is null, empty, zero or holds a null or non-finite component."""
    out = []
    for value in column:
        x = None if not value.is_valid else np.asarray(value.values.to_numpy(zero_copy_only=False), np.float64)
        if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
            out.append(None)
            continue
        x = x / np.abs(x).max()
        out.append(x / np.sqrt(x @ x))
    return out


def vector_nodes(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(vec_id, node, group, vector)`` of every row; node is null for a vector that links with nothing.

    ``group`` holds label and dimension, ``vector`` the unit vector's bytes, and
    ``node`` a 128-bit hash of group and components.
    """
    named = F.when(F.col(label_col).isNotNull(), F.concat_ws("|", F.size(vector_col).cast("string"), F.to_json(F.struct(F.col(label_col).alias("label")))))
    chosen = df.select(F.col(id_col).alias("vec_id"), named.alias("group"), F.col(vector_col).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, vectors = [], []
            for value, unit, group in zip(batch.column(2), _units(batch.column(2)), batch.column(1).to_pylist(), strict=True):
                if unit is None or group is None:
                    nodes.append(None)
                    vectors.append(None)
                    continue
                raw = value.values.to_numpy(zero_copy_only=False) + 0.0  # one zero, not two
                nodes.append(hashlib.blake2b(raw.tobytes(), key=hashlib.sha256(group.encode()).digest(), digest_size=16).digest())
                vectors.append(unit.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), batch.column(1), pa.array(vectors, pa.binary())], ["vec_id", "node", "group", "vector"])

    return chosen.mapInArrow(run, f"vec_id {df.schema[id_col].dataType.simpleString()}, node binary, group string, vector binary")


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


class Pivots:
    """Pivots of the groups that are larger than a cell: nodes and unit vectors, numbered from 0 in each group."""

    def __init__(self, rows: list):
        self.nodes: dict[str, list[bytes]] = {}
        vectors: dict[str, list[bytes]] = {}
        for r in sorted(rows, key=lambda r: bytes(r["node"])):
            self.nodes.setdefault(r["group"], []).append(bytes(r["node"]))
            vectors.setdefault(r["group"], []).append(bytes(r["vector"]))
        self.vectors = {g: _matrix(v) for g, v in vectors.items()}


def choose_pivots(nodes: DataFrame, cell: int) -> Pivots:
    """One node in ``cell`` of every group larger than that, by hash. The pivots of all groups fit ``PIVOT_BYTES``."""
    whole = only_row(nodes.agg(F.sum(F.octet_length("vector")).alias("bytes")))["bytes"] or 0
    cell = max(cell, -(-whole // PIVOT_BYTES))
    large = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell).select("group")
    picked = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(cell)) == 0).join(large, "group", "left_semi")
    return Pivots(picked.select("node", "group", "vector").collect())


def _by_group(batch: pa.RecordBatch, column: int) -> Iterator[tuple[str, np.ndarray]]:
    groups = np.array(batch.column(column).to_pylist(), object)
    for g in dict.fromkeys(groups):
        yield g, np.flatnonzero(groups == g)


def _strips(at: np.ndarray, pivots: np.ndarray | None) -> list[np.ndarray]:
    rows = STRIP if pivots is None else max(1, min(STRIP, HELD // len(pivots)))
    return np.array_split(at, -(-len(at) // rows))


def with_home(nodes: DataFrame, pivots) -> DataFrame:
    """The nodes with ``home``, the number of the nearest pivot, and ``dist`` to it; 0 where a group has no pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, dist = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            vectors = batch.column(3).to_pylist()
            for group, at in _by_group(batch, 1):
                p = pivots.value.vectors.get(group)
                for part in _strips(at, p) if p is not None else ():
                    d = _distances(_matrix([vectors[i] for i in part]), p)
                    home[part] = d.argmin(axis=1)
                    dist[part] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(dist)], ["node", "group", "w", "vector", "home", "dist"])

    return nodes.select("node", "group", "w", "vector").mapInArrow(run, f"{_NODE}, home int, dist double")


class Cells:
    """Members, weight and radius of the cells of groups with pivots, and how many visitors each one has."""

    def __init__(self, pivots: Pivots, rows: list, r: float, block: int = BLOCK):
        self.r, self.block = r, block
        self.pivots = pivots
        self.count = {g: np.zeros(len(v), np.int64) for g, v in pivots.vectors.items()}
        self.weight = {g: np.zeros(len(v), np.int64) for g, v in pivots.vectors.items()}
        self.radius = {g: np.zeros(len(v)) for g, v in pivots.vectors.items()}
        self.visitors = {g: np.zeros(len(v), np.int64) for g, v in pivots.vectors.items()}
        for row in rows:
            g, i = row["group"], row["home"]
            self.count[g][i], self.weight[g][i], self.radius[g][i] = row["n"], row["w"], row["radius"]

    def blocks(self, group: str, i: int) -> tuple[int, int]:
        """Blocks of a cell's own vectors, and of its visitors."""
        return max(1, -(-int(self.count[group][i]) // self.block)), -(-int(self.visitors[group][i]) // self.block)

    def cases(self, group: str, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector and cell: whether all of the cell are linked, and whether the vector must be compared with it."""
        pivots = self.pivots.vectors[group]
        d = _distances(x, pivots)
        own = np.take_along_axis(d, home[:, None], axis=1)
        far = d - self.radius[group] > self.r + MARGIN
        # Distance to the plane half-way between the two pivots.
        beyond = (d**2 - own**2) > 2.0 * _distances(pivots[home], pivots) * (self.r + MARGIN) + MARGIN
        later = np.arange(d.shape[1])[None, :] > home[:, None]
        every = later & (d + self.radius[group] <= self.r - MARGIN) & (self.count[group] > 0)
        return every, later & ~every & ~far & ~beyond & (self.count[group] > 0)


def count_visitors(homes: DataFrame, cells) -> DataFrame:
    """``(group, home, n)``: vectors that are replicated into each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors, home = batch.column(3).to_pylist(), batch.column(4).to_numpy()
            for group, at in _by_group(batch, 1):
                if group not in cells.value.count:
                    continue
                for part in _strips(at, cells.value.pivots.vectors[group]):
                    _, visit = cells.value.cases(group, _matrix([vectors[i] for i in part]), home[part])
                    total[group] = total.get(group, 0) + visit.sum(axis=0)
        for group, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["group", "home", "n"])

    found = homes.select("node", "group", "w", "vector", "home").mapInArrow(run, "group string, home int, n long")
    return found.groupBy("group", "home").agg(F.sum("n").alias("n"))


_PLACED = "group string, home int, lo int, hi int, side int, node binary, w long, dist double, vector binary, links long, other binary"
_FOUND = "node binary, links long, other binary, group string, home int, extra long"


def _rows(schema: str, columns: list[list]) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    names, kinds = zip(*[c.split() for c in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


class _Union:
    """Joins items and remembers the lines that did it."""

    def __init__(self):
        self.root: dict = {}

    def find(self, x):
        root = self.root.setdefault(x, x)
        while root != self.root[root]:
            root = self.root[root]
        while self.root[x] != root:
            self.root[x], x = root, self.root[x]
        return root

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[y] = x
        return x != y


def placed(homes: DataFrame, cells) -> DataFrame:
    """Every vector in the block pairs of its own cell and of the cells it visits; cells that are linked as a whole as counts."""

    def strip(c: Cells, group: str, rows: list[tuple], x: np.ndarray | None) -> Iterator[tuple]:
        """Rows of one strip; a row is ``(node, w, vector, home, dist)``."""
        if x is not None:
            every, visit = c.cases(group, x, np.array([r[3] for r in rows]))
            dists = _distances(x, c.pivots.vectors[group])
            pivot = c.pivots.nodes[group]
        union = _Union()
        last: dict[int, bytes] = {}
        for k, (node, w, vector, h, dist) in enumerate(rows):
            own = int.from_bytes(node[:8], "little")
            a, more = c.blocks(group, h) if x is not None else (1, 0)
            block = own % a
            for b in range(a + more):
                yield group, h, min(block, b), max(block, b), int(block > b), node, w, dist, vector, None, None
            if x is None:
                continue
            for j in np.flatnonzero(visit[k]).tolist():
                inner, outer = c.blocks(group, j)
                seat = inner + own % max(1, outer)
                for b in range(inner):
                    yield group, j, b, seat, 1, node, w, float(dists[k, j]), vector, None, None
            linked = np.flatnonzero(every[k])
            if len(linked):
                # One line to what the first of these cells is already joined to; lines between pivots once a strip.
                first = int(linked[0])
                yield group, -1, own % 997, 0, 0, node, None, None, None, int(c.weight[group][linked].sum()), last.get(first, pivot[first])
                last[first] = node
                for j in linked[1:].tolist():
                    if union.join(first, j):
                        yield group, -1, own % 997, 0, 0, pivot[first], None, None, None, 0, pivot[j]
        if x is not None and every.any():
            extra = np.array([r[1] for r in rows]) @ every
            for j in np.flatnonzero(extra).tolist():
                yield group, -2 - j, 0, 0, 0, None, None, None, None, int(extra[j]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cells.value
        for batch in batches:
            nodes, w, vectors, home, dist = (batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))
            for group, at in _by_group(batch, 1):
                pivots = c.pivots.vectors.get(group)
                for part in _strips(at, pivots):
                    rows = [(nodes[i], w[i], vectors[i], home[i], dist[i]) for i in part.tolist()]
                    out = strip(c, group, rows, None if pivots is None else _matrix([r[2] for r in rows]))
                    while some := list(itertools.islice(out, BLOCK)):
                        yield _rows(_PLACED, [list(col) for col in zip(*some, strict=True)])

    return homes.select("node", "group", "w", "vector", "home", "dist").mapInArrow(run, _PLACED)


def join_blocks(a: tuple, b: tuple | None, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights linked to each vector of two blocks, or of one with itself, and a spanning forest over the numbers of both.

    A block is ``(vectors, weights, distances to the pivot)``, sorted by distance.
    Vectors whose distances differ by more than the range are not multiplied.
    """
    same = b is None
    x, wx, dx = a
    y, wy, dy = a if same else b
    r = np.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + MARGIN
    sum_x, sum_y = np.zeros(len(x)), np.zeros(len(y))
    shift = 0 if same else len(x)
    joined = np.arange(len(x) + (0 if same else len(y)))
    lines = []
    for start in range(0, len(x), STRIP):
        rows = slice(start, min(start + STRIP, len(x)))
        lo, hi = np.searchsorted(dy, dx[rows][0] - r), np.searchsorted(dy, dx[rows][-1] + r, "right")
        hit = x[rows] @ y[lo:hi].T >= cosine
        if same:
            own = np.arange(rows.start, rows.stop)
            inside = (own >= lo) & (own < hi)
            hit[np.flatnonzero(inside), own[inside] - lo] = False
        some = np.flatnonzero(hit.any(axis=1))
        if not len(some):
            continue
        # Sums of whole numbers below 2**53 are exact in doubles.
        times = hit[some].astype(np.float64)
        sum_x[some + start] += times @ wy[lo:hi]
        if not same:
            sum_y[lo:hi] += wx[some + start] @ times
        for i in some.tolist():
            to = np.flatnonzero(hit[i]) + lo + shift
            while len(to := to[joined[to] != joined[start + i]]):
                lines.append((start + i, int(to[0])))
                joined[joined == joined[to[0]]] = joined[start + i]
    return sum_x.astype(np.int64), sum_y.astype(np.int64), lines


def joined_cells(rows: DataFrame, cosine: float) -> DataFrame:
    """``(node, links, other, group, home, extra)``: counts and lines of every block pair; whole cells pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part: list[tuple]) -> tuple:
            order = sorted(part, key=lambda r: r[3])
            return [r[1] for r in order], (_matrix([r[4] for r in order]), np.array([r[2] for r in order], np.int64), np.array([r[3] for r in order]))

        def close(part: list[tuple]) -> Iterator[pa.RecordBatch]:
            left, right = [r for r in part if not r[0]], [r for r in part if r[0]]
            if not left:
                return
            same = key[2] == key[3]
            if not same and not right:
                return
            names, a = block(left)
            more, b = block(right) if not same else ([], None)
            sum_x, sum_y, lines = join_blocks(a, b, cosine)
            names = names + more
            sums = np.r_[sum_x, sum_y] if not same else sum_x
            found = [(names[i], int(sums[i]), None) for i in np.flatnonzero(sums).tolist()] + [(names[i], 0, names[j]) for i, j in lines]
            for start in range(0, len(found), BLOCK):
                cols = [list(c) for c in zip(*found[start : start + BLOCK], strict=True)]
                yield _rows(_FOUND, [*cols, *[[None] * len(cols[0])] * 3])

        key, part = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            passed = []
            for group, home, lo, hi, side, node, w, dist, vector, links, other in zip(*cols, strict=True):
                if home == -1:
                    passed.append((node, links, other, None, None, None))
                elif home < -1:
                    passed.append((None, None, None, group, -2 - home, links))
                else:
                    if (group, home, lo, hi) != key:
                        if part:
                            yield from close(part)
                        key, part = (group, home, lo, hi), []
                    part.append((side, node, w, dist, vector))
            if passed:
                yield _rows(_FOUND, [list(c) for c in zip(*passed, strict=True)])
        if part:
            yield from close(part)

    near = rows.repartition("group", "home", "lo", "hi").sortWithinPartitions("group", "home", "lo", "hi")
    return near.mapInArrow(run, _FOUND)


def similar_vectors(
    df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell: int = CELL, block: int = BLOCK
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Rows are linked if their labels are equal and not null and the cosine of
    their vectors, of equal length and in double precision, is at least
    ``cosine``. ``n_links`` counts the other rows linked directly, repeated rows
    among them; ``component_id`` is the smallest id reachable by links, the
    row's own included; ``kept`` tells whether that is its own id. A vector
    that is null, empty or zero, or holds a null or non-finite component, links
    with nothing and neither does a row without a label. A null id comes after
    all others: it is the component's only if no other is there. An empty table
    gives no rows. Other columns are left out.
    """
    spark = df.sparkSession
    rows = vector_nodes(df, id_col, vector_col, label_col)
    named_rows = written(rows.select("vec_id", "node"), "rows")
    grouped = rows.filter(F.col("node").isNotNull()).groupBy("node")
    nodes = written(grouped.agg(F.first("group").alias("group"), F.count(F.lit(1)).alias("w"), F.first("vector").alias("vector"), F.min("vec_id").alias("least")), "nodes")
    pivots = choose_pivots(nodes, cell)
    # A row of ``homes`` holds its vector, so that tasks need no join to get it.
    homes = written(with_home(nodes, spark.sparkContext.broadcast(pivots)), "homes")
    sizes = homes.groupBy("group", "home").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.max("dist").alias("radius"))
    known = spark.createDataFrame([(g,) for g in pivots.vectors] or [("",)], "group string")
    cells = Cells(pivots, sizes.join(F.broadcast(known), "group", "left_semi").collect() if pivots.vectors else [], float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine))), block)
    if pivots.vectors:
        for row in count_visitors(homes, spark.sparkContext.broadcast(cells)).collect():
            cells.visitors[row["group"]][row["home"]] = row["n"]
    found = written(joined_cells(placed(homes, spark.sparkContext.broadcast(cells)), cosine), "found")
    direct = found.filter(F.col("node").isNotNull()).groupBy("node").agg(F.sum("links").alias("links"))
    whole = found.filter(F.col("home").isNotNull()).groupBy("group", "home").agg(F.sum("extra").alias("extra"))
    groups = components(found.filter(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    named = nodes.select("node", "w", "least").join(homes.select("node", "group", "home"), "node").join(whole, ["group", "home"], "left")
    named = named.join(direct, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    links = F.coalesce("links", F.lit(0)) + F.coalesce("extra", F.lit(0)) + F.col("w") - 1
    named = written(named.select("node", "w", "least", "component", links.alias("n_links")), "linked")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    judged = looked_up(named, least, "component", "members").select("node", "w", "n_links", "component_id")
    out = looked_up(named_rows, judged, "node", "w")
    alone = F.col("node").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
