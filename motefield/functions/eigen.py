"""Eigenvalues and eigenvectors of symmetric 3x3 matrices as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.vectors import let

Vector = tuple[Column, Column, Column]
Known = dict[str, Column]


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _vector(k: Known, name: str) -> Vector:
    return tuple(k[f"{name}{i}"] for i in range(3))


def _named(name: str, v: Sequence[Column]) -> Known:
    return {f"{name}{i}": c for i, c in enumerate(v)}


def _rows(k: Known, less: Column | float = 0.0) -> tuple[Vector, Vector, Vector]:
    return (k["xx"] - less, k["xy"], k["xz"]), (k["xy"], k["yy"] - less, k["yz"]), (k["xz"], k["yz"], k["zz"] - less)


def _scaled(k: Known) -> Known:
    scale = F.when(k["biggest"] > 0, k["biggest"]).otherwise(F.lit(1.0))
    cells = {n: k[n] / scale for n in ("xx", "xy", "xz", "yy", "yz", "zz")}
    return cells | {"scale": scale, "q": (cells["xx"] + cells["yy"] + cells["zz"]) / 3}


def _spread(k: Known) -> Known:
    a, b, c = k["xx"] - k["q"], k["yy"] - k["q"], k["zz"] - k["q"]
    xy, xz, yz = k["xy"], k["xz"], k["yz"]
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    return {"p": F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6), "det": det}


def _apart(k: Known) -> Known:
    p = k["p"]
    half = F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(k["det"], 2 * p * p * p)))).otherwise(F.lit(1.0))
    # Whether the largest eigenvalue is the one that stands apart, and that eigenvalue.
    turn = F.acos(half) / 3
    return {"top": half >= 0, "apart": k["q"] + 2 * p * F.when(half >= 0, F.cos(turn)).otherwise(F.cos(turn + 2 * math.pi / 3))}


def _crossed(k: Known) -> Known:
    r = _rows(k, k["apart"])
    return _named("c", _cross(r[0], r[1])) | _named("d", _cross(r[0], r[2])) | _named("e", _cross(r[1], r[2]))


def _lengths(k: Known) -> Known:
    return {f"n{n}": _dot(_vector(k, n), _vector(k, n)) for n in "cde"}


def _first(k: Known) -> Known:
    c, d, e = k["nc"], k["nd"], k["ne"]
    length = F.sqrt(F.greatest(c, d, e))
    longest = [F.when((c >= d) & (c >= e), k[f"c{i}"]).when(d >= e, k[f"d{i}"]).otherwise(k[f"e{i}"]) for i in range(3)]
    # Without any direction, as for equal eigenvalues, the first axis.
    return _named("u", [F.when(length > 0, F.try_divide(longest[i], length)).otherwise(F.lit(float(i == 0))) for i in range(3)])


def _plane(k: Known) -> Known:
    u = _vector(k, "u")
    first = F.abs(u[0]) > F.abs(u[1])
    size = F.sqrt(u[2] * u[2] + F.when(first, u[0] * u[0]).otherwise(u[1] * u[1]))
    across = [F.when(first, -u[2]).otherwise(F.lit(0.0)), F.when(first, F.lit(0.0)).otherwise(u[2]), F.when(first, u[0]).otherwise(-u[1])]
    return _named("s", [F.try_divide(a, size) for a in across])


def _second(k: Known) -> Known:
    return _named("t", _cross(_vector(k, "u"), _vector(k, "s")))


def _products(k: Known) -> Known:
    def applied(v: Vector) -> Vector:
        return tuple(_dot(r, v) for r in _rows(k))

    u, s, t = (_vector(k, n) for n in "ust")
    return {"ss": _dot(s, applied(s)), "st": _dot(s, applied(t)), "tt": _dot(t, applied(t)), "uu": _dot(u, applied(u))}


def _turned(k: Known) -> Known:
    angle = F.atan2(2 * k["st"], k["ss"] - k["tt"]) / 2
    middle, half = (k["ss"] + k["tt"]) / 2, (k["ss"] - k["tt"]) / 2
    spread = F.sqrt(half * half + k["st"] * k["st"])
    return {"cos": F.cos(angle), "sin": F.sin(angle), "high": middle + spread, "low": middle - spread}


def _ordered(k: Known) -> Known:
    u, s, t = (_vector(k, n) for n in "ust")
    g = [k["cos"] * a + k["sin"] * b for a, b in zip(s, t)]
    h = [k["cos"] * b - k["sin"] * a for a, b in zip(s, t)]
    # Falling order: the one apart is first or last; of the plane's two the higher goes first.
    return _named("v", [F.when(k["top"], a).otherwise(b) for a, b in zip(u, g)]) | _named("w", [F.when(k["top"], a).otherwise(b) for a, b in zip(g, h)])


def _signed(k: Known) -> Known:
    out: Known = {}
    for name in "vw":
        x, y, z = _vector(k, name)
        big = F.when((F.abs(x) >= F.abs(y)) & (F.abs(x) >= F.abs(z)), x).when(F.abs(y) >= F.abs(z), y).otherwise(z)
        out |= _named(f"{name}s", [F.when(big < 0, -c).otherwise(c) for c in (x, y, z)])
    return out


_STEPS: tuple[Callable[[Known], Known], ...] = (_scaled, _spread, _apart, _crossed, _lengths, _first, _plane, _second, _products, _turned, _ordered, _signed)


def eigen_of(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """``struct(eigenvalues, axes)`` of a symmetric 3x3 matrix; null if a cell is null.

    ``eigenvalues`` fall, ``axes`` holds the eigenvectors as columns of a
    row-major right-handed matrix. The cubic's trigonometric solution gives the
    eigenvalue that stands apart from the other two, the largest or the
    smallest; its vector is the longest cross product of two rows of what is
    left of the matrix without it, and the other two vectors come from the plane
    across, by one rotation. So equal eigenvalues, a zero matrix and flat sets
    need no special cases but a fixed choice of axes. The largest component of
    the first two axes is positive and the third one follows.
    """

    def step(known: Known, i: int) -> Column:
        if i == len(_STEPS):
            v, w = _vector(known, "vs"), _vector(known, "ws")
            last = _cross(v, w)
            top, scale = known["top"], known["scale"]
            values = F.array(
                F.when(top, known["uu"]).otherwise(known["high"]) * scale, F.when(top, known["high"]).otherwise(known["low"]) * scale, F.when(top, known["low"]).otherwise(known["uu"]) * scale
            )
            return F.struct(values.alias("eigenvalues"), F.array(*[axis[j] for j in range(3) for axis in (v, w, last)]).alias("axes"))
        new = _STEPS[i](known)
        return let(F.struct(*[c.alias(n) for n, c in new.items()]), lambda s: step(known | {n: s[n] for n in new}, i + 1))

    cells = {"xx": xx, "xy": xy, "xz": xz, "yy": yy, "yz": yz, "zz": zz}
    start = F.struct(*[c.cast("double").alias(n) for n, c in cells.items()], F.greatest(*[F.abs(c) for c in cells.values()]).cast("double").alias("biggest"))
    there = xx.isNotNull()
    for c in (xy, xz, yy, yz, zz):
        there = there & c.isNotNull()
    return F.when(there, let(start, lambda s: step({n: s[n] for n in (*cells, "biggest")}, 0)))


def symmetric_eigen(df: DataFrame, cells: Sequence[str] = ("xx", "xy", "xz", "yy", "yz", "zz")) -> DataFrame:
    """Add ``eigenvalues`` and ``axes`` of the matrix in six columns (``eigen_of``)."""
    solved = df.withColumn("__eigen", eigen_of(*[F.col(c) for c in cells]))
    return solved.select(*df.columns, "__eigen.eigenvalues", "__eigen.axes")


def symmetric_eigenvalues(df: DataFrame, cells: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Add the three eigenvalues alone, falling, by the cubic's trigonometric solution."""
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in cells)
    out = df.withColumn("__q", (xx + yy + zz) / 3)
    a, b, c = xx - F.col("__q"), yy - F.col("__q"), zz - F.col("__q")
    out = out.withColumn("__p", F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6))
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    p = F.col("__p")
    half = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.when(p.isNotNull(), F.lit(1.0)))))
    out = out.withColumn("__turn", F.acos(half) / 3)
    high, low = F.col("__q") + 2 * p * F.cos("__turn"), F.col("__q") + 2 * p * F.cos(F.col("__turn") + 2 * math.pi / 3)
    return out.select(*df.columns, high.alias(names[0]), (3 * F.col("__q") - high - low).alias(names[1]), low.alias(names[2]))
