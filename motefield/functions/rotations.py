"""Rotations as column expressions: matrices are array<double> of nine, row by row; quaternions put the scalar first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motefield.functions.vectors import dot, let, norm

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def _array(values) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in values])


def quaternion_to_matrix(q: Column) -> Column:
    def cells(v: Column) -> Column:
        w, x, y, z = (F.get(v, i) for i in range(4))
        return _array([
            1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - w * z), 2.0 * (x * z + w * y),
            2.0 * (x * y + w * z), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - w * x),
            2.0 * (x * z - w * y), 2.0 * (y * z + w * x), 1.0 - 2.0 * (x * x + y * y),
        ])

    return let(q, cells)


def scalar_last(q: Column) -> Column:
    """(w, x, y, z) to (x, y, z, w)."""
    return F.concat(F.slice(q, 2, 3), F.slice(q, 1, 1))


def scalar_first(q: Column) -> Column:
    """(x, y, z, w) to (w, x, y, z)."""
    return F.concat(F.slice(q, 4, 1), F.slice(q, 1, 3))


def axis_angle_to_quaternion(a: Column) -> Column:
    """[angle, x, y, z] to a unit quaternion; a zero axis is no rotation."""
    half = F.get(a, 0) / 2.0

    def turned(length: Column) -> Column:
        scaled = F.transform(F.slice(a, 2, 3), lambda v: v / length * F.sin(half))
        return F.when(length > 0, F.concat(F.array(F.cos(half)), scaled)).otherwise(_array([1, 0, 0, 0]))

    return let(norm(F.slice(a, 2, 3)), turned)


def axis_angle_to_matrix(a: Column) -> Column:
    """[angle, x, y, z] to a matrix; a missing pose or a zero axis is the identity."""
    turned = let(axis_angle_to_quaternion(a), quaternion_to_matrix)
    return F.when(a.isNull() | (F.size(a) != 4), _array(IDENTITY)).otherwise(turned)


def matrix_to_quaternion(m: Column) -> Column:
    """Unit quaternion of a rotation matrix with a scalar that is not negative.

    The four diagonal combinations are the squared components times four; the
    row belonging to the largest one is scaled to unit length.
    """

    def candidates(v: Column) -> Column:
        r = [F.get(v, i) for i in range(9)]
        wx, wy, wz = r[7] - r[5], r[2] - r[6], r[3] - r[1]
        xy, xz, yz = r[1] + r[3], r[2] + r[6], r[5] + r[7]
        rows = [
            (1.0 + r[0] + r[4] + r[8], wx, wy, wz),
            (wx, 1.0 + r[0] - r[4] - r[8], xy, xz),
            (wy, xy, 1.0 - r[0] + r[4] - r[8], yz),
            (wz, xz, yz, 1.0 - r[0] - r[4] + r[8]),
        ]
        return F.array(*[F.struct(row[i].alias("size"), F.array(*row).alias("row")) for i, row in enumerate(rows)])

    def scaled(row: Column) -> Column:
        size = norm(row) * F.when(F.get(row, 0) < 0, -1.0).otherwise(1.0)
        return let(size, lambda n: F.transform(row, lambda v: v / n))

    return let(F.array_max(let(m, candidates))["row"], scaled)


def matrix_to_axis_angle(m: Column) -> Column:
    """[angle, x, y, z] with the angle in [0, pi]; no rotation has the x axis."""

    def from_quaternion(q: Column) -> Column:
        def turned(length: Column) -> Column:
            unit = F.transform(F.slice(q, 2, 3), lambda v: v / length)
            angle = 2.0 * F.atan2(length, F.get(q, 0))
            return F.when(length < 1e-12, _array([0, 1, 0, 0])).otherwise(F.concat(F.array(angle), unit))

        return let(norm(F.slice(q, 2, 3)), turned)

    return let(matrix_to_quaternion(m), from_quaternion)


def matrix_to_euler(m: Column) -> Column:
    """Extrinsic x-y-z angles in degrees."""

    def angles(v: Column) -> Column:
        y = F.asin(F.least(F.greatest(-F.get(v, 6), F.lit(-1.0)), F.lit(1.0)))
        return F.array(F.degrees(F.atan2(F.get(v, 7), F.get(v, 8))), F.degrees(y), F.degrees(F.atan2(F.get(v, 3), F.get(v, 0))))

    return let(m, angles)


def euler_to_matrix(e: Column) -> Column:
    """Matrix of extrinsic x-y-z angles in degrees."""

    def cells(t: Column) -> Column:
        (cx, sx), (cy, sy), (cz, sz) = ((F.get(t, i), F.get(t, 3 + i)) for i in range(3))
        return F.array(
            cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx,
            sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx,
            -sy, cy * sx, cy * cx,
        )

    radians = F.transform(e, lambda v: F.radians(v))
    return let(F.concat(F.transform(radians, lambda v: F.cos(v)), F.transform(radians, lambda v: F.sin(v))), cells)


def transform_to_rotation(t: Column) -> Column:
    """Rotation part of a 4x4 or 3x3 transform stored row by row; the identity for anything else."""
    upper = F.concat(*[F.slice(t, 1 + 4 * row, 3) for row in range(3)])
    return F.when(F.size(t) == 16, upper).when(F.size(t) == 9, t).otherwise(_array(IDENTITY))


def matrix_product(a: Column, b: Column, transpose_b: bool = False) -> Column:
    """Product of two matrices, the second one transposed on request."""

    def cells(x: Column, y: Column) -> Column:
        return F.array(*[
            sum(F.get(x, 3 * i + k) * F.get(y, 3 * j + k if transpose_b else 3 * k + j) for k in range(3)) for i in range(3) for j in range(3)
        ])

    return let(a, lambda x: let(b, lambda y: cells(x, y)))


def geodesic(a: Column, b: Column) -> Column:
    """Angle in radians between two rotations."""
    trace = F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(3.0))
    return F.acos((trace - 1.0) / 2.0)


def quaternion_distance(a: Column, b: Column) -> Column:
    return 1.0 - F.abs(dot(a, b))
