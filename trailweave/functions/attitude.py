"""Quaternions (w, x, y, z) and rotations, as column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(a: Column, n: int) -> list[Column]:
    return [F.get(a, i) for i in range(n)]


def rotation(q: Column) -> list[list[Column]]:
    """Nine expressions, device to world; a quaternion without length is the identity."""
    w, x, y, z = parts(q, 4)
    norm = F.sqrt(w * w + x * x + y * y + z * z)
    none = norm < 1e-12
    w, x, y, z = (F.when(none, d).otherwise(c / norm) for c, d in ((w, 1.0), (x, 0.0), (y, 0.0), (z, 0.0)))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def rotation_matrix(q: Column) -> Column:
    return F.array(*[F.array(*row) for row in rotation(q)])


def to_world(vector: Column, q: Column) -> Column:
    v = parts(vector, 3)
    return F.array(*[row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in rotation(q)])


def yaw_rate_world(rate: Column, q: Column) -> Column:
    v, row = parts(rate, 3), rotation(q)[2]
    return row[0] * v[0] + row[1] * v[1] + row[2] * v[2]


def gravity_device(q: Column) -> Column:
    """Gravity in the device frame, in g."""
    return F.array(*[-c for c in rotation(q)[2]])


def longitudinal(a_world: Column, psi: Column) -> Column:
    return F.get(a_world, 0) * F.cos(psi) + F.get(a_world, 1) * F.sin(psi)


def from_euler(yaw: Column, pitch: Column, roll: Column) -> Column:
    (cy, sy), (cp, sp), (cr, sr) = ((F.cos(a / 2), F.sin(a / 2)) for a in (yaw, pitch, roll))
    return F.array(cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy)


def product(a: Column, b: Column) -> Column:
    """Hamilton product."""
    (p, i, j, k), (w, x, y, z) = parts(a, 4), parts(b, 4)
    return F.array(p * w - i * x - j * y - k * z, p * x + i * w + j * z - k * y, p * y - i * z + j * w + k * x, p * z + i * y - j * x + k * w)


def from_gravity(force: Column) -> Column:
    """The rotation about a horizontal axis that turns the measured force up; identity without force, half a turn about x if it points down."""
    x, y, z = parts(force, 3)
    norm = F.sqrt(x * x + y * y + z * z)
    x, y, z = x / norm, y / norm, z / norm
    s = F.sqrt(x * x + y * y)
    half = F.atan2(s, z) / 2
    turned = F.array(F.cos(half), y / s * F.sin(half), -x / s * F.sin(half), F.lit(0.0))
    level = F.when(z > 0, F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))).otherwise(F.array(*map(F.lit, (0.0, 1.0, 0.0, 0.0))))
    return F.when(norm < 1e-9, F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))).when(s < 1e-9, level).otherwise(turned)
