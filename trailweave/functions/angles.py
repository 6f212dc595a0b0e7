"""Angles and headings, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def modulo(x: Column, period: float) -> Column:
    """Remainder with the sign of the period."""
    return x - period * F.floor(x / period)


def wrap_angle(x: Column) -> Column:
    """Radians into (-pi, pi]."""
    w = modulo(x + math.pi, 2 * math.pi) - math.pi
    return F.when(w <= -math.pi, w + 2 * math.pi).otherwise(w)


def wrap_angle_deg(x: Column) -> Column:
    """Degrees into (-180, 180]."""
    w = modulo(x + 180.0, 360.0) - 180.0
    return F.when(w <= -180.0, w + 360.0).otherwise(w)


def course_to_heading(course_deg: Column) -> Column:
    """Degrees clockwise from north to radians counter-clockwise from east."""
    return wrap_angle(F.radians(90.0 - course_deg))


def heading_to_course(psi: Column) -> Column:
    """Inverse of ``course_to_heading``, in [0, 360)."""
    return modulo(90.0 - F.degrees(psi), 360.0)


def turn_kind(angle: Column, threshold_deg: float = 25.0) -> Column:
    limit = math.radians(threshold_deg)
    return F.when(angle > limit, "left").when(angle < -limit, "right").otherwise("straight")


def turn_log_likelihood(map_turn: Column, measured: Column, sigma: Column, dof: float = 4.0) -> Column:
    """Student-t score of having taken a turn."""
    z = wrap_angle(map_turn - measured) / F.greatest(sigma, F.lit(1e-6))
    return -0.5 * (dof + 1.0) * F.log1p(z * z / dof)
