"""Plausibility gates and one-step motion formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import wrap_angle


def usable(t: Column, lat: Column, lon: Column, accuracy: Column) -> Column:
    """A fix with a non-negative accuracy, finite coordinates in range and a finite time from zero on."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = (accuracy >= 0) & finite(lat) & finite(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & finite(t) & (t >= 0)
    return F.coalesce(good, F.lit(False))


def rejection(is_usable: Column, accuracy: Column) -> Column:
    """Why a fix is dropped: an accuracy of zero counts as missing here, and a missing one as negative."""
    missing = F.when(F.coalesce(accuracy, F.lit(0.0)) == 0, -1.0).otherwise(accuracy)
    return F.when(is_usable, None).when(missing < 0, "negative_accuracy").otherwise("invalid_coordinates_or_time")


def valid_course(course: Column, accuracy: Column) -> Column:
    return F.coalesce((course >= 0) & (accuracy.isNull() | (accuracy >= 0)), F.lit(False))


def measurement_sigma(accuracy: Column, floor: float = 5.0, scale: float = 1.0, worst: float = 50.0) -> Column:
    return F.when(accuracy.isNull() | (accuracy < 0), worst).otherwise(F.greatest(F.lit(floor), scale * accuracy))


def reach(dt: Column, speed: Column, accel: float = 6.0, top: float = 45.0, margin: float = 25.0) -> Column:
    """Metres within reach: accelerate to the top speed, then cruise, and a margin."""
    dt, v = F.greatest(dt, F.lit(0.0)), F.greatest(F.lit(0.0), F.least(speed, F.lit(top)))
    rise = (top - v) / accel
    short = v * dt + 0.5 * accel * dt * dt
    long = v * rise + 0.5 * accel * rise * rise + top * (dt - rise)
    return F.when(dt <= rise, short).otherwise(long) + margin


def mahalanobis(rx: Column, ry: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    """Squared distance under a 2x2 covariance; infinite where that is singular or the result is no distance."""
    det = sxx * syy - sxy * sxy
    d2 = F.try_divide(syy * rx * rx - 2 * sxy * rx * ry + sxx * ry * ry, det)
    return F.when(d2.isNull() | F.isnan(d2) | (d2 < 0), float("inf")).otherwise(d2)


def bounded_displacement(v: Column, a: Column, dt: Column, top: Column) -> Column:
    """Way under a speed kept in [0, top], and its derivatives by speed and acceleration."""
    stops, tops = (a < 0) & (v + a * dt < 0), (a > 0) & (v + a * dt > top)
    active = F.when(stops, F.greatest(F.lit(0.0), -v / a)).when(tops, F.greatest(F.lit(0.0), (top - v) / a)).otherwise(dt)
    way = v * active + 0.5 * a * active * active + F.when(tops, top).otherwise(0.0) * (dt - active)
    return F.struct(way.alias("way"), active.alias("by_speed"), (0.5 * active * active).alias("by_accel"))


def compensated(a: Column, bias: Column, limit: float = 6.0, deadband: float | None = None) -> Column:
    """Acceleration less its bias, clipped; ``lost`` where the result no longer follows the input."""
    raw = a - bias
    clipped = F.greatest(F.lit(-limit), F.least(F.lit(limit), raw))
    full = F.abs(raw) >= limit
    small = (~full & (F.abs(clipped) < deadband)) if deadband is not None else F.lit(False)
    return F.struct(F.when(small, 0.0).otherwise(clipped).alias("a"), (full | small).alias("lost"))


def propagated(e: Column, n: Column, v: Column, psi: Column, ba: Column, bw: Column, a: Column, w: Column, dt: Column, top: float = 45.0, limit: float = 6.0) -> Column:
    """One step of the six-state motion model."""
    hat, rate = compensated(a, ba, limit)["a"], w - bw
    middle = psi + 0.5 * rate * dt
    step = bounded_displacement(v, hat, dt, F.lit(top))["way"]
    return F.struct(
        (e + step * F.cos(middle)).alias("e"),
        (n + step * F.sin(middle)).alias("n"),
        F.least(F.greatest(F.lit(0.0), v + hat * dt), F.lit(top)).alias("v"),
        wrap_angle(psi + rate * dt).alias("psi"),
    )


def cross_track_sigma(since: Column, base: float = 4.0, rate: float = 0.15) -> Column:
    return base + rate * F.greatest(F.lit(0.0), since)


def clip_radius(outage: Column, speed: float = 15.0, floor: float = 8000.0, cap: float = 25000.0) -> Column:
    return F.least(F.greatest(3000.0 + outage * speed, F.lit(floor)), F.lit(cap))


def deployment_sigma(sigma: Column, gap: Column) -> Column:
    clip = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    return clip(sigma * clip(gap, 1.5, 3.0), 1.5, 20.0)


#: What a turn of the vehicle is taken for: the shape of its yaw rate ("corner", "curve" or "plain", a turn may be only one
#: of them), whether the map has a junction and whether it has a bend there.
TURN_KINDS = {
    # shape: (junction and bend, junction only, bend only, neither)
    "corner": ("junction", "junction", "bend", "reject"),
    "curve": ("bend", "junction", "bend", "reject"),
    "plain": ("ambiguous", "junction", "bend", "reject"),
}


def classify_event(delta: Column, peak: Column, duration: Column, bend: Column, gap_deg: Column) -> Column:
    """junction, bend, ambiguous or reject, by ``TURN_KINDS``: a corner is fast and keeps up most of its peak rate, a curve
    is slow and long, and a junction counts if its nearest branch lies within 18 degrees of the turn."""
    filled = F.abs(delta) / F.greatest(peak * duration, F.lit(1e-6))
    shape = F.when((peak > 0.18) & (filled > 0.75), "corner").when((peak < 0.16) & (duration > 6.0), "curve").otherwise("plain")
    column = F.when(gap_deg < 18.0, F.when(bend, 0).otherwise(1)).otherwise(F.when(bend, 2).otherwise(3))
    table = F.create_map(*[x for shape_, kinds in TURN_KINDS.items() for x in (F.lit(shape_), F.array(*map(F.lit, kinds)))])
    return F.get(table[shape], column)
