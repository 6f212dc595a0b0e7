"""Positions on the sphere and on WGS84."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))


def to_local(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """East and north metres on the plane that touches the sphere at the origin."""
    east = EARTH_RADIUS_M * F.cos(F.radians(F.lit(lat0))) * F.radians(lon - lon0)
    return east, EARTH_RADIUS_M * F.radians(lat - lat0)


def to_geo(east: Column, north: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    lat = lat0 + F.degrees(north / EARTH_RADIUS_M)
    return lat, lon0 + F.degrees(east / (EARTH_RADIUS_M * F.cos(F.radians(F.lit(lat0)))))


def inverse_arrays(lat1, lon1, lat2, lon2, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Vincenty's inverse on WGS84: metres and initial azimuth (radians clockwise from north); NaN where it does not settle."""
    f, b = WGS84_F, WGS84_A * (1 - WGS84_F)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    span = np.radians(np.asarray(lon2, float) - lon1)
    lam, settled = span.copy(), np.zeros(span.shape, bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(rounds):
            x, y = np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)
            sin_s = np.hypot(x, y)
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            s = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s, 0.0)
            cos2_a = 1 - sin_a**2
            cos_2m = np.where(cos2_a > 1e-15, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2_a, 0.0)
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = span + (1 - c) * f * sin_a * (s + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if settled.all():
                break
        k2 = cos2_a * (WGS84_A**2 - b**2) / b**2
        big_a = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
        big_b = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
        ds = big_b * sin_s * (cos_2m + big_b / 4 * (cos_s * (2 * cos_2m**2 - 1) - big_b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))
        metres = np.where(sin_s == 0, 0.0, b * big_a * (s - ds))
    return np.where(settled, metres, np.nan), np.arctan2(x, y)


def direct_arrays(lat1, lon1, azimuth, metres, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Vincenty's direct on WGS84: latitude and longitude in degrees."""
    f, b = WGS84_F, WGS84_A * (1 - WGS84_F)
    u1 = np.arctan((1 - f) * np.tan(np.radians(lat1)))
    s1 = np.arctan2(np.tan(u1), np.cos(azimuth))
    sin_a = np.cos(u1) * np.sin(azimuth)
    cos2_a = 1 - sin_a**2
    k2 = cos2_a * (WGS84_A**2 - b**2) / b**2
    big_a = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
    big_b = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
    s = metres / (b * big_a)
    for _ in range(rounds):
        m = np.cos(2 * s1 + s)
        ds = big_b * np.sin(s) * (m + big_b / 4 * (np.cos(s) * (2 * m**2 - 1) - big_b / 6 * m * (4 * np.sin(s) ** 2 - 3) * (4 * m**2 - 3)))
        new = metres / (b * big_a) + ds
        if np.all(np.abs(new - s) < 1e-12):
            s = new
            break
        s = new
    m = np.cos(2 * s1 + s)
    lat = np.arctan2(np.sin(u1) * np.cos(s) + np.cos(u1) * np.sin(s) * np.cos(azimuth), (1 - f) * np.hypot(sin_a, np.sin(u1) * np.sin(s) - np.cos(u1) * np.cos(s) * np.cos(azimuth)))
    lam = np.arctan2(np.sin(s) * np.sin(azimuth), np.cos(u1) * np.cos(s) - np.sin(u1) * np.sin(s) * np.cos(azimuth))
    c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
    lon = lam - (1 - c) * f * sin_a * (s + c * np.sin(s) * (m + c * np.cos(s) * (2 * m**2 - 1)))
    return np.degrees(lat), lon1 + np.degrees(lon)


def vincenty(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Struct of metres and azimuth."""

    @F.pandas_udf("metres double, azimuth double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        metres, azimuth = inverse_arrays(a.to_numpy(), b.to_numpy(), c.to_numpy(), d.to_numpy())
        return pd.DataFrame({"metres": metres, "azimuth": azimuth})

    return run(lat1, lon1, lat2, lon2)


def local_wgs84(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Azimuthal equidistant east and north about an origin."""
    v = vincenty(F.lit(lat0), F.lit(lon0), lat, lon)
    return F.struct((v["metres"] * F.sin(v["azimuth"])).alias("east"), (v["metres"] * F.cos(v["azimuth"])).alias("north"))
