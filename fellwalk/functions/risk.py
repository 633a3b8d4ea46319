"""Density encoding, season, light, sun and risk index as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fellwalk.functions.geo import clamp, col, round_half_up

# Density byte scale, factors, index scale, zone colours, level bands.
LOG_MIN, LOG_MAX, STEPS = -4.0, 1.0, 254
SEASON = [0.25, 0.3, 0.6, 0.9, 1.0, 1.0, 1.0, 1.1, 1.25, 1.25, 0.8, 0.35]
LIGHT = {"day": 0.8, "twilight": 1.5, "night": 1.3}
MODE = {"foot": 1.0, "bike": 1.3, "moto": 0.7, "car": 0.3}
INDEX_LOW, INDEX_HIGH = 0.002, 3.0
LEVELS = [(20, "low"), (45, "moderate"), (70, "high")]
ZONE_STOPS = [(0, (255, 213, 79, 0.0)), (18, (255, 213, 79, 0.0)), (30, (255, 202, 40, 0.14)),
              (50, (251, 140, 0, 0.24)), (70, (229, 57, 53, 0.32)), (100, (183, 28, 28, 0.42))]
SUN_HORIZON = -0.833


def decode_density(q) -> Column:
    q = col(q)
    return F.when(q == 0, 0.0).otherwise(F.pow(F.lit(10.0), LOG_MIN + (q - 1) / STEPS * (LOG_MAX - LOG_MIN)))


def encode_density(d) -> Column:
    d = col(d)
    q = 1 + F.bround((F.log10(d) - LOG_MIN) / (LOG_MAX - LOG_MIN) * STEPS, 0)
    return F.when(d > 1e-4, clamp(q, 0, 255)).otherwise(0).cast("int")


def season_factor(ts, tz: str = "UTC") -> Column:
    local = F.month(F.from_utc_timestamp(col(ts).cast("timestamp"), tz))
    return F.element_at(F.array(*[F.lit(v) for v in SEASON]), local)


def sun_elevation_ms(ms, lng, lat) -> Column:
    """Degrees above the horizon at epoch milliseconds (short almanac series)."""
    ms, lng, lat = map(col, (ms, lng, lat))
    n = ms / 86400000.0 + 2440587.5 - 2451545.0
    mean_l = (280.46 + 0.9856474 * n) % 360
    g = F.radians((357.528 + 0.9856003 * n) % 360)
    lam = F.radians(mean_l + 1.915 * F.sin(g) + 0.02 * F.sin(2 * g))
    eps = F.radians(23.439 - 0.0000004 * n)
    decl = F.asin(F.sin(eps) * F.sin(lam))
    ra = F.atan2(F.cos(eps) * F.sin(lam), F.cos(lam))
    gmst = (18.697374558 + 24.06570982441908 * n) % 24
    ha = F.radians(gmst * 15 + lng) - ra
    phi = F.radians(lat)
    return F.degrees(F.asin(F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(ha)))


def epoch_ms(ts) -> Column:
    return F.unix_millis(col(ts).cast("timestamp"))


def light_phase(elevation) -> Column:
    e = col(elevation)
    return F.when(e > 6, "day").when(e > -6, "twilight").otherwise("night")


def light_factor(phase) -> Column:
    p = col(phase)
    return F.when(p == "day", LIGHT["day"]).when(p == "twilight", LIGHT["twilight"]).otherwise(LIGHT["night"])


def mode_factor(mode) -> Column:
    m = col(mode)
    out = F.when(m == "foot", MODE["foot"])
    for k in ("bike", "moto", "car"):
        out = out.when(m == k, MODE[k])
    return out.otherwise(1.0)


def _is_up(ms: np.ndarray, lng: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Whether the sun of `sun_elevation_ms` is above the horizon."""
    n = ms / 86400000.0 + 2440587.5 - 2451545.0
    g = np.radians(np.fmod(357.528 + 0.9856003 * n, 360))
    lam = np.radians(np.fmod(280.46 + 0.9856474 * n, 360) + 1.915 * np.sin(g) + 0.02 * np.sin(2 * g))
    eps = np.radians(23.439 - 0.0000004 * n)
    decl = np.arcsin(np.sin(eps) * np.sin(lam))
    ha = np.radians(np.fmod(18.697374558 + 24.06570982441908 * n, 24) * 15 + lng) - np.arctan2(np.cos(eps) * np.sin(lam), np.cos(lam))
    phi = np.radians(lat)
    return np.degrees(np.arcsin(np.sin(phi) * np.sin(decl) + np.cos(phi) * np.cos(decl) * np.cos(ha))) >= SUN_HORIZON


def next_sunset_ms(ms, lng, lat) -> Column:
    """First falling crossing of the horizon within 24 h: ten-minute steps, then 12 bisections; null if none.

    The 157 positions of the sun of each row are worked out in Arrow batches, as arrays.
    """
    step = 600000.0

    def sunset(ms: pd.Series, lng: pd.Series, lat: pd.Series) -> pd.Series:
        out = np.full(len(ms), np.nan)
        for lo in range(0, len(out), 1024):
            t, x, y = (c.to_numpy(dtype=float)[lo:lo + 1024] for c in (ms, lng, lat))
            up = _is_up(t[:, None] + np.arange(145) * step, x[:, None], y[:, None])
            falls = up[:, :-1] & ~up[:, 1:]
            k = np.flatnonzero(falls.any(axis=1))
            a = t[k] + falls[k].argmax(axis=1) * step
            b = a + step
            for _ in range(12):
                m = (a + b) / 2
                day = _is_up(m, x[k], y[k])
                a, b = np.where(day, m, a), np.where(day, b, m)
            out[lo + k] = (a + b) / 2
        return pd.Series(out)

    return F.pandas_udf(sunset, "double")(col(ms).cast("double"), col(lng), col(lat))


def risk_index(d) -> Column:
    d = col(d)
    lo, hi = math.log10(INDEX_LOW), math.log10(INDEX_HIGH)
    return F.when(d <= 0, 1).otherwise(clamp(round_half_up(1 + 99 * (F.log10(d) - lo) / (hi - lo)), 1, 100)).cast("int")


def risk_level(index) -> Column:
    i = col(index)
    out = None
    for limit, name in LEVELS:
        out = F.when(i < limit, name) if out is None else out.when(i < limit, name)
    return out.otherwise("very-high")


def zone_rgba(index) -> list[Column]:
    """Red, green, blue, alpha (0..1) interpolated between the fixed stops."""
    i = col(index)
    bands = list(zip(ZONE_STOPS, ZONE_STOPS[1:]))
    out = []
    for k in range(4):
        c = None
        for (a, ca), (b, cb) in bands:
            v = ca[k] + (cb[k] - ca[k]) * ((i - a) / (b - a))
            c = F.when(i <= b, v) if c is None else c.when(i <= b, v)
        out.append(c.otherwise(float(ZONE_STOPS[-1][1][k])))
    return out
