"""Travel speeds, model features and preference costs of trail edges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fellwalk.functions.geo import clamp
from fellwalk.functions.trails import CAR_ROADS, choose, way_class

# Fixed values of the expert speed model (km/h, factors) and of the preferences.
KMH = 1 / 3.6
BIKE_SURFACE = {"paved": 22, "gravel": 16, "dirt": 13, "grass": 9, "rock": 6}
MOTO_SURFACE = {"paved": 50, "gravel": 35, "dirt": 25, "grass": 15, "rock": 10}
MOTO_GRADE = {1: 35, 2: 28, 3: 20, 4: 13, 5: 8}
MTB_FACTOR = {0: 1.0, 1: 0.85, 2: 0.65, 3: 0.45, 4: 0.25, 5: 0.15, 6: 0.1}
CLASSES = ["path", "track", "road", "cycleway", "steps"]
SURFACE_CLASSES = ["paved", "gravel", "dirt", "grass", "rock", "unknown"]
DEFAULT_PREFS = {"mode": "foot", "hidden": 0.0, "offroad": 0.0, "max_difficulty": 4, "max_mtb_scale": 3, "strict_access": False,
                 "avoid_car_roads": True, "avoid_wildlife": 0.5}
LEARNED_CLAMP = (-1.2, 0.7)


def _c(name):
    return F.col(name)


def slope(length, ele_a, ele_b) -> Column:
    """Rise over run clamped to -1..1, 0 when a height is unknown or both ends are at one position."""
    known = ele_a.isNotNull() & ele_b.isNotNull() & (length > 0)
    return F.when(known, clamp((ele_b - ele_a) / length, -1.0, 1.0)).otherwise(0.0)


def tobler(s: Column) -> Column:
    return 6 * F.exp(-3.5 * F.abs(s + 0.05)) * KMH


def foot_speed(s: Column) -> Column:
    kind = F.when(_c("kind").isin("hidden", "detected"), 0.85).when(_c("kind") == "path", 0.95).otherwise(1.0)
    hard = F.when(_c("difficulty") >= 5, 0.45).when(_c("difficulty") >= 4, 0.6).when(_c("difficulty") >= 3, 0.8).otherwise(1.0)
    return tobler(s) * kind * hard * F.when(_c("surface_class") == "rock", 0.85).otherwise(1.0)


def bike_speed(s: Column) -> Column:
    by_kind = F.when(_c("kind") == "road", 18).when(_c("kind") == "track", 13).otherwise(9)
    base = F.coalesce(choose(_c("surface_class"), BIKE_SURFACE), by_kind).cast("double")
    tech = F.coalesce(choose(_c("mtb_scale"), MTB_FACTOR), F.when(_c("difficulty") == 3, 0.5), F.lit(1.0))
    b = base * tech
    v = F.when(s > 0, b / (1 + 14 * s)).when(s > -0.12, b * (1 - 3 * s)).otherwise(b * 0.7)
    push = (_c("highway") == "steps") | (_c("difficulty") >= 4)
    return F.when(push, 2 * KMH).otherwise(F.greatest(v * KMH, tobler(s) * 0.75))


def moto_speed(s: Column) -> Column:
    by_kind = F.when(_c("kind") == "road", 40).when(_c("kind") == "track", 20).otherwise(0)
    base = F.coalesce(choose(_c("track_grade"), MOTO_GRADE), F.when(_c("track_grade") == 0, choose(_c("surface_class"), MOTO_SURFACE)), by_kind).cast("double")
    return F.when(F.abs(s) > 0.45, 0.0).otherwise(base / (1 + 3 * F.abs(s)) * KMH)


def expert_speed(mode: Column, s: Column) -> Column:
    """Metres per second; 0 is impassable."""
    return F.when(mode == "foot", foot_speed(s)).when(mode == "bike", bike_speed(s)).otherwise(moto_speed(s))


def route_features(s: Column) -> Column:
    """The 21 model inputs as one array."""
    cls, lim = way_class(_c("highway")), clamp(s, -0.5, 0.5)
    mtb = _c("mtb_scale")
    feats = [(cls == c).cast("double") for c in CLASSES] + [(_c("surface_class") == c).cast("double") for c in SURFACE_CLASSES]
    feats += [_c("track_grade") / 5, (_c("track_grade") > 0).cast("double"), _c("difficulty") / 6,
              F.when(mtb >= 0, (mtb + 1) / 7).otherwise(0.0), (mtb >= 0).cast("double"), (_c("kind") == "marked").cast("double"),
              lim * 4, lim * lim * 16, F.greatest(F.lit(0.0), lim) * 4, F.greatest(F.lit(0.0), -lim) * 4]
    return F.array(*feats)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def mlp(x: Column, w1: Column, b1: Column, w2: Column, b2: Column) -> Column:
    """One hidden tanh layer; w1 is an array of rows."""
    h = F.zip_with(w1, b1, lambda row, b: F.tanh(b + dot(row, x)))
    return b2 + dot(w2, h)


def learned_speed(expert: Column, x: Column, weights: Column) -> Column:
    """Expert speed times exp of the clamped correction; the expert alone where weights is null."""
    r = clamp(mlp(x, weights["w1"], weights["b1"], weights["w2"], weights["b2"]), *LEARNED_CLAMP)
    return F.when(weights.isNull(), expert).otherwise(expert * F.exp(r))


def access_of(mode: Column) -> Column:
    return F.when(mode == "foot", _c("access_foot")).when(mode == "bike", _c("access_bike")).otherwise(_c("access_moto"))


def allowed(p: Column) -> Column:
    """Legal access and difficulty limits for preference struct p."""
    a = access_of(p["mode"])
    closed = (a == "no") | ((a == "unknown") & p["strict_access"])
    return ~(closed | ((p["mode"] == "foot") & (_c("difficulty") > p["max_difficulty"])) | ((p["mode"] == "bike") & (_c("mtb_scale") > p["max_mtb_scale"])))


def preference_cost(p: Column) -> Column:
    """Cost multiplier of the soft preferences; `wildlife_penalty` may be null."""
    detected = _c("kind") == "detected"
    h = F.when(detected, 1.0).otherwise(_c("hidden_score"))
    bike = p["mode"] == "bike"
    quiet = bike & p["avoid_car_roads"] & ~_c("highway").isin(*CAR_ROADS)
    m = 1 - 0.4 * p["hidden"] * h
    m = m * F.when((p["offroad"] > 0) & (_c("surface_class") == "paved"), 1 + 0.8 * p["offroad"]).otherwise(1.0)
    m = m * F.when(detected, 1 + 0.3 * (1 - _c("confidence"))).otherwise(1.0)
    m = m * F.when((access_of(p["mode"]) == "unknown") & ~quiet, 1.1).otherwise(1.0)
    m = m * F.when(bike & p["avoid_car_roads"], 1 + 5 * _c("car_traffic")).otherwise(1.0)
    return m * (1 + p["avoid_wildlife"] * F.coalesce(_c("wildlife_penalty"), F.lit(0.0)))


def prefs(**over) -> Column:
    v = {**DEFAULT_PREFS, **over}
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(k) for k, c in v.items()])
