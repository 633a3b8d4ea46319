"""Tag rules of ways and points of interest as column expressions over a `tags` map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fellwalk.functions.geo import clamp

# Fixed values of the classification.
SAC_SCALE = ["hiking", "mountain_hiking", "demanding_mountain_hiking", "alpine_hiking", "demanding_alpine_hiking", "difficult_alpine_hiking"]
MARK_COLORS = {"red": "#d7263d", "blue": "#1f6fd1", "yellow": "#f2c418", "green": "#2e9e44", "white": "#f5f5f5",
               "black": "#222222", "orange": "#f28c18", "purple": "#8e44ad", "brown": "#8b5a2b"}
HIDDEN_THRESHOLD = 0.6
ROAD_HIGHWAYS = ["tertiary", "unclassified", "residential", "living_street", "service"]
CAR_ROADS = ["tertiary", "unclassified", "residential"]
PATH_HIGHWAYS = ["path", "footway", "bridleway", "cycleway", "steps", "via_ferrata", "pedestrian"]
ACCESS_KEYS = {"foot": ["access", "foot"], "bike": ["access", "vehicle", "bicycle"],
               "moto": ["access", "vehicle", "motor_vehicle", "motorcycle"]}
ACCESS_YES = ["yes", "designated", "permissive", "destination", "customers"]
ACCESS_NO = ["no", "private", "forestry", "agricultural", "delivery", "military", "discouraged"]
SURFACES = {
    "paved": "asphalt|concrete.*|paved|paving_stones|sett|cobblestone|metal|wood",
    "gravel": "gravel|fine_gravel|compacted|pebblestone|chipseal",
    "dirt": "dirt|earth|ground|mud|unpaved|sand|clay|soil",
    "grass": "grass|grass_paver|meadow",
    "rock": "rock|stone|bare_rock|scree|stepping_stones",
}
GRADE_SURFACE = ["gravel", "gravel", "dirt", "grass", "grass"]
TRAFFIC_BASE = {"motorway": 1.0, "trunk": 1.0, "primary": 1.0, "secondary": 0.95, "tertiary": 0.8, "unclassified": 0.55,
                "residential": 0.5, "living_street": 0.25, "service": 0.3, "track": 0.15, "road": 0.6}
TRAFFIC_CLOSED = ["no", "private", "forestry", "agricultural", "delivery"]
TRAFFIC_LOOSE = ["dirt", "earth", "ground", "grass", "gravel", "fine_gravel", "mud", "sand", "unpaved", "compacted"]
TRAFFIC_QUIET_SERVICE = ["driveway", "parking_aisle", "alley"]
POI_RULES = [("peak", "natural", ["peak"]), ("saddle", "natural", ["saddle"]), ("waterfall", "waterway", ["waterfall"]),
             ("spring", "natural", ["spring"]), ("cave", "natural", ["cave_entrance"]), ("viewpoint", "tourism", ["viewpoint"]),
             ("hut", "tourism", ["alpine_hut", "wilderness_hut"]), ("shelter", "amenity", ["shelter"]), ("camp", "tourism", ["camp_site"])]
KIND_NAME = {"marked": "the marked trail", "path": "the path", "track": "the forest track", "road": "the road",
             "hidden": "the hidden trail", "detected": "the unmapped trail"}


def tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def choose(value: Column, table: dict, default=None) -> Column:
    """Lookup in a small fixed table as one CASE expression."""
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def number_prefix(c: Column) -> Column:
    """Leading decimal number of a text, null when there is none."""
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def sac_level() -> Column:
    return F.coalesce(choose(tag("sac_scale"), {s: i for i, s in enumerate(SAC_SCALE, 1)}), F.lit(0))


def marking_color(symbol: Column, colour: Column) -> Column:
    parts = F.split(symbol, ":", -1)
    fg = F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    name = F.lower(F.coalesce(F.nullif(F.get(F.split(fg, "_", -1), F.lit(0)), F.lit("")),
                              F.nullif(F.get(parts, F.lit(0)), F.lit("")), F.nullif(colour, F.lit("")), F.lit("")))
    return F.coalesce(choose(name, MARK_COLORS), F.when(colour.startswith("#"), colour))


def marking_shape(symbol: Column) -> Column:
    parts = F.split(symbol, ":", -1)
    fg = F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    n = F.coalesce(F.when(symbol.isNotNull(), F.size(parts)), F.lit(0))
    return (F.when(fg.rlike("stripe|bar"), "stripe").when(fg.rlike("cross"), "cross").when(fg.rlike("dot|circle"), "dot")
            .when(fg.rlike("triangle"), "triangle").when(n < 3, "stripe").otherwise("other"))


def hidden_score(in_route: Column) -> Column:
    def pts(cond, p):
        return F.when(F.coalesce(cond, F.lit(False)), p).otherwise(0.0)

    vis = choose(tag("trail_visibility"), {"intermediate": 0.15, "bad": 0.3, "horrible": 0.4, "no": 0.4})
    unnamed = F.coalesce(tag("name"), F.lit("")) == ""
    total = (0.3 + F.coalesce(vis, F.lit(0.0)) + pts(tag("informal") == "yes", 0.2) + pts(unnamed, 0.1)
             + pts(tag("highway") == "path", 0.1) + pts(sac_level() >= 3, 0.1)
             - pts((tag("highway") == "track") & tag("tracktype").isin("grade1", "grade2"), 0.2))
    return F.when(in_route, 0.0).otherwise(clamp(total, 0.0, 1.0))


def _access_value(v: Column) -> Column:
    return F.when(v.isin(*ACCESS_YES), "yes").when(v.isin(*ACCESS_NO), "no")


def access(mode: str) -> Column:
    tagged = [_access_value(tag(k)) for k in reversed(ACCESS_KEYS[mode])]
    hw = tag("highway")
    if mode == "moto":
        default = (F.when(hw.isin(*PATH_HIGHWAYS), "no").when(tag("4wd_only") == "yes", "unknown")
                   .when(hw == "track", "unknown").otherwise("yes"))
    elif mode == "bike":
        default = (F.when(hw.isin("steps", "via_ferrata"), "no").when((hw == "cycleway") | hw.isin(*ROAD_HIGHWAYS), "yes")
                   .otherwise("unknown"))
    else:
        default = F.when((hw == "cycleway") & ~F.coalesce(tag("foot") == "yes", F.lit(False)), "unknown").otherwise("yes")
    return F.coalesce(*tagged, default)


def track_grade() -> Column:
    return F.coalesce(F.regexp_extract(tag("tracktype"), "^grade([1-5])$", 1).try_cast("int"), F.lit(0))


def surface_class() -> Column:
    s, hw = tag("surface"), tag("highway")
    by_tag = None
    for name, pattern in SURFACES.items():
        cond = s.rlike(f"^({pattern})$")
        by_tag = F.when(cond, name) if by_tag is None else by_tag.when(cond, name)
    by_grade = choose(track_grade(), dict(enumerate(GRADE_SURFACE, 1)))
    road = F.when(hw.isin(*ROAD_HIGHWAYS) & (hw != "service"), "paved")
    return F.coalesce(by_tag, by_grade, road, F.lit("unknown"))


def mtb_scale() -> Column:
    n = F.regexp_extract(tag("mtb:scale"), r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.coalesce(clamp(n, 0, 6) + F.when(n.isNull(), None).otherwise(0), F.lit(-1))


def car_traffic() -> Column:
    hw = tag("highway")
    base = F.when((hw == "track") & (tag("tracktype") == "grade1"), 0.3).otherwise(F.coalesce(choose(hw, TRAFFIC_BASE), F.lit(0.0)))
    motor = F.coalesce(tag("motor_vehicle"), tag("vehicle"), tag("access"))

    def factor(cond, f):
        return F.when(F.coalesce(cond, F.lit(False)), f).otherwise(1.0)

    closed = F.when(motor.isin(*TRAFFIC_CLOSED), 0.25).when(motor.isin("destination", "permissive"), 0.6).otherwise(1.0)
    return F.least(F.lit(1.0), base * closed * factor(tag("service").isin(*TRAFFIC_QUIET_SERVICE), 0.5)
                   * factor(tag("surface").isin(*TRAFFIC_LOOSE), 0.6) * factor(number_prefix(tag("width")) < 3, 0.7))


def trail_kind(in_route: Column, hidden: Column) -> Column:
    hw = tag("highway")
    return (F.when(in_route, "marked").when(hw.isin(*ROAD_HIGHWAYS), "road").when(hidden >= HIDDEN_THRESHOLD, "hidden")
            .when(hw == "track", "track").otherwise("path"))


def poi_kind() -> Column:
    out = None
    for kind, key, values in POI_RULES:
        cond = tag(key).isin(*values)
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out


def poi_elevation() -> Column:
    return number_prefix(F.regexp_replace(tag("ele"), ",", "."))


def way_class(hw: Column) -> Column:
    return (F.when(hw == "track", "track").when(hw == "cycleway", "cycleway").when(hw.isin("steps", "via_ferrata"), "steps")
            .when(hw.isin("path", "footway", "bridleway"), "path").otherwise("road"))
