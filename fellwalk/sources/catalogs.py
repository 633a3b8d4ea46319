"""Landed service responses: scene catalogues, observations, road routes, geocoder results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from fellwalk.functions.geo import epsg_from_mgrs

# File names of a scene and its id pattern.
SCENE_ID = r"^S2[A-D]_T(\d{2})([C-X])([A-Z]{2})_(\d{4})(\d{2})\d{2}T\d{6}_L2A$"
SCENE_FILES = {"visual": "TCI.tif", "red": "B04.tif", "nir": "B08.tif", "scl": "SCL.tif", "blue": "B02.tif", "green": "B03.tif", "preview": "L2A_PVI.tif"}
MAX_UNCERTAINTY_M = 1500
RECORD_BASES = ["HUMAN_OBSERVATION", "MACHINE_OBSERVATION", "OBSERVATION"]
GEOCODER_KINDS = [("peak", "peak|saddle|volcano|ridge|cliff"), ("water", "water|lake|river|waterfall|spring|reservoir|stream"),
                  ("hut", "hut|shelter|chalet|camp|hostel|guest_house|hotel"), ("town", "city|town|village|hamlet|suburb|locality")]


def parse_scenes(features: DataFrame) -> DataFrame:
    """Scenes of catalogue items (id, bbox, properties map of text); items without a usable grid code are dropped."""
    p = lambda k: F.try_element_at("properties", F.lit(k))
    grid = F.regexp_replace(F.coalesce(p("grid:code"), F.lit("")), "^MGRS-", "")
    epsg = F.coalesce(p("proj:epsg").try_cast("int"), epsg_from_mgrs(grid))
    return features.select(
        "id", grid.alias("grid"), epsg.alias("epsg"), F.try_to_timestamp(p("datetime")).alias("acquired_at"),
        F.coalesce(p("eo:cloud_cover").try_cast("double"), F.lit(100.0)).alias("cloud"),
        F.coalesce(p("s2:nodata_pixel_percentage").try_cast("double"), F.lit(0.0)).alias("nodata"),
        *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("wsen")]).where(F.col("epsg").isNotNull())


def read_stac_scenes(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    schema = "features array<struct<id:string,bbox:array<double>,properties:map<string,string>>>"
    doc = spark.read.schema(schema).option("multiLine", multiline).json(path)
    return parse_scenes(doc.select(F.explode("features").alias("f")).select("f.*"))


def search_scenes(scenes: DataFrame, w: float, s: float, e: float, n: float, since, max_cloud: float) -> DataFrame:
    return scenes.where((F.col("cloud") < max_cloud) & (F.col("acquired_at") >= since)
                        & (F.col("w") <= e) & (F.col("e") >= w) & (F.col("s") <= n) & (F.col("n") >= s))


def scene_file_index(scenes: DataFrame, root: str) -> DataFrame:
    """Band file paths derived from the scene id, null when it does not match the pattern."""
    g = [F.regexp_extract("id", SCENE_ID, i) for i in range(1, 6)]
    folder = F.concat_ws("/", F.lit(root), g[0].try_cast("int").cast("string"), g[1], g[2], g[3], g[4].try_cast("int").cast("string"), F.col("id"))
    ok = F.col("id").rlike(SCENE_ID)
    return scenes.withColumns({k: F.when(ok, F.concat(folder, F.lit("/" + f))) for k, f in SCENE_FILES.items()})


def parse_sightings(obs: DataFrame) -> DataFrame:
    """location "lat,lng" text, observation times, obscured flag and accuracy; unusable rows are dropped."""
    part = F.split("location", ",")
    return obs.select(
        F.get(part, F.lit(1)).try_cast("double").alias("lng"), F.get(part, F.lit(0)).try_cast("double").alias("lat"),
        F.try_to_timestamp(F.coalesce("time_observed_at", "observed_on")).alias("observed_at"),
        F.coalesce("obscured", F.lit(False)).alias("obscured"), F.col("positional_accuracy").cast("double").alias("accuracy_m")).where(
        "lng is not null and lat is not null and observed_at is not null")


def filter_occurrences(rec: DataFrame) -> DataFrame:
    """Occurrence records with precise, open coordinates."""
    return rec.where((F.coalesce("informationWithheld", F.lit("")) == "")
                     & F.coalesce(F.col("coordinateUncertaintyInMeters") <= MAX_UNCERTAINTY_M, F.lit(True))
                     & F.col("basisOfRecord").isin(*RECORD_BASES)).select(
        F.col("decimalLongitude").alias("lng"), F.col("decimalLatitude").alias("lat"), F.coalesce("year", F.lit(0)).alias("year"))


def read_observations(spark: SparkSession, path: str, kind: str = "sightings", multiline: bool = True) -> DataFrame:
    if kind == "sightings":
        s = "results array<struct<location:string,obscured:boolean,positional_accuracy:double,time_observed_at:string,observed_on:string>>"
    else:
        s = ("results array<struct<decimalLongitude:double,decimalLatitude:double,coordinateUncertaintyInMeters:double,"
             "basisOfRecord:string,informationWithheld:string,year:int>>")
    rows = spark.read.schema(s).option("multiLine", multiline).json(path).select(F.explode("results").alias("r")).select("r.*")
    return parse_sightings(rows) if kind == "sightings" else filter_occurrences(rows)


ROAD_SCHEMA = ("request_id string, code string, routes array<struct<distance:double,duration:double,legs:array<struct<steps:array<struct<"
               "name:string,ref:string,geometry:struct<coordinates:array<array<double>>>>>>>>>")


def read_road_routes(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of road responses, one document per line, repeated joints dropped.

    request_id, seq, lng, lat, step and name of the segment that ends at the vertex
    (null at the first), distance and duration. Failed responses give no rows.
    """
    doc = spark.read.schema(ROAD_SCHEMA).json(path).where("code = 'Ok'")
    r = doc.select("request_id", F.get("routes", F.lit(0)).alias("r")).where("r is not null")
    legs = r.select("request_id", "r.distance", "r.duration", F.posexplode("r.legs").alias("leg", "l"))
    steps = legs.select("request_id", "distance", "duration", "leg", F.posexplode("l.steps").alias("step", "s"))
    pts = steps.select("request_id", "distance", "duration", "leg", "step", F.coalesce(F.nullif("s.name", F.lit("")), F.nullif("s.ref", F.lit(""))).alias("name"),
                       F.posexplode("s.geometry.coordinates").alias("k", "c"))
    w = W.partitionBy("request_id").orderBy("leg", "step", "k")
    x, y = F.col("c")[0], F.col("c")[1]
    new = F.coalesce((F.lag(x).over(w) != x) | (F.lag(y).over(w) != y), F.lit(True))
    kept = pts.withColumns({"lng": x, "lat": y, "new": new}).where("new")
    seq = (F.row_number().over(w) - 1).alias("seq")
    step_no = F.dense_rank().over(W.partitionBy("request_id").orderBy("leg", "step"))
    out = kept.select("request_id", seq, "lng", "lat", step_no.alias("step"), "name", "distance", "duration")
    first = F.col("seq") == 0
    return out.withColumns({"name": F.when(~first, F.col("name")), "step": F.when(~first, F.col("step"))})


def geocoder_places(features: DataFrame, country: str = "RO") -> DataFrame:
    """Places of geocoder features (props map, lng, lat): kind, name, detail text; other countries are dropped."""
    p = lambda k: F.try_element_at("props", F.lit(k))
    v = F.coalesce(p("osm_value"), F.lit(""))
    kind = None
    for name, pattern in GEOCODER_KINDS:
        kind = F.when(v.rlike(pattern), name) if kind is None else kind.when(v.rlike(pattern), name)
    where = F.concat_ws(", ", F.nullif(F.coalesce(p("city"), p("town"), p("village")), F.lit("")), F.nullif(p("county"), F.lit("")))
    detail = F.concat_ws(" · ", F.nullif(F.replace(v, F.lit("_"), F.lit(" ")), F.lit("")), F.nullif(where, F.lit("")))
    return features.where(F.coalesce(p("countrycode"), F.lit("")).isin(country, "")).select(
        "query", F.coalesce(p("name"), where).alias("name"), detail.alias("detail"), kind.otherwise("pin").alias("kind"), "lng", "lat").withColumn(
        "zoom", F.when(F.col("kind") == "town", 13).otherwise(15))


def read_geocoder_results(spark: SparkSession, path: str, country: str = "RO") -> DataFrame:
    schema = "query string, features array<struct<geometry:struct<coordinates:array<double>>,properties:map<string,string>>>"
    f = spark.read.schema(schema).json(path).select("query", F.explode("features").alias("f"))
    return geocoder_places(f.select("query", F.col("f.properties").alias("props"), F.col("f.geometry.coordinates")[0].alias("lng"),
                                    F.col("f.geometry.coordinates")[1].alias("lat")), country)
