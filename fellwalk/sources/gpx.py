"""GPX tracks, routes and waypoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PT = "_lat double, _lon double, ele double, time string"
_PTS = f"array<struct<{_PT.replace(' double', ':double').replace(' string', ':string')}>>"
PAGE_POINTS = 5000  # fixed value: a trace page with fewer points is the last one


def _points(df: DataFrame, kind: str, arr: str, *ids: str) -> DataFrame:
    return df.select("file", F.lit(kind).alias("kind"), "item", *ids, "name", F.posexplode(arr).alias("seq", "p")).select(
        "file", "kind", "item", *ids, "name", "seq", F.col("p._lon").alias("lng"), F.col("p._lat").alias("lat"),
        F.col("p.ele").alias("ele"), F.try_to_timestamp("p.time").alias("ts"))


def read_gpx(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """points(file, kind, item, seg, name, seq, lng, lat, ele, ts), waypoints and rejects (files that are not GPX)."""
    def rows(tag, schema):
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).select(
            "*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("item"))

    trk = rows("trk", f"name string, trkseg array<struct<trkpt:{_PTS}>>")
    seg = trk.select("file", "item", "name", F.posexplode("trkseg").alias("seg", "s"))
    rte = rows("rte", f"name string, rtept {_PTS}").withColumn("seg", F.lit(0))
    points = _points(seg.withColumn("pts", F.col("s.trkpt")).where(F.size("pts") > 1), "trk", "pts", "seg").unionByName(
        _points(rte.where(F.size("rtept") > 1), "rte", "rtept", "seg"))
    wpt = rows("wpt", f"name string, {_PT}").select(
        "file", "name", F.col("_lon").alias("lng"), F.col("_lat").alias("lat"), "ele", F.try_to_timestamp("time").alias("ts"))
    text = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").rlike(r"<gpx[\s>]").alias("hit"))
    rejects = text.groupBy("file").agg(F.max("hit").alias("is_gpx")).where(~F.col("is_gpx")).select("file")
    return {"points": points, "waypoints": wpt, "rejects": rejects}


def read_trace_pages(spark: SparkSession, path: str) -> DataFrame:
    """All trace points of a folder of pages, with the page and whether it is the last one of its box."""
    pts = read_gpx(spark, path)["points"].where("kind = 'trk'")
    n = pts.groupBy("file").agg((F.count(F.lit(1)) < PAGE_POINTS).alias("last_page"))
    return pts.join(n, "file")


def _escape(c):
    c = F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(F.replace(c, F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def gpx_lines(points: DataFrame, track: str, creator: str = "fellwalk") -> DataFrame:
    """Ordered text lines (track, ord, value) of one GPX 1.1 document per track.

    Lines stay rows, so a long track is never gathered into one value.
    """
    ele = F.when(F.col("ele").isNotNull(), F.concat(F.lit("<ele>"), F.format_string("%.1f", "ele"), F.lit("</ele>"))).otherwise("")
    ts = F.when(F.col("ts").isNotNull(), F.concat(F.lit("<time>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("</time>"))).otherwise("")
    body = points.select(track, F.col("seq").cast("long").alias("ord"), F.concat(
        F.lit('      <trkpt lat="'), F.format_string("%.7f", "lat"), F.lit('" lon="'), F.format_string("%.7f", "lng"), F.lit('">'), ele, ts,
        F.lit("</trkpt>")).alias("value"))
    names = points.groupBy(track).agg(F.max("name").alias("name"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="'), _escape(F.lit(creator)),
                    F.lit('" xmlns="http://www.topografix.com/GPX/1/1">\n  <metadata><name>'), _escape(F.col("name")),
                    F.lit("</name></metadata>\n  <trk>\n    <name>"), _escape(F.col("name")), F.lit("</name>\n    <trkseg>"))
    top = names.select(track, F.lit(-1).cast("long").alias("ord"), head.alias("value"))
    end = names.select(track, F.lit(1 << 60).cast("long").alias("ord"), F.lit("    </trkseg>\n  </trk>\n</gpx>").alias("value"))
    return body.unionByName(top).unionByName(end)


def write_gpx(points: DataFrame, track: str, out: str) -> None:
    """One folder and file per track; rows stream to the writer in order."""
    lines = gpx_lines(points, track)
    lines.repartition(track).sortWithinPartitions(track, "ord").select(track, "value").write.mode("overwrite").partitionBy(track).text(out)


