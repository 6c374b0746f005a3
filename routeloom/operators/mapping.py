"""From GPS points to places along a route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import geodesic_km, planar


def build_distance_index(network: DataFrame, sequence: DataFrame) -> DataFrame:
    """Every vertex of every route in order, with the km from the route's start. Gaps between segments count; repeated
    segments are visited each time; segments that the network lacks are left out."""
    net = network.select("lineName", "direction", F.col("fid").cast("string").alias("opath"), "geometry")
    seq = sequence.select("lineName", "direction", "seq_pos", F.col("opath").cast("string").alias("opath"))
    v = seq.join(net, ["lineName", "direction", "opath"]).select("lineName", "direction", "seq_pos", "opath", F.posexplode("geometry").alias("vertex", "p"))
    route = Window.partitionBy("lineName", "direction").orderBy("seq_pos", "vertex")
    before = F.lag("p").over(route)
    step = F.coalesce(geodesic_km(F.col("_b.lng"), F.col("_b.lat"), F.col("p.lng"), F.col("p.lat")), F.lit(0.0))
    rows = v.withColumns({"_b": before, "ord": F.row_number().over(route) - 1}).withColumn("_km", step)
    total = F.sum("_km").over(route.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("lineName", F.col("direction").alias("net_direction"), "ord", "opath", F.col("p.lng").alias("lng"), F.col("p.lat").alias("lat"), total.alias("distance_opath"), "seq_pos", "vertex")


def route_lengths(index: DataFrame) -> DataFrame:
    """Length of every route and direction: the cumulative km of its last vertex."""
    return index.groupBy("lineName", "net_direction").agg(F.max_by("distance_opath", "ord").alias("route_km"))


def route_length_table(index: DataFrame) -> DataFrame:
    """One row a route with the lengths of both directions."""
    wide = index.groupBy("lineName").pivot("net_direction", [1, 2]).agg(F.max_by("distance_opath", "ord"))
    return wide.select("lineName", F.col("1").alias("distance_dir1"), F.col("2").alias("distance_dir2"))


def segments(index: DataFrame) -> DataFrame:
    """For each segment id of a route its edges in order. An edge's km is that of the first vertex of these coordinates
    in the segment; of a segment visited more than once the first visit counts."""
    same = Window.partitionBy("lineName", "net_direction", "opath", "lng", "lat").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    visits = Window.partitionBy("lineName", "net_direction", "opath")
    first = index.withColumn("km", F.first("distance_opath").over(same)).withColumn("_v", F.min("seq_pos").over(visits)).where("seq_pos = _v")
    after = F.lead(F.struct("lng", "lat")).over(visits.orderBy("vertex"))
    edges = first.withColumn("_e", after).where(F.col("_e").isNotNull())
    edge = F.struct("vertex", "km", "lng", "lat", F.col("_e.lng").alias("lng2"), F.col("_e.lat").alias("lat2"))
    return edges.groupBy("lineName", F.col("net_direction").alias("route_dir"), "opath").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def nearest_edge(points: DataFrame, segs: DataFrame) -> DataFrame:
    """Points with the edge of their segment whose ends are nearest in sum; the first of equal ones. Points of unknown
    segments and those without coordinates drop out. direction 1 is 1, all else 2."""
    route_dir = F.when(F.col("direction") == 1, 1).otherwise(2)
    named = points.withColumn("route_dir", route_dir).withColumn("opath", F.col("opath").cast("string"))
    joined = named.join(segs, ["lineName", "route_dir", "opath"])
    away = lambda e: planar(F.col("lng"), F.col("lat"), e["lng"], e["lat"]) + planar(F.col("lng"), F.col("lat"), e["lng2"], e["lat2"])
    best = F.array_min(F.transform("edges", lambda e: F.struct(away(e).alias("dsum"), e["vertex"].alias("vertex"), e["km"].alias("km"), e["lng"].alias("lng"), e["lat"].alias("lat"))))
    out = joined.withColumn("edge", best).drop("edges")
    return out.where(F.col("edge").isNotNull() & F.col("edge.dsum").isNotNull() & ~F.isnan("edge.dsum"))


def map_gps(points: DataFrame, index: DataFrame, offset_unit: str = "km") -> DataFrame:
    """Mapped track of raw points: km from the route's start and the fraction of its length. offset_unit "degrees" adds
    the planar offset in degrees to km, as older data sets were made."""
    if offset_unit not in ("km", "degrees"):
        raise ValueError(offset_unit)
    near = nearest_edge(points, segments(index))
    from_edge = geodesic_km if offset_unit == "km" else planar
    km = F.col("edge.km") + from_edge(F.col("edge.lng"), F.col("edge.lat"), F.col("lng"), F.col("lat"))
    lengths = route_lengths(index).select("lineName", F.col("net_direction").alias("route_dir"), "route_km")
    out = near.withColumn("_km", km).join(lengths, ["lineName", "route_dir"])
    flag = F.col("t_flag") if "t_flag" in points.columns else F.col("journey").cast("int") if "journey" in points.columns else F.lit(None).cast("int")
    return out.select("idx", "opath", "lineName", F.col("direction").cast("double").alias("direction"), flag.alias("t_flag"), "time", "lng", "lat", F.col("_km").alias("distance_of_gpspoint"), F.try_divide("_km", "route_km").alias("gps_normalized_distance_length"))


def line_summary(points: DataFrame, network: DataFrame, sequence: DataFrame, index: DataFrame) -> DataFrame:
    """A row for each route: vehicles, points, summed lengths of its matched segments, lengths of both directions."""
    seen = points.groupBy("lineName").agg(F.countDistinct("idx").alias("cars"), F.count("*").alias("points"))
    net = network.select("lineName", "direction", F.col("fid").cast("string").alias("opath"), "length")
    matched = sequence.withColumn("opath", F.col("opath").cast("string")).join(net, ["lineName", "direction", "opath"]).groupBy("lineName").agg(F.sum("length").alias("segment_length"))
    return route_length_table(index).join(seen, "lineName", "left").join(matched, "lineName", "left").select("lineName", F.coalesce("cars", F.lit(0)).alias("cars"), F.coalesce("points", F.lit(0)).alias("points"), "segment_length", "distance_dir1", "distance_dir2")
