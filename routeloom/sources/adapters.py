"""Tracks and networks made of the general tables events and part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPRESSION, FULL_SCALE = 412, 600.0


def gps_from_events(events: DataFrame) -> DataFrame:
    """A day's tracks: users are vehicles, and a month is compressed into two hours from 07:00 on."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    time = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 07:00:00").cast("timestamp")) + F.floor(us / COMPRESSION))
    user = F.col("user_id")
    return events.select(
        user.cast("string").alias("idx"),
        F.concat(F.lit("L"), (user % 5).cast("string")).alias("lineName"),
        (F.floor(user / 5) % 2 + 1).cast("double").alias("direction"),
        time.alias("time"),
        F.col("value").alias("distance_of_gpspoint"),
        (F.col("value") / FULL_SCALE).alias("gps_normalized_distance_length"),
        F.col("event_id"),
    )


def gps_by_type(events: DataFrame) -> DataFrame:
    """Tracks over many days: users within an event type, at their own times."""
    return events.select(
        F.col("user_id").cast("string").alias("idx"),
        F.col("event_type").alias("lineName"),
        F.lit(1.0).alias("direction"),
        F.col("ts").cast("timestamp").alias("time"),
        F.col("value").alias("distance_of_gpspoint"),
        (F.col("value") / FULL_SCALE).alias("gps_normalized_distance_length"),
    )


def vertices_from_part(part: DataFrame) -> DataFrame:
    """Offsets are whole numbers divided, as SQL's decimals are: k * 0.001 in binary would differ in the last bit."""
    k = F.floor(F.col("p_partkey") / 10)
    return part.select(
        F.concat(F.lit("L"), (F.col("p_partkey") % 5).cast("string")).alias("lineName"),
        (1 + F.floor(F.col("p_partkey") / 5) % 2).cast("int").alias("direction"),
        F.floor(k / 10).cast("int").alias("seg"),
        (k % 10).cast("int").alias("vertex"),
        (F.lit(114.0) + k / F.lit(1000.0)).alias("lng"),
        (F.lit(22.5) + (7 * k % 13) * 5 / F.lit(10000.0)).alias("lat"),
    )


def network_from_part(part: DataFrame) -> DataFrame:
    v = vertices_from_part(part)
    ordered = F.array_sort(F.collect_list(F.struct("vertex", "lng", "lat")))
    grouped = v.groupBy("lineName", "direction", "seg").agg(ordered.alias("vs"))
    geometry = F.transform("vs", lambda x: F.struct(x["lng"].alias("lng"), x["lat"].alias("lat")))
    return grouped.select("lineName", "direction", F.col("seg").cast("string").alias("fid"), F.size("vs").cast("double").alias("length"), geometry.alias("geometry"))


def sequence_from_part(part: DataFrame) -> DataFrame:
    v = vertices_from_part(part).select("lineName", "direction", "seg").distinct()
    return v.select("lineName", "direction", F.col("seg").alias("seq_pos"), F.col("seg").cast("string").alias("opath"))


def gps_on_network(events: DataFrame, part: DataFrame) -> DataFrame:
    """Raw points near the network's vertices; some lie on segments that their route lacks."""
    gps = gps_from_events(events)
    segs = part.agg(F.max(F.floor(F.floor(F.col("p_partkey") / 10) / 10)).alias("top"))
    e = F.col("event_id")
    k = F.col("seg") * 10 + e % 10
    placed = gps.withColumn("seg", e % (segs.scalar() + 2))
    return placed.select(
        "idx",
        F.col("seg").cast("string").alias("opath"),
        "lineName",
        "direction",
        (e % 3).cast("int").alias("journey"),
        "time",
        (F.lit(114.0) + k / F.lit(1000.0) + (e % 7) / F.lit(10000.0)).alias("lng"),
        (F.lit(22.5) + (7 * k % 13) * 5 / F.lit(10000.0) + (e % 11) * 3 / F.lit(100000.0)).alias("lat"),
        "event_id",
    )
