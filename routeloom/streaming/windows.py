"""Rectangles of vehicles in the windows of a stream, with a watermark for late points.

Windows here are tumbling windows of event time, aligned to the epoch; with whole-day offsets and a width that divides
an hour they are the batch engine's windows. State is one row for each vehicle and open window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import libm
from ..functions.timewin import angle, window_start
from ..schema import Params


def stream_mbrs(points: DataFrame, p: Params = Params(), late: str = "10 minutes") -> DataFrame:
    """Rectangles like vehicle_mbrs() of a streaming (or batch) DataFrame; use output mode append for closed windows."""
    d = F.col("gps_normalized_distance_length")
    order = F.struct("time", d)
    slim = points.select("idx", "lineName", "direction", "time", d).where(F.col("idx").isNotNull() & F.col("lineName").isNotNull())
    win = F.window("time", f"{p.window_minutes} minutes")
    out = slim.withWatermark("time", late).groupBy("lineName", "direction", "idx", win.alias("w")).agg(
        F.min("time").alias("min_time"),
        F.max("time").alias("max_time"),
        F.min(d).alias("min_dis_location"),
        F.max(d).alias("max_dis_location"),
        F.min_by(d, order).alias("first_dis"),
        F.max_by(d, order).alias("last_dis"),
        F.count("*").alias("n_points"),
    )
    kept = out.where(F.col("n_points") >= p.min_points).withColumn("angle", angle(F.col("last_dis") - F.col("first_dis"), libm.arctangent))
    return kept.select("lineName", "direction", F.to_date("w.start").alias("service_date"), window_start(F.col("w.start"), p.window_minutes).alias("win_st"), "idx", "min_time", "max_time", "min_dis_location", "max_dis_location", "first_dis", "last_dis", "n_points", "angle")
