"""Windows of points: assignment, next fix, dense windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timewin import window_start
from ..schema import Params


def assign_windows(gps: DataFrame, p: Params = Params()) -> DataFrame:
    """Adds service_date, win_st and win_end. A null time has null ones."""
    date = F.to_date("time") if p.window_key == "date" else F.when(F.col("time").isNotNull(), F.lit("1970-01-01").cast("date"))
    start = window_start(F.col("time"), p.window_minutes)
    return gps.withColumns({"service_date": date, "win_st": start, "win_end": start + p.window_minutes})


def next_fix(gps: DataFrame) -> DataFrame:
    """Adds start_time, the point's time, and end_time, the vehicle's next one (null for its last point)."""
    after = Window.partitionBy("lineName", "idx").orderBy("time", "distance_of_gpspoint", "gps_normalized_distance_length")
    return gps.withColumns({"start_time": F.col("time"), "end_time": F.lead("time").over(after)})


def dense_windows(points: DataFrame, p: Params = Params()) -> DataFrame:
    """Points of windows in which the vehicle has at least min_points, in whatever direction. Null keys drop out.
    After next_fix this needs no shuffle of its own: it is clustered by a subset of its keys."""
    keyed = points.where(F.col("lineName").isNotNull() & F.col("idx").isNotNull() & F.col("win_st").isNotNull())
    own = Window.partitionBy("lineName", "idx", "service_date", "win_st")
    return keyed.withColumn("_n", F.count("*").over(own)).where(F.col("_n") >= p.min_points).drop("_n")


def window_counts(points: DataFrame) -> DataFrame:
    """How many points each vehicle has in each window."""
    return points.groupBy("lineName", "idx", "service_date", "win_st").agg(F.count("*").alias("count"))


def partition_rows(df: DataFrame) -> DataFrame:
    """Rows of each partition, for diagnosis."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by keys to as many tasks as shuffles have by configuration. A shuffle that Spark plans itself is drawn
    together by its bytes, to one task where rows are few, although their pairs are many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys) if keys else df
