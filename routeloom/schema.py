"""Schemas and parameters of the trajectory engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Mapped GPS track, the input of every detector.
GPS = T.StructType(
    [
        T.StructField("idx", T.StringType()),
        T.StructField("opath", T.StringType()),
        T.StructField("lineName", T.StringType()),
        T.StructField("direction", T.DoubleType()),
        T.StructField("t_flag", T.IntegerType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("distance_of_gpspoint", T.DoubleType()),
        T.StructField("gps_normalized_distance_length", T.DoubleType()),
    ]
)

POINT = T.StructType([T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType())])

#: Route polylines.
NETWORK = T.StructType(
    [
        T.StructField("lineName", T.StringType()),
        T.StructField("direction", T.IntegerType()),
        T.StructField("fid", T.StringType()),
        T.StructField("length", T.DoubleType()),
        T.StructField("geometry", T.ArrayType(POINT)),
    ]
)

#: Order of a route's segments; seq_pos is stored, since files have no row order in Spark.
SEQUENCE = T.StructType(
    [
        T.StructField("lineName", T.StringType()),
        T.StructField("direction", T.IntegerType()),
        T.StructField("seq_pos", T.IntegerType()),
        T.StructField("opath", T.StringType()),
    ]
)

#: Cumulative distance of every vertex of a route.
DISTANCE_INDEX = T.StructType(
    [
        T.StructField("lineName", T.StringType()),
        T.StructField("net_direction", T.IntegerType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("opath", T.StringType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("distance_opath", T.DoubleType()),
        T.StructField("seq_pos", T.IntegerType()),
        T.StructField("vertex", T.IntegerType()),
    ]
)


#: One row for each route: what is known of it.
LINE_INFO = T.StructType(
    [
        T.StructField("lineName", T.StringType()),
        T.StructField("cars", T.LongType()),
        T.StructField("points", T.LongType()),
        T.StructField("segment_length", T.DoubleType()),
        T.StructField("distance_dir1", T.DoubleType()),
        T.StructField("distance_dir2", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Params:
    """Tunable constants of detection.

    window_key: "date" keeps days apart; "minute_of_day" lets the same minute of different days share a window.
    partition_keys: what two vehicles must share besides the window to be compared.
    time_precision: "full", or "second" to compare whole seconds in the rectangle overlap.
    distance_mode: "vertical" (difference along the route) or "line" (perpendicular to the first vehicle's line).
    angle_mode: "wrap" takes angles on the circle, "literal" as plain numbers.
    order_by: neighbours by "angle", or by "idx".
    """

    window_minutes: int = 4
    threshold: float = 0.01
    angle_tolerance: float = 3.0
    merge_gap_s: int = 5
    min_duration_s: int = 180
    min_points: int = 2
    window_key: str = "date"
    partition_keys: tuple[str, ...] = ("lineName", "direction")
    time_precision: str = "full"
    distance_mode: str = "vertical"
    angle_mode: str = "wrap"
    order_by: str = "angle"
    banded: bool = True

    def __post_init__(self):
        for name, allowed in (("window_key", ("date", "minute_of_day")), ("time_precision", ("full", "second")), ("distance_mode", ("vertical", "line")), ("angle_mode", ("wrap", "literal")), ("order_by", ("angle", "idx"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if self.window_minutes <= 0 or self.threshold <= 0:
            raise ValueError("window_minutes and threshold must be positive")

    def group_keys(self) -> list[str]:
        return [*self.partition_keys, "service_date", "win_st"]
