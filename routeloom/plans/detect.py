"""Detection of vehicle bunching by three candidate strategies with one result schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timewin import angle_difference  # noqa: F401  part of the public surface
from ..operators import adjacency, mbr, pairs
from ..operators.merge import merge_chain, merge_lookahead
from ..operators.windows import assign_windows, dense_windows, next_fix
from ..schema import Params

NEEDED = ["idx", "lineName", "direction", "time", "distance_of_gpspoint", "gps_normalized_distance_length"]


def slim(gps: DataFrame) -> DataFrame:
    """Only what detection reads, so that scans prune the rest."""
    return gps.select(*NEEDED)


def points(gps: DataFrame, p: Params = Params()) -> DataFrame:
    return dense_windows(assign_windows(slim(gps), p), p)


def rectangles(gps: DataFrame, p: Params = Params()) -> DataFrame:
    return mbr.vehicle_mbrs(points(gps, p), p)


def _events(df: DataFrame, p: Params) -> DataFrame:
    return df.select(*p.partition_keys, "service_date", "idx1", "idx2", "win_st", "distance", "start_time", "end_time", "duration")


def detect(gps: DataFrame, method: str = "mbr", p: Params = Params(), distance_column: str | None = None) -> DataFrame:
    """Bunching events, one or more a pair and window, before merging. method: "pairs" (points near in km), "mbr"
    (overlapping rectangles) or "angle" (overlapping rectangles of neighbours by angle)."""
    if method == "pairs":
        fixed = dense_windows(assign_windows(next_fix(slim(gps)), p), p)
        return _events(pairs.farthest_points(fixed, p, distance_column or "distance_of_gpspoint"), p)
    if method == "mbr":
        return _events(mbr.under(mbr.with_distance(mbr.overlap_pairs(rectangles(gps, p), p), p), p), p)
    if method == "angle":
        near = adjacency.adjacent_pairs(rectangles(gps, p), p)
        return _events(near.where((F.col("angle_diff") <= p.angle_tolerance) & mbr.overlap(p) & (F.col("distance") < p.threshold)), p)
    raise ValueError(method)


def merge_events(events: DataFrame, mode: str = "lookahead", p: Params = Params()) -> DataFrame:
    if mode not in ("lookahead", "chain"):
        raise ValueError(mode)
    return (merge_lookahead if mode == "lookahead" else merge_chain)(events, p)
