"""Times alternatives of one operator over $BENCH_SF_DIR: candidate strategies, two forms of the nearest edge, and the
cost of a Python boundary. Prints one JSON line. The alternatives that lose are kept here only."""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from routeloom.functions.geo import planar
from routeloom.operators import mapping, mbr
from routeloom.plans import detect
from routeloom.queries import NORMAL, _gps, _index, _raw
from routeloom.schema import Params


def exploded(points, segs):
    """The nearest edge by a row for each edge and an aggregate."""
    named = points.withColumn("route_dir", F.when(F.col("direction") == 1, 1).otherwise(2))
    rows = named.join(segs, ["lineName", "route_dir", "opath"]).withColumn("e", F.explode("edges"))
    away = planar(F.col("lng"), F.col("lat"), F.col("e.lng"), F.col("e.lat")) + planar(F.col("lng"), F.col("lat"), F.col("e.lng2"), F.col("e.lat2"))
    return rows.groupBy("event_id").agg(F.min_by("e", F.struct(away, "e.vertex")).alias("edge"))


def grouped(mbrs):
    """Overlapping rectangles found in pandas, a group at a time."""
    keys = ["lineName", "direction", "service_date", "win_st"]

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx", ignore_index=True)
        t1, t2, d1, d2 = (g[c].to_numpy() for c in ("min_time", "max_time", "min_dis_location", "max_dis_location"))
        meets = (t1[:, None] <= t2) & (t1 <= t2[:, None]) & (d1[:, None] <= d2) & (d1 <= d2[:, None])
        i, j = np.nonzero(np.triu(meets, 1))
        return g[keys].iloc[i].assign(idx1=g.idx.to_numpy()[i], idx2=g.idx.to_numpy()[j])

    return mbrs.groupBy(*keys).applyInPandas(pairs, "lineName string, direction double, service_date date, win_st int, idx1 string, idx2 string")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    gps = _gps(spark, folder)
    cases = {
        "pairs_plain": lambda: detect.detect(gps, "pairs", Params(threshold=0.5, banded=False)),
        "pairs_banded": lambda: detect.detect(gps, "pairs", Params(threshold=0.5)),
        "rectangles": lambda: detect.detect(gps, "mbr", NORMAL),
        "neighbours_by_angle": lambda: detect.detect(gps, "angle", NORMAL),
        "nearest_edge_array": lambda: mapping.nearest_edge(_raw(spark, folder), mapping.segments(_index(spark, folder))),
        "nearest_edge_exploded": lambda: exploded(_raw(spark, folder), mapping.segments(_index(spark, folder))),
        "overlap_native": lambda: mbr.overlap_pairs(detect.rectangles(gps, NORMAL), NORMAL),
        "overlap_grouped_pandas": lambda: grouped(detect.rectangles(gps, NORMAL)),
    }
    seconds = {}
    for name, make in cases.items():
        best = []
        for _ in range(3):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        seconds[name] = round(min(best), 3)
    print(json.dumps({"best_of_3_seconds": seconds, "folder": folder}))
    spark.stop()


if __name__ == "__main__":
    main()
