"""What the findings of round 2 showed."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from routeloom.llm import e8, suffix_dedup
from routeloom.functions.geo import planar
from routeloom.functions.timewin import angle, arctangent
from routeloom.operators import mbr, merge, pairs, windows
from routeloom.plans import detect
from routeloom.schema import Params
from routeloom.sources import adapters, shapefile


def test_coordinates_and_planar_distances_are_those_of_sql(spark):
    """the last bit decides between edges that are equally near."""
    part = spark.range(0, 200_000, 10).select(F.col("id").alias("p_partkey"))
    found = adapters.vertices_from_part(part).select("lng", "lat", planar(F.lit(114.0), F.lit(22.5), F.col("lng"), F.col("lat")).alias("d")).collect()
    want = [(114.0 + k / 1000, 22.5 + 7 * k % 13 * 5 / 10000) for k in range(20_000)]
    assert sorted(tuple(r)[:2] for r in found) == sorted(want)
    assert all(r.d == math.sqrt((114.0 - r.lng) * (114.0 - r.lng) + (22.5 - r.lat) * (22.5 - r.lat)) for r in found)


def test_angles_are_rounded_as_sql_rounds_them(spark):
    """An arctangent that is off by a bit makes or breaks ties in the order of neighbours."""
    rises = [k / 600 / 100 for k in range(-60_000, 60_001, 13)]
    df = spark.createDataFrame([(x,) for x in rises], "r double").select("r", arctangent(F.col("r")).alias("a"), angle(F.col("r")).alias("angle"))
    found = df.collect()
    exact = [float(np.arctan(np.longdouble(r.r))) for r in found]
    assert sum(r.a != x for r, x in zip(found, exact, strict=True)) <= 10  # atan2 differs in hundreds
    assert all(abs(r.a - x) <= math.ulp(x) for r, x in zip(found, exact, strict=True))
    assert all(r.angle == r.a * (180 / math.pi) + (360 if r.r < 0 else 0) for r in found)
    odd = spark.createDataFrame([(2.0,), (-3.0,), (None,), (float("nan"),)], "r double").select(arctangent(F.col("r")).alias("a")).collect()
    assert [round(r.a, 9) for r in odd[:2]] == [round(math.atan(2.0), 9), round(math.atan(-3.0), 9)] and odd[2].a is None and math.isnan(odd[3].a)


def _tracks(spark, name="tracks"):
    """Many vehicles, close together, on both directions of two routes over an hour."""
    n = F.col("id")
    t = F.timestamp_seconds(F.lit(1704092400) + n * 37 % 3600)
    y = n * 7919 % 1009 / F.lit(1009.0)
    return spark.range(6000).select((n % 60).cast("string").alias("idx"), F.concat(F.lit("L"), n % 2).alias("lineName"), (n % 3 % 2 + 1).cast("double").alias("direction"), t.alias("time"), (y * 20).alias("distance_of_gpspoint"), y.alias("gps_normalized_distance_length"))


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_line_distance_stays_out_of_the_join(spark):
    """written into the join's condition it makes a method that is never compiled."""
    joins = [x for x in _plan(detect.detect(_tracks(spark), "mbr", Params(threshold=0.05, distance_mode="line"))).splitlines() if "Join" in x]
    assert joins and not any("greatest" in x.lower() for x in joins)


def test_farthest_points_without_a_shuffle_of_pairs(spark):
    """the same rows as ranking all pairs, plain or by bands; pairs are not dealt out again."""
    fixed = windows.dense_windows(windows.assign_windows(windows.next_fix(_tracks(spark))))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = None
    for banded in (True, False):
        p = Params(threshold=0.7, banded=banded)
        ranked = rows(pairs.farthest(pairs.near_points(fixed, p), p))
        assert ranked == rows(pairs.farthest_points(fixed, p)) and len(ranked) < pairs.near_points(fixed, p).count()
        want = want or ranked
        assert ranked == want
        above = _plan(detect.detect(_tracks(spark), "pairs", p)).split("Join")[0]
        assert "Exchange" not in above and "Window" not in above


def test_infinite_places_pair_with_none(spark):
    df = _tracks(spark).withColumn("distance_of_gpspoint", F.when(F.col("idx") == "1", float("inf")).when(F.col("idx") == "2", float("nan")).otherwise(F.col("distance_of_gpspoint")))
    for banded in (True, False):
        found = detect.detect(df, "pairs", Params(threshold=0.7, banded=banded))
        assert found.count() > 0 and found.where("idx1 IN ('1', '2') OR idx2 IN ('1', '2')").count() == 0


def test_cells_are_compared_by_column(spark):
    """a cell that goes on over batches, cells of one row and bodies of two lengths give what a single batch gives."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 16)).astype(np.float32)
    x[1::2] = x[::2] + 0.01
    names = e8.cells(e8.unit(x))
    rows = sorted((int(c), i) for i, own in enumerate(names) for c in set(own.tolist()))
    rows += [(max(rows)[0] + 1, 40)]
    bodies = [*[v.tobytes() for v in x], np.ones(8, np.float32).tobytes()]

    def batch(part):
        cell, i = zip(*part, strict=True)
        zero = pa.array([0] * len(i), pa.int32())
        longs = [pa.array(v, pa.int64()) for v in (i, i, i, [1] * len(i))]
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), zero, zero, zero, *longs, pa.array([bodies[k] for k in i], pa.binary())], names=list("abcdefghi"))

    def found(size):
        run = e8._compare(0.9, np.float32, e8.TABLES, e8.PROBES, 1, e8.STEP)
        return sorted(tuple(r.values()) for b in run(batch(rows[k : k + size]) for k in range(0, len(rows), size)) for r in b.to_pylist())

    whole = found(len(rows))
    assert {(a, b) for a, b, n in whole if n < 0} == {(k, k + 1) for k in range(0, 40, 2)}
    assert all(found(size) == whole for size in (1, 2, 3, 7))


def test_tasks_write_shapefiles_of_a_file_path(spark, tmp_path):
    """the driver passes nothing on, and what it wrote before, with Hadoop's checksums, is replaced."""
    frame = lambda x: spark.createDataFrame([("a", 1, [(x, 2.0)]), ("b", 2, [(x, 3.0)])], "file string, num long, geometry array<struct<lng:double,lat:double>>")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / ".a.shp.crc").write_bytes(b"crc\0 of another file")
    for x in (1.0, 5.0):
        shapefile.write_shapefiles(frame(x), f"file://{tmp_path}/out", "file", points=True)
        back = shapefile.read_shapefiles(spark, f"{tmp_path}/out/*.shp")
        assert sorted((r.num, *map(tuple, r.geometry)) for r in back.collect()) == [(1, (x, 2.0)), (2, (x, 3.0))]
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == [f"{n}.{s}" for n in "ab" for s in ("dbf", "shp", "shx")]


def test_farthest_of_window_without_a_shuffle_of_pairs(spark):
    """the same rows as ranking all events; pairs are not dealt out again."""
    p, df = Params(threshold=0.4), _tracks(spark).withColumn("direction", (F.minute("time") % 2 + 1).cast("double"))
    events = detect.detect(df, "mbr", p)
    want = merge.farthest_of_window(events, p)
    got = mbr.farthest_of_window(detect.rectangles(df, p), p)
    rows = lambda x: sorted(map(tuple, x.select(want.columns).collect()), key=str)
    assert rows(got) == rows(want) and 0 < want.count() < events.count()
    above = _plan(got).split("Join")[0]
    assert "Exchange" not in above and "Window" not in above


def test_memory_of_a_shard(spark):
    """op5: as many contexts as one anchor may bring to a task take less than 100 bytes for each of theirs."""
    rng = np.random.default_rng(1)
    contexts = np.repeat(rng.integers(97, 123, (1, 880), np.uint8), suffix_dedup.HOT, axis=0)
    contexts[np.arange(suffix_dedup.HOT)[:, None], rng.integers(0, 880, (suffix_dedup.HOT, 6))] = 65
    bodies, one, doc = [x.tobytes() for x in contexts], np.ones(suffix_dedup.HOT, np.int64), np.arange(suffix_dedup.HOT)
    run = suffix_dedup.decide(suffix_dedup.SIZE, "none", suffix_dedup.PASSAGE)
    tracemalloc.start()
    try:
        found = run(bodies, one * (880 - suffix_dedup.SIZE + 1), one, doc, 0 * one, doc)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found[0]) > suffix_dedup.HOT and peak < 100 * contexts.size


def test_chains_without_a_shuffle_of_events(spark):
    """the same rows as merging all events, of any gap and window; events are not dealt out again."""
    rows = lambda x, names: sorted(map(tuple, x.select(names).collect()), key=str)
    night = _tracks(spark).withColumn("time", F.col("time") + F.expr("INTERVAL 990 MINUTES"))  # over midnight
    odd = night.withColumn("gps_normalized_distance_length", F.when(F.col("idx") == "1", float("nan")).when(F.col("idx") != "2", F.col("gps_normalized_distance_length")))
    long = 0
    for p in (Params(threshold=0.45), Params(threshold=0.45, merge_gap_s=240), Params(threshold=0.4, window_minutes=7, merge_gap_s=60, min_duration_s=400), Params(threshold=0.45, merge_gap_s=0, partition_keys=("lineName",)), Params(threshold=0.4, merge_gap_s=600)):
        for df in (_tracks(spark), odd):
            want = merge.merge_chain(detect.detect(df, "mbr", p), p)
            found = rows(want, want.columns)
            assert rows(mbr.merged_chain(detect.rectangles(df, p), p), want.columns) == found and found
            long += sum("," in r[want.columns.index("win_st")] for r in found)
    assert long > 100
    # windows of a day whose clock is put back do not follow one another in time
    p, back = Params(threshold=0.45, merge_gap_s=240), _tracks(spark).withColumn("time", F.col("time") + F.expr("INTERVAL 300 DAYS") - F.expr("INTERVAL 390 MINUTES"))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        want = merge.merge_chain(detect.detect(back, "mbr", p), p)
        assert rows(mbr.merged_chain(detect.rectangles(back, p), p), want.columns) == rows(want, want.columns) != []
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    above = _plan(mbr.merged_chain(detect.rectangles(_tracks(spark), p), p)).split("Join")[0]
    assert "Exchange" not in above and "Window" not in above
