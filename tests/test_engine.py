"""Hand-made goldens, independent oracles and properties of the trajectory engine."""

import math
import random
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.functions import kernel
from routeloom.functions.geo import geodesic_km
from routeloom.operators import adjacency, mapping, mbr, merge, pairs, windows
from routeloom.plans import detect
from routeloom.schema import GPS, LINE_INFO, NETWORK, SEQUENCE, Params
from routeloom.sources import shapefile, tracks
from routeloom.streaming.windows import stream_mbrs

DAY = datetime(2024, 1, 1)


def at(hms, day=DAY):
    h, m, s = hms.split(":")
    return day + timedelta(hours=int(h), minutes=int(m), seconds=float(s))


def gps(spark, rows):
    """rows: (idx, line, direction, time, km, fraction)"""
    return spark.createDataFrame([(i, None, line, d, None, t, None, None, km, nd) for i, line, d, t, km, nd in rows], GPS)


def track(spark, **vehicles):
    """name=[(time, fraction), ...] on one route."""
    return gps(spark, [(v, "L", 1.0, at(t), 10 * y, y) for v, ps in vehicles.items() for t, y in ps])


def test_window_edges(spark):
    times = ["07:00:00", "07:03:59.999999", "07:04:00", "23:59:59", "00:00:00"]
    got = windows.assign_windows(gps(spark, [(str(k), "L", 1.0, at(t), 0.0, 0.0) for k, t in enumerate(times)])).orderBy("idx").collect()
    assert [r.win_st for r in got] == [420, 420, 424, 1436, 0] and [r.win_end - r.win_st for r in got] == [4] * 5


def test_dense_windows(spark):
    rows = [("a", "L", 1.0, at("07:00:10"), 0.0, 0.0), ("a", "L", 1.0, at("07:04:10"), 0.0, 0.0), ("a", "L", 2.0, at("07:05:10"), 0.0, 0.0)]
    rows += [(None, "L", 1.0, at("07:00:10"), 0.0, 0.0)] * 2 + [("b", "L", 1.0, None, 0.0, 0.0)] * 2 + [("c", "L", None, at("07:00:00"), 0.0, 0.0)] * 2
    got = windows.dense_windows(windows.assign_windows(gps(spark, rows))).collect()
    assert sorted((r.idx, r.win_st) for r in got) == [("a", 424), ("a", 424), ("c", 420), ("c", 420)]


def test_days_are_apart_unless_told(spark):
    rows = [("a", "L", 1.0, at("07:00:10"), 0.0, 0.1), ("a", "L", 1.0, at("07:00:20", DAY + timedelta(days=1)), 0.0, 0.2)]
    assert detect.rectangles(gps(spark, rows)).count() == 0
    assert detect.rectangles(gps(spark, rows), Params(window_key="minute_of_day")).count() == 1


def test_next_fix(spark):
    df = track(spark, a=[("07:00:00", 0.1), ("07:09:00", 0.2)])
    got = {r.start_time: r.end_time for r in windows.next_fix(df).collect()}
    assert got == {at("07:00:00"): at("07:09:00"), at("07:09:00"): None}


def test_touching_rectangles_meet(spark):
    df = track(spark, a=[("07:00:00", 0.1), ("07:01:00", 0.2)], b=[("07:01:00", 0.2), ("07:02:00", 0.3)], c=[("07:02:00.5", 0.3), ("07:03:00", 0.3)], d=[("07:02:00", 0.31), ("07:03:00", 0.4)])
    pair = lambda p: {(r.idx1, r.idx2) for r in mbr.overlap_pairs(detect.rectangles(df, p), p).collect()}
    assert pair(Params()) == {("a", "b")}
    assert pair(Params(time_precision="second")) == {("a", "b"), ("b", "c")}


def test_threshold_is_strict(spark):
    df = track(spark, a=[("07:00:00", 0.0), ("07:03:00", 0.5)], b=[("07:00:00", 0.0), ("07:03:00", 0.5)], c=[("07:00:00", 0.125), ("07:03:00", 0.375)])
    names = lambda t: {(r.idx1, r.idx2): r.distance for r in detect.detect(df, "mbr", Params(threshold=t)).collect()}
    assert names(0.25) == {("a", "c"): 0.125, ("b", "c"): 0.125}
    assert names(0.2500001) == {("a", "b"): 0.25, ("a", "c"): 0.125, ("b", "c"): 0.125}


def test_routes_are_not_mixed_unless_told(spark):
    rows = [(i, line, 1.0, at(t), 0.0, 0.1) for i, line in (("a", "L"), ("a", "M"), ("b", "M")) for t in ("07:00:00", "07:01:00")]
    assert {(r.lineName, r.idx1, r.idx2) for r in detect.detect(gps(spark, rows), "mbr").collect()} == {("M", "a", "b")}
    assert detect.detect(gps(spark, rows), "mbr", Params(partition_keys=())).count() == 1


@pytest.mark.parametrize("seed", [0, 1])
def test_rank_keeps_ties_and_bands_change_nothing(spark, seed):
    rng = random.Random(seed)
    rows = [(str(rng.randrange(12)), "L", 1.0, DAY + timedelta(seconds=rng.randrange(25200, 26400)), rng.randrange(400) / 16, 0.0) for _ in range(400)]
    df = gps(spark, rows)
    events = lambda d, **k: sorted(map(tuple, detect.detect(d, "pairs", Params(threshold=0.5, **k)).collect()))
    plain = events(df, banded=False)
    assert plain == events(df) == events(df.orderBy(F.rand(seed)).repartition(7)) and plain
    p = Params(threshold=0.5)
    near = pairs.near_points(windows.dense_windows(windows.assign_windows(windows.next_fix(df))), p)
    best = {}
    for r in near.collect():
        best.setdefault((r.win_st, r.idx1, r.idx2), []).append(r.distance)
    assert len(plain) == sum(v.count(max(v)) for v in best.values())


def test_rectangle_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    df = gps(spark, [(str(rng.randrange(15)), "L", 1.0, DAY + timedelta(seconds=rng.randrange(25200, 28800)), 0.0, rng.random()) for _ in range(500)])
    m = detect.rectangles(df)
    rows = m.collect()
    brute = {(a.win_st, a.idx, b.idx) for a in rows for b in rows if a.idx < b.idx and a.min_time <= b.max_time and b.min_time <= a.max_time and a.min_dis_location <= b.max_dis_location and b.min_dis_location <= a.max_dis_location}
    assert {(r.win_st, r.idx1, r.idx2) for r in mbr.overlap_pairs(m).collect()} == brute


def test_vertical_kernel_is_least_squares_on_epoch_seconds(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(200):
        t = 1.7e9 + rng.uniform(0, 240, 4)
        y = rng.uniform(0, 1, 4)
        (x1, x2), (x3, x4) = sorted(t[:2]), sorted(t[2:])
        m, c = np.linalg.lstsq(np.array([[x1, 1], [x2, 1]]), y[:2], rcond=None)[0]
        away = [abs(-m * x + v - c) / math.sqrt(m * m + 1) for x, v in ((x3, y[2]), ((x3 + x4) / 2, (y[2] + y[3]) / 2), (x4, y[3]))]
        rows.append((*map(float, y), float(max(away))))
    got = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").select(F.abs(kernel.vertical(F.col("a"), F.col("b"), F.col("c"), F.col("d")) - F.col("e")).alias("x")).agg(F.max("x")).first()[0]
    assert got < 1e-6


def test_line_kernel(spark):
    df = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0, 0.0, 5.0, 3.0, 4.0), (1.0, 0.0, 1.0, 2.0, 0.0, 4.0, 1.0, 5.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    got = [r[0] for r in df.select(kernel.perpendicular(*[F.col(c) for c in "abcdefgh"])).collect()]
    assert got == pytest.approx([3.0, 4.0])


def vincenty_km(lng1, lat1, lng2, lat2):
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    want = lam = math.radians(lng2 - lng1)
    for _ in range(100):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if s == 0:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma, sin_al = math.atan2(s, c), math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        cos2 = 1 - sin_al**2
        cm = c - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0
        k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        new = want + (1 - k) * f * sin_al * (sigma + k * s * (cm + k * c * (-1 + 2 * cm**2)))
        if abs(new - lam) < 1e-13:
            break
        lam = new
    q = cos2 * (a * a - b * b) / (b * b)
    big = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
    small = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
    return b * big * (sigma - small * s * (cm + small / 4 * (c * (-1 + 2 * cm**2)))) / 1000


def test_geodesic(spark):
    rng = random.Random(1)
    rows = [(114 + rng.gauss(0, 0.01), 22.6 + rng.gauss(0, 0.01), 114 + rng.gauss(0, 0.01), 22.6 + rng.gauss(0, 0.01)) for _ in range(100)]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double").select(geodesic_km(*[F.col(c) for c in "abcd"])).collect()
    assert [g[0] for g in got] == pytest.approx([vincenty_km(*r) for r in rows], rel=1e-6)


EVENT = "lineName string, direction double, service_date date, idx1 string, idx2 string, win_st int, distance double, start_time timestamp, end_time timestamp, duration double"


def events(spark, *rows):
    return spark.createDataFrame([("L", 1.0, DAY.date(), a, b, w, d, at(s), at(e), 0.0) for a, b, w, d, s, e in rows], EVENT)


def test_merge_gaps_and_durations(spark):
    df = events(
        spark,
        ("a", "b", 420, 0.1, "07:00:00", "07:02:00"), ("a", "b", 424, 0.2, "07:02:04", "07:03:30"),
        ("a", "c", 420, 0.1, "07:00:00", "07:02:00"), ("a", "c", 424, 0.2, "07:02:05", "07:03:30"),
        ("a", "d", 420, 0.1, "07:00:00", "07:02:00"), ("a", "d", 424, 0.2, "07:01:50", "07:03:00"),
        ("a", "e", 420, 0.1, "07:00:00", "07:02:59"), ("a", "f", 420, 0.1, "07:00:00", "07:03:00"),
    )
    look = {(r.idx2, r.win_st): (r.duration, r.merged_win_st) for r in merge.merge_lookahead(df).collect()}
    assert look == {("b", 420): (210, "420,424"), ("d", 420): (180, "420,424"), ("f", 420): (180, "420")}
    chain = {r.idx2: (r.win_st, r.duration, r.distance) for r in merge.merge_chain(df).collect()}
    assert chain == {"b": ("420,424", 210.0, 0.1), "d": ("420,424", 180.0, 0.1), "f": ("420", 180.0, 0.1)}


def test_chain_and_lookahead_differ(spark):
    rows = [("a", "b", 996 + 4 * k, 0.1, f"16:{36 + 4 * k}:00", f"16:{39 + 4 * k}:58") for k in range(3)]
    other = [("a", "c", w, d, s, e) for _, _, w, d, s, e in rows[:2]]
    p = Params(merge_gap_s=5)
    chain = sorted((r.idx2, r.win_st) for r in merge.merge_chain(events(spark, *rows, *other), p).collect())
    assert chain == [("b", "996,1000,1004"), ("c", "996,1000")]
    look = sorted((r.idx2, r.win_st, r.duration) for r in merge.merge_lookahead(events(spark, *rows, *other), p).collect())
    assert [x for x in look if x[0] == "b"] == [("b", 996, 478), ("b", 1000, 478), ("b", 1004, 238)]
    assert merge.merge_chain(events(spark).limit(0)).collect() == []


def test_angles_on_the_circle(spark):
    df = track(spark, a=[("07:00:00", 0.5), ("07:03:00", 0.49)], b=[("07:00:00", 0.5), ("07:03:00", 0.502)])
    m = detect.rectangles(df)
    assert sorted(round(r.angle, 2) for r in m.collect()) == [0.11, 359.43]
    assert adjacency.adjacent_pairs(m).first().angle_diff == pytest.approx(0.687, abs=1e-3)
    assert adjacency.adjacent_pairs(m, Params(angle_mode="literal")).first().angle_diff == pytest.approx(359.313, abs=1e-3)


def test_neighbours_by_angle_or_by_vehicle(spark):
    df = track(spark, A=[("07:00:00", 0.1), ("07:03:00", 0.3)], B=[("07:00:00", 0.1), ("07:03:00", 0.5)], C=[("07:00:00", 0.1), ("07:03:00", 0.2)])
    m = detect.rectangles(df)
    got = lambda p: {(r.idx1, r.idx2): round(r.distance, 6) for r in adjacency.adjacent_pairs(m, p).collect()}
    assert got(Params()) == {("A", "C"): 0.05, ("A", "B"): 0.1}
    assert got(Params(order_by="idx")) == {("A", "B"): 0.2, ("B", "C"): 0.4}


def net(spark, segs, seq):
    n = spark.createDataFrame([("L", 1, f, 1.0, g) for f, g in segs], NETWORK)
    return n, spark.createDataFrame([("L", 1, k, s) for k, s in enumerate(seq)], SEQUENCE)


SEGS = [("1", [(114.0, 22.5), (114.01, 22.5)]), ("2", [(114.02, 22.5), (114.03, 22.5), (114.04, 22.5)])]


def test_distance_index(spark):
    index = mapping.build_distance_index(*net(spark, SEGS, ["1", "2", "9", "1"])).orderBy("ord").collect()
    assert [(r.ord, r.opath) for r in index] == [(0, "1"), (1, "1"), (2, "2"), (3, "2"), (4, "2"), (5, "1"), (6, "1")]
    step = vincenty_km(114.0, 22.5, 114.01, 22.5)
    assert [r.distance_opath for r in index] == pytest.approx([0, step, 2 * step, 3 * step, 4 * step, 8 * step, 9 * step], rel=1e-5)


def points(spark, *rows):
    """(opath, lng, lat, direction)"""
    return spark.createDataFrame([(str(k), o, "L", x, y, at("07:00:00"), 7, d) for k, (o, x, y, d) in enumerate(rows)], "idx string, opath string, linenumber string, lng double, lat double, time timestamp, journey int, direction int")


def test_mapping(spark):
    index = mapping.build_distance_index(*net(spark, SEGS, ["1", "2", "1"]))
    raw = tracks.raw_points(points(spark, ("2", 114.0305, 22.5, 1), ("1", 114.002, 22.5, 1), ("2", 114.03, 22.6, 1), ("9", 114.0, 22.5, 1), ("2", None, 22.5, 1), ("2", 114.03, 22.5, 2)))
    got = {r.idx: r for r in mapping.map_gps(raw, index).collect()}
    step = vincenty_km(114.0, 22.5, 114.01, 22.5)
    assert set(got) == {"0", "1", "2"} and got["0"].t_flag == 7
    assert got["0"].distance_of_gpspoint == pytest.approx(3.05 * step, rel=1e-5)
    assert got["1"].distance_of_gpspoint == pytest.approx(0.2 * step, rel=1e-5)
    assert got["0"].gps_normalized_distance_length == pytest.approx(3.05 / 9, rel=1e-4)
    edge = {r.idx: r.edge.vertex for r in mapping.nearest_edge(raw, mapping.segments(index)).collect()}
    assert edge == {"0": 1, "1": 0, "2": 0}  # the first of edges equally near
    degrees = {r.idx: r.distance_of_gpspoint for r in mapping.map_gps(raw, index, "degrees").collect()}
    assert degrees["1"] == pytest.approx(0.002, rel=1e-6)
    with pytest.raises(ValueError):
        mapping.map_gps(raw, index, "miles")


def test_empty_inputs(spark):
    none = gps(spark, [])
    for method in ("pairs", "mbr", "angle"):
        e = detect.detect(none, method)
        assert e.collect() == [] and detect.merge_events(e, "chain").collect() == [] and detect.merge_events(e).collect() == []
    index = mapping.build_distance_index(*net(spark, [], []))
    assert mapping.route_length_table(index).collect() == [] and mapping.map_gps(tracks.raw_points(points(spark)), index).collect() == []
    with pytest.raises(ValueError):
        detect.detect(none, "tree")
    with pytest.raises(ValueError):
        Params(window_key="week")


def test_planted_bunching_is_found(spark):
    rows = []
    for name, late in (("a", 0), ("b", 600), ("c", 2400)):
        for k in range(0, 3600, 15):
            catch = min(1.0, k / 1800) if name == "b" else 0  # b catches up with a in half an hour
            y = (k + 1000 - late * (1 - catch)) / 20000
            rows.append((name, "L", 1.0, at("07:00:00") + timedelta(seconds=k), 20 * y, y))
    for method in ("mbr", "angle"):
        found = detect.merge_events(detect.detect(gps(spark, rows), method, Params(threshold=0.02, merge_gap_s=30)), "chain", Params(merge_gap_s=30)).collect()
        assert {(r.idx1, r.idx2) for r in found} == {("a", "b")}
        assert max(r.end_time for r in found) >= at("07:59:00") and max(r.duration for r in found) >= 1600


def test_csv_round_trips(spark, tmp_path):
    df = track(spark, a=[("07:00:00", 0.25), ("07:03:00", 0.5)])
    tracks.write_gps(df, f"{tmp_path}/p")
    assert sorted(map(tuple, tracks.read_gps(spark, f"{tmp_path}/p").collect())) == sorted(map(tuple, df.collect()))
    tracks.write_gps(df, f"{tmp_path}/c", "csv")
    assert sorted(map(tuple, tracks.read_partitioned_csv(spark, f"{tmp_path}/c").collect())) == sorted(map(tuple, df.collect()))
    df.coalesce(1).write.option("header", True).csv(f"{tmp_path}/g")
    assert tracks.read_gps_csv(spark, f"{tmp_path}/g/*.csv").count() == 2
    index = mapping.build_distance_index(*net(spark, SEGS, ["1", "2"]))
    tracks.write_distance_index(index, f"{tmp_path}/i")
    tracks.write_distance_index(index, f"{tmp_path}/i")
    assert sorted(map(tuple, tracks.read_distance_index(spark, f"{tmp_path}/i").collect())) == sorted(map(tuple, index.select(*tracks.read_distance_index(spark, f"{tmp_path}/i").columns).collect()))


def test_bad_csv_cells_are_null_and_bad_headers_raise(spark, tmp_path):
    head = ",".join(f.name for f in GPS)
    (tmp_path / "a.csv").write_text(f"{head}\na,1,L,x,1,2024/01/01 07:00,114.0,22.5,1.0,0.1\n")
    row = tracks.read_gps_csv(spark, f"{tmp_path}/a.csv").first()
    assert (row.direction, row.time, row.lng) == (None, None, 114.0)
    (tmp_path / "b.csv").write_text(head.replace("t_flag,", "") + "\na,1,L,1,2024-01-01 07:00:00,114.0,22.5,1.0,0.1\n")
    with pytest.raises(Exception, match="(?i)schema|column"):
        tracks.read_gps_csv(spark, f"{tmp_path}/b.csv").collect()


def write_shapefile(path, shapes, columns, rows):
    body = b""
    for k, pts in enumerate(shapes):
        if pts is None:
            rec = struct.pack("<i", 0)
        elif isinstance(pts, tuple):
            rec = struct.pack("<i2d", 1, *pts)
        else:
            rec = struct.pack("<i4d2ii", 3, 0, 0, 0, 0, 1, len(pts), 0) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">2i", k + 1, len(rec) // 2) + rec
    path.with_suffix(".shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + b"\0" * 72 + body)
    head = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([size, dec]) + b"\0" * 14 for n, k, size, dec in columns)
    size = 1 + sum(c[2] for c in columns)
    data = b"".join(b" " + b"".join(str("" if v is None else v).rjust(c[2]).encode() for v, c in zip(r, columns, strict=True)) for r in rows)
    path.with_suffix(".dbf").write_bytes(struct.pack("<4BIHH", 3, 24, 1, 1, len(rows), 33 + len(head), size) + b"\0" * 20 + head + b"\r" + data)


@pytest.mark.parametrize("how", ["format", "function"])
def test_shapefiles(spark, tmp_path, how):
    columns = [("fid", "N", 6, 0), ("length", "F", 10, 3), ("name", "C", 5, 0)]
    write_shapefile(tmp_path / "one", [[(114.0, 22.5), (114.01, 22.5)], None], columns, [(1, 1.5, "a"), (None, None, None)])
    write_shapefile(tmp_path / "two", [(1.0, 2.0)], columns, [(3, 2.5, "b")])
    if how == "format":
        shapefile.register(spark)
        df = spark.read.format("shapefile").load(str(tmp_path))
    else:
        df = shapefile.read_shapefiles(spark, f"{tmp_path}/*.shp")
    got = sorted(((r.fid, r.length, r.name, None if r.geometry is None else [tuple(p) for p in r.geometry], r.source.rsplit("/", 1)[1]) for r in df.collect()), key=str)
    assert got == sorted([(1, 1.5, "a", [(114.0, 22.5), (114.01, 22.5)], "one.shp"), (None, None, None, None, "one.shp"), (3, 2.5, "b", [(1.0, 2.0)], "two.shp")], key=str)


def test_stream_gives_the_batch_rectangles(spark, tmp_path):
    rng = random.Random(8)
    df = gps(spark, [(str(rng.randrange(5)), "L", 1.0, DAY + timedelta(seconds=rng.randrange(25200, 27000)), 0.0, rng.random()) for _ in range(200)])
    batch = detect.rectangles(df).select(*stream_mbrs(df).columns)
    df.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(GPS).parquet(f"{tmp_path}/in")
    run = stream_mbrs(source).writeStream.outputMode("complete").format("memory").queryName("rectangles").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("rectangles").collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("method", ["pairs", "mbr", "angle"])
def test_plans_have_no_python(spark, tmp_path, method):
    track(spark, a=[("07:00:00", 0.25), ("07:03:00", 0.5)]).write.parquet(f"{tmp_path}/t")
    e = detect.merge_events(detect.detect(spark.read.parquet(f"{tmp_path}/t"), method))
    plan = e._jdf.queryExecution().explainString(e.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))
    assert "lng" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_one_shuffle_serves_next_fix_and_dense_windows(spark):
    df = windows.dense_windows(windows.assign_windows(windows.next_fix(track(spark, a=[("07:00:00", 0.1)]))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_partitioned_csv_with_another_header_raises(spark, tmp_path):
    from routeloom import schema as S
    from routeloom.sources import tracks

    names = [f.name for f in S.GPS]
    row = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in S.GPS]).withColumn("lineName", F.lit("L1"))
    swapped = [n for n in names if n not in ("lng", "lat")] + ["lat", "lng"]
    for k, columns in enumerate([names, [n for n in names if n != "t_flag"], swapped]):
        path = str(tmp_path / str(k))
        row.select(*columns).write.partitionBy("lineName").option("header", True).csv(path)
        if k == 0:
            assert tracks.read_partitioned_csv(spark, path).count() == 1
        else:
            with pytest.raises(ValueError, match="header"):
                tracks.read_partitioned_csv(spark, path)


def test_shapefiles_round_trip(spark, tmp_path):
    schema = "file string, num long, size double, name string, geometry array<struct<lng:double,lat:double>>"
    rows = [("a", 1, 1.5, "x", [(114.0, 22.5), (114.01, 22.5)]), ("a", None, None, None, None), ("b", 3, -1e-7, "\u00e9 ", [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)])]
    shapefile.write_shapefiles(spark.createDataFrame(rows, schema), str(tmp_path / "out"), "file")
    back = shapefile.read_shapefiles(spark, f"{tmp_path}/out/*.shp")
    got = sorted((r.source[-5:-4], r.num, r.size, r.name, r.geometry and [tuple(p) for p in r.geometry]) for r in back.collect() if r.num)
    assert got == [("a", 1, 1.5, "x", [(114.0, 22.5), (114.01, 22.5)]), ("b", 3, -1e-7, "\u00e9", [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)])]
    assert back.where("num IS NULL AND size IS NULL AND name IS NULL AND geometry IS NULL").count() == 1
    for wrong in (None, "", "a/b"):
        with pytest.raises(ValueError):
            shapefile.write_shapefiles(spark.createDataFrame([(wrong, *rows[0][1:])], schema), str(tmp_path / "no"), "file")


def test_line_info_update(spark, tmp_path):
    path = str(tmp_path / "lines")
    frame = lambda *r: spark.createDataFrame(r, LINE_INFO)
    tracks.write_line_info(frame(("L0", 1, 2, 3.0, None, 5.0), ("L1", 1, 2, 3.0, 4.0, 5.0)), path)
    tracks.update_line_info(frame(("L1", 9, 9, 9.0, 9.0, None), ("L2", 7, 7, None, 7.0, 7.0)), path)
    assert sorted(map(tuple, tracks.read_line_info(spark, path).collect())) == [("L0", 1, 2, 3.0, None, 5.0), ("L1", 9, 9, 9.0, 9.0, None), ("L2", 7, 7, None, 7.0, 7.0)]


def test_farthest_of_window(spark):
    day, at = "DATE '2024-01-01'", "TIMESTAMP '2024-01-01 07:00:0{}'"
    row = lambda line, a, b, win, d, k: f"('{line}', 1.0D, {day}, '{a}', '{b}', {win}, {d}D, {at.format(k)}, {at.format(k + 1)}, 1.0D)"
    rows = [row("L1", "a", "b", 420, 0.2, 0), row("L0", "a", "b", 420, 0.3, 1), row("L2", "a", "b", 420, 0.3, 0), row("L1", "a", "c", 420, 0.1, 0), row("L1", "a", "b", 424, 0.1, 0)]
    events = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(lineName, direction, service_date, idx1, idx2, win_st, distance, start_time, end_time, duration)")
    out = merge.farthest_of_window(events)
    assert sorted((r.idx2, r.win_st, r.lineName, r.distance) for r in out.collect()) == [("b", 420, "L0", 0.3), ("b", 424, "L1", 0.1), ("c", 420, "L1", 0.1)]
    assert out.columns == events.columns
