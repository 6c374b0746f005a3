"""Queries over the general tables, one or more for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import adjacency, mapping, mbr, merge, windows
from .plans import detect
from .schema import Params
from .sources import adapters, shapefile, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Thresholds of these tables' scale; the library's defaults are for real tracks.
NORMAL = Params(threshold=0.05)
KM = Params(threshold=0.5)
MERGE = Params(threshold=0.05, merge_gap_s=240, min_duration_s=180)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gps(spark, sf_dir) -> DataFrame:
    return adapters.gps_from_events(_read(spark, sf_dir, "events"))


def _stamp(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(col)


def _r(col, name: str | None = None, digits: int = 6):
    return F.round(F.col(col) if isinstance(col, str) else col, digits).alias(name or col)


def _half_up(col: str, digits: int = 6):
    """Rounds a number from 0 on as SQL does, without making a decimal of it."""
    steps = F.col(col) * 10.0**digits
    return ((F.floor(steps) + F.when(steps - F.floor(steps) >= 0.5, 1).otherwise(0)) / F.lit(10.0**digits)).alias(col)


def _t(col: str, name: str | None = None) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f') AS {name or col}"


# --- windows ---------------------------------------------------------------------------------------------------------

GPS = """gps AS (SELECT event_id, CAST(user_id AS VARCHAR) AS idx, 'L' || CAST(user_id % 5 AS VARCHAR) AS line, CAST((user_id // 5) % 2 + 1 AS DOUBLE) AS dir,
 TIMESTAMP '2024-01-01 07:00:00' + to_microseconds(CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 412 AS BIGINT)) AS t, value AS km, value / 600.0 AS nd FROM events)"""
WIN = GPS + """,
win AS (SELECT *, CAST(t AS DATE) AS day, CAST((hour(t) * 60 + minute(t)) - (hour(t) * 60 + minute(t)) % 4 AS INTEGER) AS win_st, lead(t) OVER (PARTITION BY line, idx ORDER BY t, km, nd) AS nxt FROM gps)"""
DENSE = WIN + """,
dense AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY line, idx, day, win_st) AS n FROM win WHERE line IS NOT NULL AND idx IS NOT NULL AND win_st IS NOT NULL) WHERE n >= 2)"""
MBR = DENSE + """,
mbr AS (SELECT line, dir, day, win_st, idx, min(t) AS t1, max(t) AS t2, min(nd) AS d1, max(nd) AS d2, arg_min(nd, (t, nd)) AS f, arg_max(nd, (t, nd)) AS l, count(*) AS n FROM dense GROUP BY ALL),
mbra AS (SELECT *, degrees(atan2(l - f, 1.0)) + CASE WHEN l - f < 0 THEN 360 ELSE 0 END AS angle FROM mbr)"""
OVER = MBR + """,
pair AS (SELECT a.line, a.dir, a.day, a.win_st, a.idx AS idx1, b.idx AS idx2, greatest(abs(b.d1 - (a.d1 + a.d2) / 2), abs(b.d2 - (a.d1 + a.d2) / 2)) AS distance, least(a.t1, b.t1) AS s, greatest(a.t2, b.t2) AS e
 FROM mbr a JOIN mbr b ON a.line = b.line AND a.dir = b.dir AND a.day = b.day AND a.win_st = b.win_st AND a.idx < b.idx AND a.t1 <= b.t2 AND b.t1 <= a.t2 AND a.d1 <= b.d2 AND b.d1 <= a.d2)"""
EVENT_SQL = "line AS \"lineName\", dir AS direction, idx1, idx2, win_st, round(distance, 6) AS distance, " + _t("s", "start_time") + ", " + _t("e", "end_time")


def _event_columns(df: DataFrame) -> DataFrame:
    return df.select("lineName", "direction", "idx1", "idx2", "win_st", _r("distance"), _stamp("start_time"), _stamp("end_time"), _r("duration"))


EVENT = EVENT_SQL + ", round((epoch_us(e) - epoch_us(s)) / 1e6, 6) AS duration"


@query(f"WITH {WIN} SELECT event_id, win_st, win_st + 4 AS win_end, strftime(day, '%Y-%m-%d') AS service_date FROM win")
def window_assign(spark, sf_dir):
    """Each point's window."""
    return windows.assign_windows(_gps(spark, sf_dir)).select("event_id", "win_st", "win_end", F.date_format("service_date", "yyyy-MM-dd").alias("service_date"))


@query(f"WITH {DENSE} SELECT event_id, line AS \"lineName\", idx, win_st FROM dense")
def dense_windows(spark, sf_dir):
    """Points of windows with two or more points of their vehicle."""
    return windows.dense_windows(windows.assign_windows(_gps(spark, sf_dir))).select("event_id", "lineName", "idx", "win_st")


@query(f"WITH {WIN} SELECT line AS \"lineName\", idx, win_st, count(*) AS \"count\" FROM win GROUP BY line, idx, day, win_st")
def window_counts(spark, sf_dir):
    """A1: points of each vehicle and window."""
    return windows.window_counts(windows.assign_windows(_gps(spark, sf_dir))).select("lineName", "idx", "win_st", "count")


@query(f"WITH {WIN} SELECT event_id, {_t('t', 'start_time')}, {_t('nxt', 'end_time')} FROM win WHERE nxt IS NOT NULL")
def next_fix(spark, sf_dir):
    """Each point's next fix."""
    return windows.next_fix(_gps(spark, sf_dir)).dropna(subset=["start_time", "end_time"]).select("event_id", _stamp("start_time"), _stamp("end_time"))


@query(f"WITH {DENSE} SELECT event_id, CAST(dir AS INTEGER) AS route_dir FROM dense WHERE dir = 1 UNION ALL SELECT event_id, 2 FROM dense WHERE dir IS DISTINCT FROM 1")
def direction_union(spark, sf_dir):
    """Both directions' points put together."""
    p = tracks.with_route_direction(windows.dense_windows(windows.assign_windows(_gps(spark, sf_dir)))).select("event_id", F.col("route_dir"))
    return tracks.union_directions([p.where("route_dir = 1"), p.where("route_dir = 2")])


@query("SELECT count(*) AS rows FROM events")
def partition_rows(spark, sf_dir):
    """Rows of each partition, summed up, as the parts depend on the layout."""
    return windows.partition_rows(_gps(spark, sf_dir)).agg(F.sum("rows").alias("rows"))


def _full(gps: DataFrame) -> DataFrame:
    """Tracks with all columns of the schema."""
    from .schema import GPS

    return gps.select(*[(F.col(f.name) if f.name in gps.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in GPS])


@query(f"WITH {GPS} SELECT idx, line AS \"lineName\", dir AS direction, strftime(t, '%Y-%m-%d %H:%M:%S') AS at_second, round(km, 6) AS distance_of_gpspoint FROM gps")
def tracks_csv(spark, sf_dir):
    """Tracks written as CSV, a folder a route, and read again with the fixed schema."""
    path = tracks.scratch(spark, "tracks")
    tracks.write_gps(_full(_gps(spark, sf_dir)), path, "csv")
    back = tracks.read_partitioned_csv(spark, path)
    return back.select("idx", "lineName", "direction", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("at_second"), _r("distance_of_gpspoint"))


@query(f"WITH {GPS} SELECT idx, line AS \"lineName\", dir AS direction, strftime(t, '%Y-%m-%d %H:%M:%S') AS at_second, round(km, 6) AS distance_of_gpspoint FROM gps")
def gps_csv(spark, sf_dir):
    """Mapped tracks as plain CSV files with a header, read with the fixed schema."""
    path = tracks.scratch(spark, "gps")
    _full(_gps(spark, sf_dir)).write.option("header", True).csv(path)
    back = tracks.read_gps_csv(spark, path)
    return back.select("idx", "lineName", "direction", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("at_second"), _r("distance_of_gpspoint"))


# --- rectangles ------------------------------------------------------------------------------------------------------


def _mbrs(spark, sf_dir, p: Params = NORMAL):
    return detect.rectangles(_gps(spark, sf_dir), p)


@query(f"WITH {MBR} SELECT line AS \"lineName\", dir AS direction, idx, win_st, {_t('t1', 'min_time')}, {_t('t2', 'max_time')}, round(d1, 6) AS min_dis_location, round(d2, 6) AS max_dis_location, epoch_us(t1) // 1000000 AS min_timestamp, epoch_us(t2) // 1000000 AS max_timestamp, n AS n_points FROM mbr")
def vehicle_mbr(spark, sf_dir):
    """The rectangle of each vehicle and window."""
    return _mbrs(spark, sf_dir).select("lineName", "direction", "idx", "win_st", _stamp("min_time"), _stamp("max_time"), _r("min_dis_location"), _r("max_dis_location"), "min_timestamp", "max_timestamp", "n_points")


@query(f"WITH {MBR} SELECT line AS \"lineName\", dir AS direction, idx, win_st, round(f, 6) AS first_dis, round(l, 6) AS last_dis, round(angle, 6) AS angle FROM mbra")
def first_last_angle(spark, sf_dir):
    """First and last position and the movement's angle."""
    return _mbrs(spark, sf_dir).select("lineName", "direction", "idx", "win_st", _r("first_dis"), _r("last_dis"), _r("angle"))


@query(f"WITH {OVER} SELECT line AS \"lineName\", dir AS direction, win_st, idx1, idx2 FROM pair")
def mbr_overlap_pairs(spark, sf_dir):
    """Overlapping rectangles of different vehicles."""
    return mbr.overlap_pairs(_mbrs(spark, sf_dir), NORMAL).select("lineName", "direction", "win_st", "idx1", "idx2")


@query(f"WITH {OVER.replace('a.t1 <= b.t2 AND b.t1 <= a.t2', 'epoch_us(a.t1) // 1000000 <= epoch_us(b.t2) // 1000000 AND epoch_us(b.t1) // 1000000 <= epoch_us(a.t2) // 1000000')} SELECT line AS \"lineName\", dir AS direction, win_st, idx1, idx2 FROM pair")
def mbr_overlap_pairs_second(spark, sf_dir):
    """J5 with whole seconds."""
    p = Params(threshold=0.05, time_precision="second")
    return mbr.overlap_pairs(_mbrs(spark, sf_dir, p), p).select("lineName", "direction", "win_st", "idx1", "idx2")


@query(f"WITH {OVER} SELECT {EVENT} FROM pair WHERE distance < 0.05")
def mbr_bunching(spark, sf_dir):
    """J5, kernel, F7: bunching of overlapping rectangles."""
    return _event_columns(detect.detect(_gps(spark, sf_dir), "mbr", NORMAL))


@query(
    f"WITH {DENSE}, mbr AS (SELECT day, win_st, idx, min(t) AS t1, max(t) AS t2, min(nd) AS d1, max(nd) AS d2 FROM dense GROUP BY ALL), "
    + "pair AS (SELECT a.win_st, a.idx AS idx1, b.idx AS idx2, greatest(abs(b.d1 - (a.d1 + a.d2) / 2), abs(b.d2 - (a.d1 + a.d2) / 2)) AS distance FROM mbr a JOIN mbr b ON a.day = b.day AND a.win_st = b.win_st AND a.idx < b.idx AND a.t1 <= b.t2 AND b.t1 <= a.t2 AND a.d1 <= b.d2 AND b.d1 <= a.d2) "
    + "SELECT win_st, count(*) AS pairs, round(max(distance), 6) AS farthest FROM pair WHERE distance < 0.05 GROUP BY win_st"
)
def mbr_bunching_any_route(spark, sf_dir):
    """J5 without route and direction as keys, counted by window."""
    p = Params(threshold=0.05, partition_keys=())
    return detect.detect(_gps(spark, sf_dir), "mbr", p).groupBy("win_st").agg(F.count("*").alias("pairs"), F.round(F.max("distance"), 6).alias("farthest"))


LINE = OVER.replace("greatest(abs(b.d1 - (a.d1 + a.d2) / 2), abs(b.d2 - (a.d1 + a.d2) / 2)) AS distance", "a.d1 AS ya, a.d2 AS yb, b.d1 AS yc, b.d2 AS yd, (epoch_us(a.t1) - epoch_us(least(a.t1, b.t1))) / 1e6 AS xa, (epoch_us(a.t2) - epoch_us(least(a.t1, b.t1))) / 1e6 AS xb, (epoch_us(b.t1) - epoch_us(least(a.t1, b.t1))) / 1e6 AS xc, (epoch_us(b.t2) - epoch_us(least(a.t1, b.t1))) / 1e6 AS xd")


@query(
    f"WITH {LINE}, m AS (SELECT *, (yb - ya) / nullif(xb - xa, 0) AS k FROM pair), "
    + "q AS (SELECT *, coalesce(greatest(abs(yc - ya - k * (xc - xa)), abs((yc + yd) / 2 - ya - k * ((xc + xd) / 2 - xa)), abs(yd - ya - k * (xd - xa))) / sqrt(k * k + 1), greatest(abs(yc - (ya + yb) / 2), abs((yc + yd) / 2 - (ya + yb) / 2), abs(yd - (ya + yb) / 2))) AS distance FROM m) "
    + f"SELECT {EVENT} FROM q WHERE distance < 0.05"
)
def mbr_bunching_line(spark, sf_dir):
    """Kernel in line mode: perpendicular distance in window-relative seconds."""
    return _event_columns(detect.detect(_gps(spark, sf_dir), "mbr", Params(threshold=0.05, distance_mode="line")))


# --- pairs of points -------------------------------------------------------------------------------------------------

NEAR = DENSE + """,
near AS (SELECT a.line, a.dir, a.day, a.win_st, a.idx AS idx1, b.idx AS idx2, abs(b.km - a.km) AS distance, least(a.t, b.t) AS s, greatest(a.nxt, b.nxt) AS e
 FROM dense a JOIN dense b ON a.line = b.line AND a.dir = b.dir AND a.day = b.day AND a.win_st = b.win_st AND a.idx < b.idx WHERE a.nxt IS NOT NULL AND b.nxt IS NOT NULL AND abs(b.km - a.km) < 0.5),
far AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY line, dir, day, win_st, idx1, idx2 ORDER BY round(distance, 9) DESC) AS rk FROM near) WHERE rk = 1)"""


@query(f"WITH {NEAR} SELECT {EVENT} FROM far")
def pairs_bunching(spark, sf_dir):
    """All pairs of points of a window, plain."""
    return _event_columns(detect.detect(_gps(spark, sf_dir), "pairs", Params(threshold=0.5, banded=False)))


@query(f"WITH {NEAR} SELECT {EVENT} FROM far")
def pairs_bunching_banded(spark, sf_dir):
    """J6 by bands: the same rows."""
    return _event_columns(detect.detect(_gps(spark, sf_dir), "pairs", KM))


# --- neighbours by angle ---------------------------------------------------------------------------------------------


def _adjacent(order: str, distance: str) -> str:
    nxt = lambda c: f"lead({c}) OVER w AS x_{c}"
    return MBR + f""",
nx AS (SELECT *, {", ".join(nxt(c) for c in ("idx", "angle", "t1", "t2", "d1", "d2", "f", "l"))} FROM mbra WINDOW w AS (PARTITION BY line, dir, day, win_st ORDER BY {order})),
adj AS (SELECT line, dir, day, win_st, least(idx, x_idx) AS idx1, greatest(idx, x_idx) AS idx2, abs(x_angle - angle) AS diff, {distance} AS distance, least(t1, x_t1) AS s, greatest(t2, x_t2) AS e,
 t1 <= x_t2 AND x_t1 <= t2 AND d1 <= x_d2 AND x_d1 <= d2 AS meets FROM nx WHERE x_idx IS NOT NULL AND x_idx <> idx)"""


BY_ANGLE = _adjacent("angle, idx", "abs((x_d1 + x_d2) / 2 - (d1 + d2) / 2)")
BY_IDX = _adjacent("idx", "abs(x_f - l)")


@query(f"WITH {BY_ANGLE} SELECT line AS \"lineName\", dir AS direction, win_st, idx1, idx2, round(least(diff, 360 - diff), 6) AS angle_diff, round(distance, 6) AS distance FROM adj")
def angle_adjacent_pairs(spark, sf_dir):
    """Neighbours in the order of angles."""
    return adjacency.adjacent_pairs(_mbrs(spark, sf_dir), NORMAL).select("lineName", "direction", "win_st", "idx1", "idx2", _r("angle_diff"), _r("distance"))


@query(f"WITH {BY_ANGLE} SELECT {EVENT} FROM adj WHERE least(diff, 360 - diff) <= 3 AND meets AND distance < 0.05")
def angle_bunching(spark, sf_dir):
    """F5, F6, F7 over J7."""
    return _event_columns(detect.detect(_gps(spark, sf_dir), "angle", NORMAL))


@query(f"WITH {BY_IDX} SELECT {EVENT} FROM adj WHERE diff <= 3 AND meets AND distance < 0.05")
def angle_bunching_by_idx(spark, sf_dir):
    """The same with neighbours in the order of vehicles and angles as plain numbers."""
    return _event_columns(detect.detect(_gps(spark, sf_dir), "angle", Params(threshold=0.05, order_by="idx", angle_mode="literal")))


# --- merging ---------------------------------------------------------------------------------------------------------

LOOK = OVER + """,
ev AS (SELECT *, lead(s) OVER w AS ns, lead(e) OVER w AS ne, lead(win_st) OVER w AS nw FROM pair WHERE distance < 0.05 WINDOW w AS (PARTITION BY line, dir, day, idx1, idx2 ORDER BY win_st, s, e, distance)),
mg AS (SELECT *, coalesce(epoch_us(ns) // 1000000 - epoch_us(e) // 1000000 < 240, false) AS j FROM ev),
lk AS (SELECT line, dir, idx1, idx2, win_st, CAST(win_st AS VARCHAR) || CASE WHEN j THEN ',' || CAST(nw AS VARCHAR) ELSE '' END AS merged_win_st, distance, s, CASE WHEN j THEN ne ELSE e END AS e FROM mg)"""


@query(f"WITH {LOOK} SELECT {EVENT_SQL}, merged_win_st, epoch_us(e) // 1000000 - epoch_us(s) // 1000000 AS duration FROM lk WHERE epoch_us(e) // 1000000 - epoch_us(s) // 1000000 >= 180")
def merge_lookahead(spark, sf_dir):
    """Each event extended by the pair's next."""
    out = merge.merge_lookahead(detect.detect(_gps(spark, sf_dir), "mbr", MERGE), MERGE)
    return out.select("lineName", "direction", "idx1", "idx2", "win_st", "merged_win_st", _r("distance"), _stamp("start_time"), _stamp("end_time"), "duration")


CHAIN = OVER + """,
ev AS (SELECT *, max(e) OVER (PARTITION BY line, dir, day, idx1, idx2 ORDER BY win_st, s, e, distance ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM pair WHERE distance < 0.05),
il AS (SELECT *, sum(CASE WHEN epoch_us(s) - epoch_us(pe) < 240000000 THEN 0 ELSE 1 END) OVER (PARTITION BY line, dir, day, idx1, idx2 ORDER BY win_st, s, e, distance) AS island FROM ev),
ch AS (SELECT line, dir, idx1, idx2, string_agg(CAST(win_st AS VARCHAR), ',' ORDER BY win_st) AS win_st, arg_min(distance, (win_st, s, e, distance)) AS distance, min(s) AS s, max(e) AS e FROM il GROUP BY line, dir, day, idx1, idx2, island)"""


@query(f"WITH {CHAIN} SELECT {EVENT} FROM ch WHERE epoch_us(e) - epoch_us(s) >= 180000000")
def merge_chain(spark, sf_dir):
    """Runs of a pair's events as one."""
    return _event_columns(mbr.merged_chain(detect.rectangles(_gps(spark, sf_dir), MERGE), MERGE))


@query(f"WITH {OVER}, b AS (SELECT line, dir, win_st, idx1, idx2, row_number() OVER (PARTITION BY day, line, dir ORDER BY round(distance, 6) DESC, win_st, idx1, idx2) AS place, round(distance, 6) AS distance FROM pair WHERE distance < 0.05) SELECT line AS \"lineName\", dir AS direction, place, win_st, idx1, idx2, distance FROM b WHERE place <= 2")
def top_events(spark, sf_dir):
    """The two farthest events of each route and direction."""
    from pyspark.sql import Window

    e = detect.detect(_gps(spark, sf_dir), "mbr", NORMAL).withColumn("distance", F.round("distance", 6))
    own = Window.partitionBy("service_date", "lineName", "direction").orderBy(F.desc("distance"), "win_st", "idx1", "idx2")
    return e.withColumn("place", F.row_number().over(own).cast("long")).where("place <= 2").select("lineName", "direction", "place", "win_st", "idx1", "idx2", "distance")


@query(f"WITH {OVER.replace('(user_id // 5) % 2 + 1', 'event_id % 2 + 1')} SELECT {EVENT} FROM (SELECT *, row_number() OVER (PARTITION BY day, win_st, idx1, idx2 ORDER BY round(distance, 9) DESC, line, dir, s, e) AS place FROM pair WHERE distance < 0.05) WHERE place = 1")
def farthest_of_window(spark, sf_dir):
    """Of each pair and window the farthest event, over both directions, in which these vehicles are seen at once."""
    both = _gps(spark, sf_dir).withColumn("direction", (F.col("event_id") % 2 + 1).cast("double"))
    # texts are made once a rectangle, and a pair takes those of the earlier start and the later end
    timed = detect.rectangles(both, NORMAL).withColumns({"_from": _stamp("min_time"), "_to": _stamp("max_time")})
    e = mbr.farthest_of_two(timed, NORMAL, ("_from", "_to"))
    start = F.when(F.col("min_time1") <= F.col("min_time2"), F.col("_from1")).otherwise(F.col("_from2"))
    end = F.when(F.col("max_time1") >= F.col("max_time2"), F.col("_to1")).otherwise(F.col("_to2"))
    return e.select("lineName", "direction", "idx1", "idx2", "win_st", _half_up("distance"), start.alias("start_time"), end.alias("end_time"), "duration")


@query(
    "WITH g AS (SELECT CAST(user_id AS VARCHAR) AS idx, event_type AS line, CAST((hour(ts) * 60 + minute(ts)) - (hour(ts) * 60 + minute(ts)) % 4 AS INTEGER) AS win_st, value / 600.0 AS nd FROM events), "
    "d AS (SELECT line, idx, win_st, count(*) AS n_points, min(nd) AS lo, max(nd) AS hi FROM g WHERE line IS NOT NULL AND idx IS NOT NULL AND win_st IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) "
    'SELECT line AS "lineName", idx, win_st, n_points, round(lo, 6) AS min_dis_location, round(hi, 6) AS max_dis_location FROM d'
)
def minute_of_day_windows(spark, sf_dir):
    """Windows by minute of the day, whatever the day."""
    p = Params(window_key="minute_of_day")
    m = detect.rectangles(adapters.gps_by_type(_read(spark, sf_dir, "events")), p)
    return m.select("lineName", "idx", "win_st", "n_points", _r("min_dis_location"), _r("max_dis_location"))


# --- mapping ---------------------------------------------------------------------------------------------------------

NET = """v AS (SELECT 'L' || CAST(p_partkey % 5 AS VARCHAR) AS line, CAST(1 + (p_partkey // 5) % 2 AS INTEGER) AS dir, CAST(p_partkey // 100 AS INTEGER) AS seg, CAST(p_partkey // 10 % 10 AS INTEGER) AS vertex,
 114e0 + (p_partkey // 10) * 0.001 AS lng, 22.5e0 + ((7 * (p_partkey // 10)) % 13) * 0.0005 AS lat FROM part)"""
KM_SQL = "sqrt(power(6378137.0 * (1 - e2) / power(1 - e2 * power(sin(radians(({b} + {d}) / 2)), 2), 1.5) * radians({d} - {b}), 2) + power(6378137.0 / sqrt(1 - e2 * power(sin(radians(({b} + {d}) / 2)), 2)) * cos(radians(({b} + {d}) / 2)) * radians({c} - {a}), 2)) / 1000".replace("e2", "0.0066943799901413165")
INDEX = NET + f""",
o AS (SELECT *, row_number() OVER w - 1 AS ord, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat FROM v WINDOW w AS (PARTITION BY line, dir ORDER BY seg, vertex)),
ix AS (SELECT line, dir, seg, vertex, lng, lat, CAST(ord AS INTEGER) AS ord, sum(coalesce({KM_SQL.format(a="plng", b="plat", c="lng", d="lat")}, 0.0)) OVER (PARTITION BY line, dir ORDER BY seg, vertex ROWS UNBOUNDED PRECEDING) AS km FROM o),
len AS (SELECT line, dir, max(km) AS route_km FROM ix GROUP BY line, dir)"""
RAW = GPS + ", " + INDEX + """,
top AS (SELECT max(p_partkey // 100) AS top FROM part),
raw AS (SELECT event_id, idx, line, dir, t, seg, 114e0 + (seg * 10 + event_id % 10) * 0.001 + (event_id % 7) * 0.0001 AS lng, 22.5e0 + (7 * (seg * 10 + event_id % 10) % 13) * 0.0005 + (event_id % 11) * 0.00003 AS lat, event_id % 3 AS journey
 FROM (SELECT *, CAST(event_id % (top.top + 2) AS INTEGER) AS seg FROM gps, top)),
ed AS (SELECT * FROM (SELECT line, dir, seg, vertex, km, lng, lat, lead(lng) OVER w AS lng2, lead(lat) OVER w AS lat2 FROM ix WINDOW w AS (PARTITION BY line, dir, seg ORDER BY vertex)) WHERE lng2 IS NOT NULL),
nr AS (SELECT * FROM (SELECT r.*, ed.vertex, ed.km, ed.lng AS elng, ed.lat AS elat, row_number() OVER (PARTITION BY r.event_id ORDER BY sqrt(power(r.lng - ed.lng, 2) + power(r.lat - ed.lat, 2)) + sqrt(power(r.lng - ed.lng2, 2) + power(r.lat - ed.lat2, 2)), ed.vertex) AS k
 FROM raw r JOIN ed ON r.line = ed.line AND CASE WHEN r.dir = 1 THEN 1 ELSE 2 END = ed.dir AND r.seg = ed.seg) WHERE k = 1)"""


def _network(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    return adapters.network_from_part(part), adapters.sequence_from_part(part)


def _index(spark, sf_dir):
    return mapping.build_distance_index(*_network(spark, sf_dir))


def _raw(spark, sf_dir):
    return adapters.gps_on_network(_read(spark, sf_dir, "events"), _read(spark, sf_dir, "part"))


@query(f"WITH {INDEX} SELECT line AS \"lineName\", dir AS net_direction, ord, CAST(seg AS VARCHAR) AS opath, round(lng, 6) AS lng, round(lat, 6) AS lat, round(km, 6) AS distance_opath FROM ix")
def distance_index(spark, sf_dir):
    """Cumulative km of every vertex."""
    return _index(spark, sf_dir).select("lineName", "net_direction", "ord", "opath", _r("lng"), _r("lat"), _r("distance_opath"))


@query(f"WITH {INDEX} SELECT line AS \"lineName\", round(max(route_km) FILTER (dir = 1), 6) AS distance_dir1, round(max(route_km) FILTER (dir = 2), 6) AS distance_dir2 FROM len GROUP BY line")
def route_length(spark, sf_dir):
    """Lengths of both directions."""
    return mapping.route_length_table(_index(spark, sf_dir)).select("lineName", _r("distance_dir1"), _r("distance_dir2"))


@query(f"WITH {RAW} SELECT event_id, vertex, round(km, 6) AS km FROM nr")
def nearest_segment(spark, sf_dir):
    """The nearest edge of each point's segment."""
    near = mapping.nearest_edge(_raw(spark, sf_dir), mapping.segments(_index(spark, sf_dir)))
    return near.select("event_id", F.col("edge.vertex").alias("vertex"), _r(F.col("edge.km"), "km"))


@query(f"WITH {INDEX} SELECT line AS \"lineName\", dir AS net_direction, ord, CAST(seg AS VARCHAR) AS opath, vertex, round(km, 6) AS distance_opath FROM ix")
def distance_index_csv(spark, sf_dir):
    """The distance index written as CSV, replacing what was there, and read again."""
    path = tracks.scratch(spark, "index")
    tracks.write_distance_index(_index(spark, sf_dir), path)
    return tracks.read_distance_index(spark, path).select("lineName", "net_direction", "ord", "opath", "vertex", _r("distance_opath"))


def _mapped(df: DataFrame) -> DataFrame:
    return df.select("idx", "opath", "lineName", "direction", "t_flag", _stamp("time"), _r("lng"), _r("lat"), _r("distance_of_gpspoint"), _r("gps_normalized_distance_length"))


MAPPED = "SELECT idx, CAST(seg AS VARCHAR) AS opath, line AS \"lineName\", nr.dir AS direction, CAST(journey AS INTEGER) AS t_flag, " + _t("t", "time") + ", round(lng, 6) AS lng, round(lat, 6) AS lat, round(km + {off}, 6) AS distance_of_gpspoint, round((km + {off}) / nullif(route_km, 0), 6) AS gps_normalized_distance_length FROM nr JOIN len USING (line) WHERE len.dir = CASE WHEN nr.dir = 1 THEN 1 ELSE 2 END"


@query(f"WITH {RAW} " + MAPPED.format(off=KM_SQL.format(a="elng", b="elat", c="lng", d="lat")))
def map_gps_km(spark, sf_dir):
    """Points mapped to km."""
    return _mapped(mapping.map_gps(tracks.raw_points(_raw(spark, sf_dir)), _index(spark, sf_dir)))


@query(f"WITH {RAW} " + MAPPED.format(off="sqrt(power(lng - elng, 2) + power(lat - elat, 2))"))
def map_gps_degrees(spark, sf_dir):
    """The same with the offset in degrees."""
    return _mapped(mapping.map_gps(tracks.raw_points(_raw(spark, sf_dir)), _index(spark, sf_dir), "degrees"))


@query(
    f"WITH {RAW}, c AS (SELECT line, count(DISTINCT idx) AS cars, count(*) AS points FROM raw GROUP BY line), s AS (SELECT line, CAST(count(*) AS DOUBLE) AS segment_length FROM v GROUP BY line) "
    "SELECT len.line AS \"lineName\", coalesce(any_value(cars), 0) AS cars, coalesce(any_value(points), 0) AS points, any_value(segment_length) AS segment_length, round(max(route_km) FILTER (dir = 1), 6) AS distance_dir1, round(max(route_km) FILTER (dir = 2), 6) AS distance_dir2 FROM len LEFT JOIN c USING (line) LEFT JOIN s USING (line) GROUP BY len.line"
)
def line_summary(spark, sf_dir):
    """One row for each route."""
    s = mapping.line_summary(_raw(spark, sf_dir), *_network(spark, sf_dir), _index(spark, sf_dir))
    return s.select("lineName", "cars", "points", "segment_length", _r("distance_dir1"), _r("distance_dir2"))


@query(ORACLES["line_summary"].replace("coalesce(any_value(cars), 0) AS cars", "CASE WHEN len.line = 'L0' THEN -1 ELSE coalesce(any_value(cars), 0) END AS cars"))
def line_info_csv(spark, sf_dir):
    """The routes' table written, all but one of its routes updated, and read again."""
    path = tracks.scratch(spark, "lines")
    s = line_summary(spark, sf_dir)
    tracks.write_line_info(s.withColumn("cars", F.lit(-1)), path)
    tracks.update_line_info(s.where("lineName <> 'L0'"), path)
    return tracks.read_line_info(spark, path)


@query(ORACLES["distance_index"])
def network_shapefile(spark, sf_dir):
    """The network as shapefiles, one a route and direction, read again and made into the distance index."""
    path = tracks.scratch(spark, "network")
    network, sequence = _network(spark, sf_dir)
    shapefile.write_shapefiles(network.withColumn("file", F.concat_ws("-", "lineName", "direction")), path, "file")
    back = shapefile.read_shapefiles(spark, f"{path}/*.shp").withColumn("direction", F.col("direction").cast("int"))
    index = mapping.build_distance_index(back, sequence)
    return index.select("lineName", "net_direction", "ord", "opath", _r("lng"), _r("lat"), _r("distance_opath"))


@query(f"WITH {RAW} SELECT event_id, idx, line AS \"lineName\", dir AS direction, CAST(seg AS VARCHAR) AS opath, {_t('t', 'time')}, round(lng, 6) AS lng, round(lat, 6) AS lat FROM raw")
def vehicle_shapefiles(spark, sf_dir):
    """S3: raw points as shapefiles, one a vehicle, all read again; the file's name tells the vehicle."""
    path = tracks.scratch(spark, "vehicles")
    raw = _raw(spark, sf_dir).withColumn("geometry", F.array(F.struct("lng", "lat")))
    shapefile.write_shapefiles(raw.select("idx", "event_id", "lineName", "direction", "opath", _stamp("time"), "geometry"), path, "idx", points=True)
    back = shapefile.read_shapefiles(spark, f"{path}/*.shp")
    point = F.col("geometry")[0]
    return back.select("event_id", F.regexp_extract("source", r"([^/]+)\.shp$", 1).alias("idx"), "lineName", "direction", "opath", "time", _r(point["lng"], "lng"), _r(point["lat"], "lat"))


@query(f"WITH {DENSE} SELECT win_st, count(*) AS pts, count(DISTINCT idx) AS vehicles, round(sum(nxt_s), 3) AS gap_s FROM (SELECT *, (epoch_us(nxt) - epoch_us(t)) / 1e6 AS nxt_s FROM dense) GROUP BY win_st")
def window_load(spark, sf_dir):
    """F2, W1 and date functions: load of each window."""
    p = windows.dense_windows(windows.assign_windows(windows.next_fix(_gps(spark, sf_dir))))
    gap = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6
    return p.groupBy("win_st").agg(F.count("*").alias("pts"), F.countDistinct("idx").alias("vehicles"), F.round(F.sum(gap), 3).alias("gap_s"))


