"""What the findings of round 3 showed."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from routeloom import queries
from routeloom.functions import libm
from routeloom.operators import mbr, merge
from routeloom.plans import detect
from routeloom.schema import Params

#: Four vehicles of a window, two of them with rises that are the same but for the last bits.
EVENTS = [
    ("2024-01-04 01:02:33.313914", 1410, 4.66),
    ("2024-01-04 08:18:48.238876", 1410, 66.59),
    ("2024-01-03 14:51:23.611895", 2440, 47.3),
    ("2024-01-04 09:46:30.753875", 2440, 108.78),
    ("2024-01-03 08:55:41.454327", 2960, 51.29),
    ("2024-01-03 22:36:19.009623", 2960, 112.89),
    ("2024-01-03 09:51:27.757924", 6830, 28.81),
    ("2024-01-03 11:11:22.58757", 6830, 90.41),
    ("2024-01-18 13:55:52.162796", 236, 17.93),
    ("2024-01-19 01:50:48.384492", 236, 65.01),
    ("2024-01-18 06:35:03.683865", 4616, 69.73),
    ("2024-01-18 19:18:08.150371", 4616, 116.95),
    ("2024-01-18 16:40:08.842798", 4666, 24.23),
    ("2024-01-19 05:46:30.330421", 4666, 71.69),
    ("2024-01-18 14:34:37.774577", 8306, 107.31),
    ("2024-01-19 00:33:14.868323", 8306, 154.53),
]


@pytest.mark.parametrize("name", ["angle_adjacent_pairs", "angle_bunching"])
def test_angles_tie_as_in_sql(spark, tmp_path, name):
    """an arctangent that is rounded otherwise than the C library's puts vehicles into another order."""
    con = duckdb.connect()
    values = ", ".join(f"({k}, TIMESTAMP '{t}', {u}, {v}e0)" for k, (t, u, v) in enumerate(EVENTS))
    con.execute(f"CREATE TABLE events AS SELECT CAST(k AS BIGINT) AS event_id, ts, CAST(u AS BIGINT) AS user_id, 'view' AS event_type, v AS value FROM (VALUES {values}) t(k, ts, u, v)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    found = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*found.columns)
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall()) and got.count() > 0


def test_arctangent_is_the_c_librarys(spark):
    draw = random.Random(1)
    x = [draw.uniform(-w, w) for w in (1 / 16, 1, 2, 100) for _ in range(5000)] + [0.0, 1.0, -1.0, 1 / 16, 16.0, 1e-320, -1e300, 2.0**56, math.inf, -math.inf]
    found = spark.createDataFrame([(v,) for v in x], "x double").select("x", libm.arctangent(F.col("x")).alias("a")).collect()
    assert [r.a for r in found] == [math.atan2(r.x, 1.0) for r in found]
    odd = spark.createDataFrame([(None,), (math.nan,)], "x double").select(libm.arctangent(F.col("x")).alias("a")).collect()
    assert odd[0].a is None and math.isnan(odd[1].a)


def _events(con, folder):
    """Crowded windows of vehicles that are seen in both directions, some of them at odd places."""
    con.execute("""CREATE TABLE events AS SELECT range AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(CAST(range * 7919 % 7000 * 412000000 AS BIGINT)) AS ts, range * 31 % 97 AS user_id, 'view' AS event_type,
 CASE range % 211 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 1e300 WHEN 3 THEN -0.0::DOUBLE ELSE (range * 7907 % 5003 + range % 2) / 50.0 END AS value FROM range(8000)""")
    con.execute(f"COPY events TO '{folder}/events.parquet'")


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_farthest_of_window_is_compiled(spark, tmp_path):
    """what is done for each of the pairs, whose number grows with the square of the vehicles', is done without lists,
    texts of times or rounded decimals; the rows are SQL's."""
    con = duckdb.connect()
    _events(con, tmp_path)
    found = con.sql(queries.ORACLES["farthest_of_window"])
    got = queries.QUERIES["farthest_of_window"](spark, str(tmp_path)).select(*found.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(found.fetchall()) and len(rows) > 1000
    above = _plan(got).split("Join")[0]
    assert "Exchange" not in above and not any(x in above for x in ("exists(", "date_format", ", 6)"))
    assert "_band" in _plan(got)


def test_near_pairs_of_any_places(spark):
    """Bands part no two rectangles under the threshold, wherever they are."""
    draw = random.Random(2)
    at = lambda k: draw.choice([draw.uniform(-1, 1), draw.randrange(-20, 20) * 0.05, draw.choice((1e9, -1e13, 3e16, 1e300)) + draw.randrange(9) * 0.05, math.inf, math.nan])
    spots = [at(k) for k in range(900)]
    rows = [(str(k), "L", -0.0 if k % 2 else 0.0, 1, y, y + draw.choice((0.0, draw.uniform(0, 0.2)))) for k, y in enumerate(spots)]
    df = spark.createDataFrame(rows, "idx string, lineName string, direction double, win_st int, min_dis_location double, max_dis_location double")
    df = df.withColumns({"service_date": F.lit("2024-01-01").cast("date"), **{f"{m}_time": F.lit("2024-01-01 07:00:00").cast("timestamp") for m in ("min", "max")}, "min_timestamp": F.lit(0), "max_timestamp": F.lit(0)})
    for threshold in (0.05, 0.01, 0.3):
        p = Params(threshold=threshold)
        pairs = lambda x: sorted(map(tuple, x.select("idx1", "idx2").collect()))
        want = pairs(mbr.under(mbr.with_distance(mbr.overlap_pairs(df, p), p), p))
        assert pairs(mbr.near_pairs(df, p)) == want and len(want) > 100


def test_farthest_of_two(spark):
    """The same rows as ranking all events; a third rectangle of a vehicle is refused, not passed over."""
    n = F.col("id")
    y = F.when(n % 60 + F.floor(n / 60) % 2 * 7 != 8, n * 7919 % 1009 / F.lit(1009.0))  # without, in one direction, for two vehicles
    df = spark.range(6000).select((n % 60).cast("string").alias("idx"), F.concat(F.lit("L"), n % 2).alias("lineName"), (F.floor(n / 60) % 2 + 1).cast("double").alias("direction"), F.timestamp_seconds(F.lit(1704092400) + n * 37 % 3600).alias("time"), (y * 20).alias("distance_of_gpspoint"), y.alias("gps_normalized_distance_length"))
    for threshold in (0.35, 0.45):
        p = Params(threshold=threshold)
        events = detect.detect(df, "mbr", p)
        want = merge.farthest_of_window(events, p)
        rows = lambda x: sorted(map(tuple, x.select(want.columns).collect()), key=str)
        for got in (mbr.farthest_of_two, mbr.farthest_of_window):
            assert rows(got(detect.rectangles(df, p), p)) == rows(want)
        assert 0 < want.count() < events.count()
    three = df.withColumn("direction", (F.minute("time") % 3).cast("double"))
    with pytest.raises(Exception, match="more than two rectangles"):
        mbr.farthest_of_two(detect.rectangles(three, p), p).collect()
