"""Series of times with fractions of a second, against the SQL."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tideline.functions import series as S
from tideline.plans import timeseries as TS


@pytest.mark.parametrize("stat", ["dense", "chisq", "periodogram", "zscore", "moments"])
def test_times_are_rounded_to_seconds_as_in_the_sql(spark, tmp_path, stat):
    day = datetime(2024, 1, 1)
    times = [("a", day + timedelta(days=d, hours=h)) for d in range(30) for h in range(1 + d * d % 7)] + [("b", day + timedelta(days=d, hours=3)) for d in range(0, 30, 2)]
    times += [("a", day + timedelta(days=4, microseconds=-m)) for m in (300_000, 500_000, 700_000)] + [("b", day + timedelta(microseconds=-m)) for m in (200_000, 1_500_000)]
    times += [("b", day + timedelta(days=30, microseconds=-100_000)), ("a", day + timedelta(days=9, seconds=-1, microseconds=500_000))]
    spark.createDataFrame(times, "event_type string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT event_type, CAST(ts AS TIMESTAMP) AS ts FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = TS.QUERIES[f"ts_{stat}_events"](spark, str(tmp_path))
    want = con.sql(TS.ORACLE_SQL[f"ts_{stat}_events"])
    rows = [tuple(r[want.columns.index(c)] for c in got.columns) for r in want.fetchall()]
    assert len(rows) == got.count()
    for a, b in zip(sorted(map(tuple, got.collect())), sorted(rows), strict=True):
        assert a[:1] == b[:1] and a[1:] == pytest.approx(b[1:], abs=1e-6)


def test_rounding_of_large_values_is_that_of_the_sql(spark):
    xs = [24915860.6110795 + k * 2.0**-28 for k in range(-40, 40)] + [0.5e-6, -0.5e-6, 1.5e-6, 2.5e-6, -7.1234565, 1e-7, 0.0, 123456789.1234565, 4503599627.370497]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(S.rounded(F.col("x"), 6)).collect()]
    con = duckdb.connect()
    assert got == [con.sql(f"SELECT round(CAST({x!r} AS DOUBLE), 6)").fetchall()[0][0] for x in xs]
