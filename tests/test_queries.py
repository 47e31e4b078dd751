import pytest

from skein.plans import catalog

from .oracle import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck(SF).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def usage_events(spark, folder):
    """Events at fractions of a second around the edges of the windows, at equal seconds in another order than their ids, and without a time."""
    t = ["00:00:00.500000", "00:00:01.500000", "00:00:01.499999", "00:59:59.500000", "00:59:59.499999", "01:00:00.500001", "01:00:00.600000", "01:00:01.400000", "03:00:01.500000", None]
    at = [(n, d, x) for d in ("2024-03-10", "2024-03-11", "1969-12-31") for n, x in enumerate(t)]
    rows = [(3998 - 4000 * (i % 2) + 4000 * i - i % 7 * 300, u, x and f"{d} {x}") for u in (1, 2) for i, (_, d, x) in enumerate(at, 1 + 40 * u)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "cast(ts as timestamp_ntz) AS ts", "'click' AS event_type", "1.0D AS value")
    events.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def holds(spark, folder, name):
    got = rows(catalog.queries()[name](spark, folder).toPandas())
    assert got == rows(duck(folder).sql(catalog.oracle_sql()[name]).df()) and len(got) == 60


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_breaker_decisions_at_fractions_of_seconds(spark, tmp_path, zone):
    folder, was = usage_events(spark, tmp_path), spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        holds(spark, folder, "breaker_decisions")
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_breaker_state_at_fractions_of_seconds(spark, tmp_path):
    holds(spark, usage_events(spark, tmp_path), "breaker_state")


def test_spend_windows_at_fractions_of_seconds(spark, tmp_path):
    holds(spark, usage_events(spark, tmp_path), "spend_windows")


def far_events(spark, folder):
    """Pairs of calls an hour apart but for about half a second, in years whose microseconds a double does not tell apart."""
    pairs = [(f"{year}-03-10", k, f) for year in ("0001", "2300", "9999") for k in range(1, 5) for f in range(499995, 500006)]
    rows = [r for n, (d, k, f) in enumerate(pairs) for r in ((8000 * n + 3999, n, f"{d} 00:00:0{k}.{f}"), (8000 * n + 1001, n, f"{d} 01:00:0{k}"))]
    return write_events(spark, folder, rows, "timestamp_ntz")


def write_events(spark, folder, rows, kind):
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", f"cast(ts as {kind}) AS ts", "'click' AS event_type", "1.0D AS value")
    events.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def same(spark, folder, name, n):
    got = rows(catalog.queries()[name](spark, folder).toPandas())
    assert got == rows(duck(folder).sql(catalog.oracle_sql()[name]).df()) and len(got) == n


def test_breaker_state_far_from_1970(spark, tmp_path):
    same(spark, far_events(spark, tmp_path), "breaker_state", 264)


def test_spend_windows_far_from_1970(spark, tmp_path):
    same(spark, far_events(spark, tmp_path), "spend_windows", 264)


def instant_events(spark, folder):
    """Instants around the hours that New York skips and repeats: a gap on its clocks is longer or shorter than the time between."""
    times = ["2024-03-10 06:30:00.5Z", "2024-03-10 07:10:00Z", "2024-03-11 06:45:00Z", "2024-11-03 05:30:00.5Z", "2024-11-03 06:40:00Z", "2024-11-04 05:45:00Z", None]
    return write_events(spark, folder, [(4000 * n + 1500 + 300 * n, u, t) for u in (1, 2) for n, t in enumerate(times, 10 * u)], "timestamp")


@pytest.mark.parametrize("name", ["spend_windows", "breaker_state"])
def test_windows_of_instants_where_clocks_change(spark, tmp_path, name):
    folder, was = instant_events(spark, tmp_path), spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        same(spark, folder, name, 14)
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
