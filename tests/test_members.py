"""The sweep over valid and known time, and gaps by session numbers, against plain versions."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidegauge.operators import pit, prices

IDENTITY = "security_id long, valid_from date, valid_to date, known_from timestamp, known_to timestamp, tradable boolean, known_at string"


def test_counts_of_members_against_rectangles(spark):
    rng = random.Random(5)
    day, instant = lambda n: date(2024, 1, 1) + timedelta(n), lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    rows = []
    for i in range(400):
        start, known = rng.randrange(-20, 60), rng.randrange(-400, 1400)
        rows.append((i, rng.choice([day(start)] * 9 + [None]), rng.choice([day(start + rng.randrange(-3, 30)), None]),
                     rng.choice([instant(known)] * 9 + [None]), rng.choice([instant(known + rng.randrange(-20, 500)), None]), rng.random() < 0.9, "clash"))
    rows += rows[:50]  # repeated rows count again
    # Several cutoffs a day, not rising with the day, a repeated probe and empty ones.
    probes = [(day(rng.randrange(40)), instant(rng.randrange(1000))) for _ in range(60)]
    table = probes + probes[:3] + [(None, instant(1)), (day(1), None)]
    got = pit.count_members(
        spark.createDataFrame(table, "as_of date, known_at timestamp"), spark.createDataFrame(rows, IDENTITY),
        {"members": F.lit(1), "ids": F.col("security_id")})
    want = {}
    for as_of, known in probes:
        inside = [r[0] for r in rows if r[5] and r[1] and r[3] and r[1] <= as_of and (r[2] is None or as_of <= r[2])
                  and r[3] <= known and (r[4] is None or known <= r[4])]
        want[as_of, known] = (len(inside), sum(inside))
    assert {(r["as_of"], r["known_at"]): (r["members"], r["ids"]) for r in got.collect()} == want
    assert max(n for n, _ in want.values()) > 20
    empty = pit.count_members(spark.createDataFrame([], "as_of date, known_at timestamp"), spark.createDataFrame(rows, IDENTITY))
    assert empty.columns == ["as_of", "known_at", "members"] and empty.count() == 0
    nobody = pit.count_members(spark.createDataFrame(probes[:2], "as_of date, known_at timestamp"), spark.createDataFrame([], IDENTITY))
    assert [r["members"] for r in nobody.collect()] == [0, 0]


def test_gaps_are_runs_of_missing_sessions(spark):
    days = [date(2024, 1, n) for n in (2, 3, 5, 8, 9, 10)]
    held = {"full": days, "none": [date(2024, 1, 4)], "head": days[2:], "holes": [days[0], days[0], days[3], date(2024, 1, 6)]}
    series = spark.createDataFrame([(k, d) for k, ds in held.items() for d in ds], "code string, trade_date date")
    sessions = spark.createDataFrame([(d,) for d in days + days[:1]], "trade_date date")
    runs = {(r["code"], r["first_session"], r["last_session"], r["sessions"]) for r in prices.session_gaps(series, sessions, "code").collect()}
    assert runs == {("none", 1, 6, 6), ("head", 1, 2, 2), ("holes", 2, 3, 2), ("holes", 5, 6, 2)}
    missing = sorted((r["code"], r["trade_date"]) for r in prices.missing_sessions(series, sessions, "code").collect())
    assert missing == sorted((k, d) for k, ds in held.items() for d in days if d not in ds)
    assert prices.session_gaps(series, sessions.limit(0), "code").count() == 0
