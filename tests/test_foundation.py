"""Corporate actions against their six sides."""

from pyspark.sql import functions as F

from tidegauge.operators import foundation as fd


def integrate(spark, actions):
    def frame(rows, schema):
        d = spark.createDataFrame(rows, schema)
        return d.select(*[F.to_date(c).alias(c) if c.endswith(("date", "from", "to")) else F.col(c) for c in d.columns])

    identity = frame([(1, "2024-01-01", None), (2, "2024-01-01", "2024-01-31"), (2, "2024-01-20", None)], "code long, valid_from string, valid_to string")
    status = identity.select("code", F.col("valid_from").alias("effective_from"), F.col("valid_to").alias("effective_to")).where("code = 1")
    calendar = frame([("2024-01-10", True), ("2024-01-25", True), ("2024-01-27", False)], "trade_date string, is_trading_day boolean")
    eod = frame([(1, "2024-01-10"), (2, "2024-01-25"), (2, "2024-01-25")], "code long, trade_date string")
    benchmark = frame([("2024-01-10",)], "trade_date string")
    policy = spark.createDataFrame([("A",), ("B",), ("B",)], "action_type string")
    return fd.integrate_actions(frame(actions, "action_id string, code long, ex_date string, action_type string"), identity, calendar, status, eod, benchmark, policy)


def test_actions_meet_every_side_once(spark):
    rows = [("one", 1, "2024-01-10", "A"), ("two", 2, "2024-01-25", "B"), ("shut", 1, "2024-01-27", "C"), ("twice", 1, "2024-01-10", "A"), ("twice", 3, "2024-01-10", None),
            (None, 1, "2024-01-10", "A"), ("bare", None, None, None)]
    got = {(r.action_id, r.code): tuple(r[f"axis_{n}"][0] for n in fd.AXES) + (r.status,) for r in integrate(spark, rows).collect()}
    assert got == {
        ("one", 1): (*"PPPPPP", "PASS"), ("two", 2): (*"BPBBPB", "BLOCKED"), ("shut", 1): (*"PBPPPP", "BLOCKED"), ("twice", 1): (*"PBPPBP", "BLOCKED"),
        ("twice", 3): (*"PBPPBP", "BLOCKED"), (None, 1): (*"BBBPPP", "BLOCKED"), ("bare", None): (*"BBBPPP", "BLOCKED")}


def test_actions_with_an_id_of_their_own_are_not_shuffled_by_it(spark):
    plan = integrate(spark, [("one", 1, "2024-01-10", "A"), ("two", 2, "2024-01-25", "B")])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(action_id" not in plan, plan
