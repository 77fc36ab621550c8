"""Corporate-action integration and the data-gate table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import foundation as fd
from tidegauge.operators import pit, prices
from tidegauge.operators import reconcile as rec
from tidegauge.plans import views
from tidegauge.plans.views import table, with_views


def actions(spark, sf_dir):
    """Order dates of line items' suppliers as actions integrated with bars, statuses and calendar."""
    a = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("action_id"), F.col("l_suppkey").alias("code"),
        F.to_date("l_shipdate").alias("ex_date"), F.col("l_returnflag").alias("action_type"))
    bars = views.bars(spark, sf_dir).where("trades > 1")
    index = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    policy = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'").select(F.col("l_returnflag").alias("action_type")).distinct()
    r = fd.integrate_actions(a, views.identity(spark, sf_dir), views.calendar(spark, sf_dir), views.status(spark, sf_dir), bars, index, policy)
    return r.groupBy(*[f"axis_{n}" for n in fd.AXES], "status").agg(F.count("*").alias("actions"), F.sum("code").alias("codes"))


def gates(spark, sf_dir):
    """Three data gates over the derived tables, rolled up."""
    b = views.bars(spark, sf_dir)
    lo, hi = views.span(spark, sf_dir)
    cal = views.calendar(spark, sf_dir).join(b.select("trade_date").distinct().withColumn("seen", F.lit(True)), "trade_date", "left")
    from tidegauge.functions import rules as R

    spine = R.check(cal, R.must("CALENDAR_DAY_WITHOUT_BARS", F.col("seen")))
    intervals = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code")).join(
        pit.overlapping_keys(views.identity(spark, sf_dir), ["code"], "valid_from", "valid_to"), "code", "left")
    ident = R.check(intervals, R.must("IDENTITY_OVERLAP", F.col("first_overlap_day").isNull()))
    ohlc = prices.check_ohlc(b)
    components = fd.gate_table([
        fd.gate_component("identity", "intervals", ident), fd.gate_component("prices", "calendar", spine, "LIVE_DEPENDENT"),
        fd.gate_component("prices", "ohlc", ohlc)])
    return rec.gate_rollup(components)


QUERIES = {"actions_integration": actions, "gates_from_tables": gates}

ORACLE = {
    "actions_integration": with_views(["bars", "ident", "cal"], """
        , a AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS d, l_returnflag AS t FROM lineitem),
        ix AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_totalprice > 300000),
        j AS (SELECT a.code, i.code IS NOT NULL AS im, c.is_trading_day AS cm, b.code IS NOT NULL AS bm, ix.d IS NOT NULL AS xm, t <> 'A' AS pm
              FROM a LEFT JOIN ident i ON i.code = a.code AND a.d >= valid_from AND (valid_to IS NULL OR a.d <= valid_to)
              JOIN cal c ON c.trade_date = a.d LEFT JOIN bars b ON b.code = a.code AND b.trade_date = a.d AND b.trades > 1 LEFT JOIN ix ON ix.d = a.d)
        SELECT CASE WHEN im THEN 'PASS' ELSE 'BLOCKED' END AS axis_identity, CASE WHEN cm THEN 'PASS' ELSE 'BLOCKED' END AS axis_calendar,
               CASE WHEN im THEN 'PASS' ELSE 'BLOCKED' END AS axis_status, CASE WHEN bm THEN 'PASS' ELSE 'PARTIAL' END AS axis_eod,
               CASE WHEN xm THEN 'PASS' ELSE 'PARTIAL' END AS axis_benchmark, CASE WHEN pm THEN 'PASS' ELSE 'PARTIAL' END AS axis_policy,
               CASE WHEN NOT im OR NOT cm THEN 'BLOCKED' WHEN bm AND xm AND pm THEN 'PASS' ELSE 'PARTIAL' END AS status,
               count(*) AS actions, CAST(sum(code) AS BIGINT) AS codes FROM j GROUP BY 1, 2, 3, 4, 5, 6, 7"""),
    "gates_from_tables": with_views(["cal"], """
        SELECT 'identity' AS gate, 1 AS components, 'PASS' AS status, 'PROVEN_REAL_EVIDENCE' AS classification, TRUE AS rights_compatible
        UNION ALL SELECT 'prices', 2, CASE WHEN n > 0 THEN 'BLOCKED' ELSE 'PARTIAL' END, CASE WHEN n > 0 THEN 'BLOCKED' ELSE 'LIVE_DEPENDENT' END, n = 0
        FROM (SELECT count(*) AS n FROM cal WHERE trade_date NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem))"""),
}
