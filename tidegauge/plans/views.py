"""Market-research views over the driver tables, as DataFrames and as SQL.

``SQL`` holds the same views as common table expressions for the DuckDB oracle;
``with_views`` prefixes a query with the ones it names, in dependency order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import broadcast_if_small, materialise, pin_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; zone-less timestamps are read as UTC instants."""
    pin_utc(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier; the aggregate combines map-side, so a hot code costs no extra."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("k"),
    )
    return li.groupBy(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("trade_date")).agg(
        F.min_by("price", "k").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "k").alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("turnover"),
        F.count("*").alias("trades"),
    )


SQL: dict[str, str] = {
    "bars": """
        SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS trade_date,
               first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS open,
               max(l_extendedprice / l_quantity) AS high,
               min(l_extendedprice / l_quantity) AS low,
               last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS close,
               sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover, count(*) AS trades
        FROM lineitem GROUP BY 1, 2""",
}


def with_views(names: list[str], body: str) -> str:
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {ctes} {body}"


# --- event laboratory ------------------------------------------------------------

RUN_AT = "2002-06-01 00:00:00"


def lab_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as research events with nested factors and outcomes.

    Orders without line items have no outcomes and an incomplete denominator, so
    the contract reports them instead of the view hiding them.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"), F.sum("l_quantity").alias("qty")
    )
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    base = (
        table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").join(customer, "o_custkey", "left")
    )
    known = F.col("o_orderdate") - F.expr("INTERVAL 5 MINUTES")
    event_at = F.col("o_orderdate") + F.expr("INTERVAL 16 HOURS")

    def factor(name, value):
        return F.struct(
            F.lit(name).alias("factor_id"), value.alias("value"), known.alias("known_at"),
            F.lit("exchange").alias("source_id"), F.lit("PUBLIC_RESEARCH_ALLOWED").alias("rights_status"),
        )

    def given(value, *rows):
        # A slice of one or none each: a filter's lambda would have the whole array interpreted row by row.
        return F.concat(*[F.slice(F.array(r), 1, r[value].isNotNull().cast("int")) for r in rows])

    factors = given(
        "value",
        factor("ORDER_SIZE", F.col("o_totalprice") / 1e6 - 0.25),
        factor("BALANCE", F.col("c_acctbal") / 1e4),
        factor("QUANTITY", F.col("qty") / 100.0 - 1.0),
    )

    def outcome(i, horizon):
        value = (F.col("disc") - F.col("tax")) * (0.1 * (i + 1)) + (F.col("o_totalprice") / 1e6 - 0.25) * (
            0.02 * (i + 1)
        )
        return F.struct(
            F.lit(horizon).alias("horizon"), value.alias("excess_return"),
            (event_at + F.expr(f"INTERVAL {i + 1} DAYS")).alias("known_at"), F.lit("RAW").alias("price_basis"),
        )

    from tidegauge.operators.lab import HORIZONS

    outcomes = given("excess_return", *[outcome(i, h) for i, h in enumerate(HORIZONS)])
    return base.select(
        F.col("o_orderkey").cast("string").alias("event_id"),
        F.lpad(F.col("o_custkey").cast("string"), 4, "0").alias("official_code"),
        F.col("o_orderdate").alias("prediction_at"),
        event_at.alias("event_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 17 HOURS")).alias("evidence_known_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "PRIMARY").otherwise("PROBE").alias("cohort"),
        F.lit("EARNINGS").alias("event_type"),
        F.lit("exchange").alias("source_id"),
        F.lit("REGULATORY_EVIDENCE").alias("source_role"),
        F.lit("PUBLIC_RESEARCH_ALLOWED").alias("rights_status"),
        factors.alias("factors"),
        outcomes.alias("outcomes"),
        F.col("qty").isNotNull().alias("denominator_complete"),
        F.lit(True).alias("corporate_actions_reconciled"),
        F.col("c_acctbal").isNotNull().alias("identity_verified"),
    )


SQL["lab_base"] = """
    SELECT CAST(o.o_orderkey AS VARCHAR) AS event_id,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'PRIMARY' ELSE 'PROBE' END AS cohort,
           o_orderdate AS prediction_at,
           o_totalprice / 1e6 - 0.25 AS f1, c_acctbal / 1e4 AS f2, l.qty / 100.0 - 1.0 AS f3,
           l.disc - l.tax AS spread, l.qty IS NOT NULL AND c_custkey IS NOT NULL AS admitted
    FROM orders o
    LEFT JOIN (SELECT l_orderkey, avg(l_discount) AS disc, avg(l_tax) AS tax, sum(l_quantity) AS qty
               FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
    LEFT JOIN customer c ON c.c_custkey = o.o_custkey"""
SQL["lab_split"] = """
    SELECT *, CASE WHEN rn <= floor(n * 0.6) THEN 'TRAINING' WHEN rn <= floor(n * 0.8) THEN 'VALIDATION'
                   ELSE 'HOLDOUT' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY prediction_at, event_id) AS rn,
                 count(*) OVER (PARTITION BY cohort) AS n
          FROM lab_base WHERE admitted)"""
SQL["lab_long"] = """
    SELECT s.event_id, s.cohort, s.split, h.horizon, h.i,
           spread * (0.1 * h.i) + f1 * (0.02 * h.i) AS y, f1, f2, f3
    FROM lab_split s CROSS JOIN (VALUES ('INTRADAY', 1), ('NEXT_SESSION', 2), ('WEEK', 3), ('MONTH', 4),
                                        ('YEAR', 5)) h(horizon, i)"""
SQL["lab_raw"] = """
    SELECT horizon, factor_id, raw, raw / sum(abs(raw)) OVER (PARTITION BY horizon) AS base FROM (
      SELECT horizon, u.factor_id, sum(u.value * y) AS raw
      FROM lab_long, LATERAL (SELECT unnest(['ORDER_SIZE', 'BALANCE', 'QUANTITY']) AS factor_id,
                                     unnest([f1, f2, f3]) AS value) u
      WHERE split = 'TRAINING' GROUP BY 1, 2)"""
SQL["lab_scale"] = """
    SELECT v.horizon, greatest(-3.0, least(3.0, coalesce(sum(s * y) / nullif(sum(s * s), 0), 0))) AS scale
    FROM (SELECT l.horizon, y, f1 * a.base + f2 * b.base + f3 * c.base AS s
          FROM lab_long l
          JOIN lab_raw a ON a.horizon = l.horizon AND a.factor_id = 'ORDER_SIZE'
          JOIN lab_raw b ON b.horizon = l.horizon AND b.factor_id = 'BALANCE'
          JOIN lab_raw c ON c.horizon = l.horizon AND c.factor_id = 'QUANTITY'
          WHERE split = 'VALIDATION') v GROUP BY 1"""
SQL["lab_pred"] = """
    SELECT l.event_id, l.horizon, l.cohort, l.y,
           f1 * a.base * a.scale + f2 * b.base * b.scale + f3 * c.base * c.scale AS score
    FROM lab_long l
    JOIN (SELECT * FROM lab_raw JOIN lab_scale USING (horizon)) a
      ON a.horizon = l.horizon AND a.factor_id = 'ORDER_SIZE'
    JOIN (SELECT * FROM lab_raw JOIN lab_scale USING (horizon)) b
      ON b.horizon = l.horizon AND b.factor_id = 'BALANCE'
    JOIN (SELECT * FROM lab_raw JOIN lab_scale USING (horizon)) c
      ON c.horizon = l.horizon AND c.factor_id = 'QUANTITY'
    WHERE split = 'HOLDOUT'"""
LAB = ["lab_base", "lab_split", "lab_long", "lab_raw", "lab_scale", "lab_pred"]


# --- calendar, identity and status --------------------------------------------------

def span(spark: SparkSession, sf_dir: str):
    """First order day and last ship day: the collection window of the data."""
    lo = table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("d")).first()["d"]
    hi = table(spark, sf_dir, "lineitem").agg(F.to_date(F.max("l_shipdate")).alias("d")).first()["d"]
    return lo, hi


def quarter_ends(spark: SparkSession, lo, hi) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("trade_date"))
    return days.where(
        (F.col("trade_date") == F.last_day("trade_date")) & (F.month("trade_date") % 3 == 0)
    ).withColumn("holiday_name", F.lit("QUARTER_END"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.operators.pit import build_calendar

    lo, hi = span(spark, sf_dir)
    return build_calendar(spark, lo, hi, quarter_ends(spark, lo, hi))


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive identity and status intervals per customer, one per order day."""
    from pyspark.sql import Window

    days = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("valid_from")
    ).agg(
        F.min("o_orderkey").alias("security_id"), F.min_by("o_orderstatus", "o_orderkey").alias("s"),
    )
    # One row per code and civil day, so the window is bounded by the calendar.
    following = F.lead("valid_from").over(Window.partitionBy("code").orderBy("valid_from"))
    return days.withColumn("valid_to", F.date_sub(following, 1)).select(
        "code", "security_id", F.lit("cash").alias("board"), "valid_from", "valid_to",
        F.lit("ACTIVE").alias("listing_status"),
        F.when(F.col("s") == "O", "TRADING").when(F.col("s") == "P", "SUSPENDED").otherwise("DELISTED").alias("status"),
        (F.col("valid_from").cast("timestamp") + F.expr("INTERVAL 36 HOURS")).alias("known_from"),
        (F.col("valid_to").cast("timestamp") + F.expr("INTERVAL 20 HOURS")).alias("known_to"),
        (F.col("s") != "F").alias("tradable"),
        F.lit("MAIN").alias("segment"),
    )


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity(spark, sf_dir).select(
        "code", "board", "status", F.col("valid_from").alias("effective_from"), F.col("valid_to").alias("effective_to")
    )


SQL["cal"] = """
    SELECT d AS trade_date, h IS NULL AND dayofweek(d) NOT IN (5, 6) AS is_trading_day,
           CASE WHEN h IS NOT NULL THEN 'OFFICIAL_HOLIDAY' WHEN dayofweek(d) IN (5, 6) THEN 'WEEKEND' END AS closed_reason
    FROM (SELECT CAST(g AS DATE) AS d,
                 CASE WHEN CAST(g AS DATE) = last_day(CAST(g AS DATE)) AND month(g) % 3 = 0 THEN 1 END AS h
          FROM (SELECT unnest(generate_series((SELECT min(o_orderdate) FROM orders),
                                              (SELECT max(l_shipdate) FROM lineitem), INTERVAL 1 DAY)) AS g))"""
SQL["ident"] = """
    SELECT *, CAST(valid_from AS TIMESTAMP) + INTERVAL 36 HOURS AS known_from,
           CAST(valid_to AS TIMESTAMP) + INTERVAL 20 HOURS AS known_to,
           CASE s WHEN 'O' THEN 'TRADING' WHEN 'P' THEN 'SUSPENDED' ELSE 'DELISTED' END AS status
    FROM (SELECT code, valid_from, security_id, s,
                 CAST(lead(valid_from) OVER (PARTITION BY code ORDER BY valid_from) - INTERVAL 1 DAY AS DATE) AS valid_to
          FROM (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS valid_from, min(o_orderkey) AS security_id,
                       arg_min(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1, 2))"""


# --- predictions and outcomes ---------------------------------------------------------

TOP_K = 5


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day and code: a score, its rank, and the next bar as the outcome."""
    from pyspark.sql import Window

    from tidegauge.operators.ordering import positions

    b = bars(spark, sf_dir)
    nxt = F.lead("close").over(Window.partitionBy("code").orderBy("trade_date"))
    rows = b.withColumn("next_close", nxt).where("next_close IS NOT NULL").select(
        F.col("trade_date").cast("string").alias("decision_id"), "code", "close", "next_close", "volume",
        F.when(F.col("trades") > 1, F.round(F.col("close") / F.col("open") - 1.0, 6)).alias("score"),
    )
    # The market comes from the placed rows, so bars are made and shuffled once.
    placed = positions(rows, [F.desc_nulls_last("score"), F.asc("code")], ["decision_id"], "_p")
    market = placed.groupBy("decision_id").agg(F.avg(F.col("next_close") / F.col("close") - 1.0).alias("market"))
    placed = placed.join(broadcast_if_small(materialise(market)), "decision_id")
    live = F.col("score").isNotNull()
    return placed.select(
        "decision_id", "code", "score", "close", "next_close",
        F.when(live, F.col("_p")).alias("rank"), (live & (F.col("_p") <= TOP_K)).alias("selected"), (~live).alias("abstained"),
        F.when(live, F.least(F.lit(1.0), F.abs("score"))).alias("probability"), F.lit("NET_EXCESS_GT_0").alias("target_rule"),
        F.col("close").alias("market_entry_price"), F.col("next_close").alias("market_exit_price"),
        (F.col("close") * 1.001).alias("executed_entry_price"), F.col("next_close").alias("executed_exit_price"),
        F.lit(1.0).alias("price_adjustment_factor"), F.lit(0.0).alias("cash_distribution_return"),
        F.lit(1.0).alias("benchmark_entry_value"), (F.lit(1.0) + F.col("market")).alias("benchmark_exit_value"),
        F.lit(0.001).alias("fees_return"), F.lit(0.0).alias("spread_return"), F.lit(0.0005).alias("slippage_return"),
        F.lit(0.0).alias("market_impact_return"),
        F.when(live & (F.col("_p") <= TOP_K), F.when(F.col("volume") > 30, "FILLED").otherwise("NOT_FILLED"))
        .otherwise("MARKET_OBSERVED").alias("fill_status"),
    )


SQL["outc"] = """
    SELECT *, score IS NULL AS abstained, rk <= 5 AND score IS NOT NULL AS selected, next_close / close - 1 AS gross,
           next_close / close - 1 - market AS net FROM (
      SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY score DESC NULLS LAST, code) AS rk,
             avg(next_close / close - 1) OVER (PARTITION BY decision_id) AS market FROM (
        SELECT CAST(trade_date AS VARCHAR) AS decision_id, code, close, volume, trades, open, high, low, turnover,
               CASE WHEN trades > 1 THEN round(close / open - 1, 6) END AS score,
               lead(close) OVER (PARTITION BY code ORDER BY trade_date) AS next_close FROM bars) WHERE next_close IS NOT NULL)"""
SQL["ranks"] = """
    SELECT *, rank() OVER (PARTITION BY decision_id ORDER BY score) + (count(*) OVER (PARTITION BY decision_id, score) - 1) / 2.0 AS rs,
           rank() OVER (PARTITION BY decision_id ORDER BY net) + (count(*) OVER (PARTITION BY decision_id, net) - 1) / 2.0 AS ro
    FROM outc WHERE NOT abstained"""
SQL["ics"] = """
    SELECT decision_id, count(*) AS scored, CASE WHEN count(*) >= 2 AND stddev_pop(rs) > 0 AND stddev_pop(ro) > 0
           THEN corr(rs, ro) END AS rank_ic FROM ranks GROUP BY 1"""
