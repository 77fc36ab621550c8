"""Bars from line items: contracts, returns, liquidity, signals, corporate actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import corporate_actions as ca
from tidegauge.operators import prices
from tidegauge.plans import views
from tidegauge.plans.views import table, with_views
from tidegauge.session import materialise


def _day(col="trade_date"):
    return F.col(col).cast("string").alias(col)


def daily_bars(spark, sf_dir):
    return views.bars(spark, sf_dir).select(
        "code", _day(), "open", "high", "low", "close", "volume", F.round("turnover", 2).alias("turnover"), "trades"
    )


def returns(spark, sf_dir):
    return prices.daily_returns(views.bars(spark, sf_dir)).select(
        "code", _day(), F.round("daily_return", 6).alias("daily_return")
    )


def liquidity(spark, sf_dir):
    m = prices.liquidity_metrics(views.bars(spark, sf_dir))
    return m.select(
        "code", "sessions", "traded_sessions", "missing_volume_sessions", "zero_volume_sessions",
        "zero_return_sessions", F.round("nontrading_ratio", 6).alias("nontrading_ratio"),
        F.round("median_volume", 4).alias("median_volume"), F.round("median_turnover", 4).alias("median_turnover"),
        F.round(F.col("amihud_illiquidity") * 1e6, 6).alias("amihud_per_million"),
    )


def window_signals(spark, sf_dir):
    s = prices.price_window_signals(views.bars(spark, sf_dir))
    return s.select(
        "code", "signal_kind", "n", "direction",
        *[F.round(c, 6).alias(c) for c in ("volatility", "drawdown", "strength", "materiality", "value")],
    )


def _stated_changes(spark, sf_dir):
    """Bars that state their own open-to-close change, to be tested against close-to-close."""
    return views.bars(spark, sf_dir).withColumn(
        "change_percent", F.round((F.col("close") / F.col("open") - 1.0) * 100.0, 6)
    )


def change_mismatch(spark, sf_dir):
    return prices.change_mismatches(_stated_changes(spark, sf_dir)).groupBy("code").agg(
        F.count("*").alias("mismatches"), F.max("trade_date").cast("string").alias("last_mismatch")
    )


def ohlc_contract(spark, sf_dir):
    """Single-line days count as untraded and must therefore carry no prices."""
    b = views.bars(spark, sf_dir).withColumn("state", F.when(F.col("trades") > 1, "TRADED").otherwise("NO_TRADE"))
    checked = prices.check_ohlc(b, "state")
    return checked.select("state", F.explode("issue_codes").alias("code")).groupBy("state", "code").agg(
        F.count("*").alias("rows")
    )


def research_bar_contract(spark, sf_dir):
    b = views.bars(spark, sf_dir).withColumns({
        "source_id": F.lit("vendor"), "currency": F.lit("KWD"), "unit": F.lit("fils"),
        "price_basis": F.when(F.col("trades") > 1, "ADJUSTED").otherwise("RAW"),
        "corporate_action_status": F.when(F.col("volume") > 40, "raw_unadjusted").otherwise("officially_adjusted"),
    })
    checked = prices.check_research_bar(b)
    return checked.select("price_basis", F.explode("issue_codes").alias("code")).groupBy("price_basis", "code").agg(
        F.count("*").alias("rows")
    )


def latest_finding(spark, sf_dir):
    f = prices.latest_price_finding(_stated_changes(spark, sf_dir))
    return f.select(
        "code", _day(), F.round("change", 4).alias("change"), "direction",
        F.round("strength", 4).alias("strength"), F.round("materiality", 4).alias("materiality"),
    )


def coverage(spark, sf_dir):
    sessions = views.calendar(spark, sf_dir).where("is_trading_day").select("trade_date")
    return prices.series_coverage(views.bars(spark, sf_dir), sessions, "code").select(
        "code", "row_count", _day("date_start"), _day("date_end"), "missing_sessions", "extra_sessions"
    )


def gaps(spark, sf_dir):
    sessions = views.calendar(spark, sf_dir).where("is_trading_day").select("trade_date")
    dates = prices.number_sessions(sessions)
    runs = prices.session_gaps(views.bars(spark, sf_dir), sessions, "code").groupBy("code").agg(
        F.sum("sessions").alias("missing"), F.min("first_session").alias("_first"), F.max("last_session").alias("_last"))

    def day(number, name):
        return dates.select(F.col("session_number").alias(number), F.col("trade_date").cast("string").alias(name))

    return runs.join(day("_first", "first_gap"), "_first").join(day("_last", "last_gap"), "_last").select("code", "missing", "first_gap", "last_gap")


def yearly_fundamentals(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    period = o.groupBy(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("revenue"),
        F.sum(F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))).alias("net_income"),
        F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0.0)).alias("operating_cash_flow"),
        F.sum(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(0.0)).alias("total_debt"),
        (F.max("o_totalprice") - 100000.0).alias("equity"),
    )
    prior = period.withColumn("year", F.col("year") + 1)
    q = prices.fundamentals_quality(period, prior, "code", "year")
    return q.select(
        "code", "year", "direction",
        *[F.round(c, 6).alias(c) for c in ("quality_vote_share", "revenue_growth", "net_income_growth", "debt_to_equity", "strength")],
    )


def fills(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    sessions = views.bars(spark, sf_dir).select(
        F.col("code").alias("l_suppkey"), F.col("trade_date"), (F.col("volume") * 5).cast("bigint").alias("session_volume"),
        "low", "high", "trades",
    )
    o = li.withColumn("trade_date", F.to_date("l_shipdate")).join(sessions, ["l_suppkey", "trade_date"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
        F.col("l_linenumber").cast("bigint").alias("quantity"), "session_volume",
        F.col("low").alias("bid"), F.when(F.col("l_tax") < 0.08, F.col("high")).alias("ask"),
        F.when(F.col("trades") > 3, "HALTED").otherwise("TRADED").alias("trading_status"),
        (F.col("l_discount") > 0.09).alias("upper_limit_queue"), (F.col("l_discount") < 0.01).alias("lower_limit_queue"),
    )
    f = prices.fill_estimate(o)
    return f.groupBy("side", "fill_status", F.concat_ws("|", "reason_codes").alias("reasons")).agg(
        F.count("*").alias("orders"), F.sum("filled_quantity").alias("filled"), F.sum("unfilled_quantity").alias("unfilled"),
        F.round(F.sum("gross_notional"), 2).alias("notional"), F.round(F.sum("estimated_cost"), 3).alias("cost"),
        F.round(F.avg("participation_rate"), 6).alias("participation"),
    )


def quotes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    delay = F.col("value")
    q = e.select(
        "event_id", F.col("ts").alias("provider_as_of"),
        F.timestamp_micros(F.unix_micros("ts") + F.floor(delay * 600000)).alias("observed_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.floor(delay * 1000000)).alias("decision_at"),
        F.when(F.col("event_type") == "error", "PUBLIC").otherwise("LICENSED_VENDOR").alias("feed_access"),
        F.when(F.col("event_type") != "signup", F.lit("E1")).alias("entitlement_id"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("raw_sha256"),
        F.lit(1.0).alias("delay_minutes"),
        F.when(F.col("event_type") == "view", "CLOSED").otherwise("CONTINUOUS").alias("market_phase"),
        F.when(F.col("event_type") == "click", "HALTED").otherwise("TRADED").alias("trading_status"),
        F.lit(100.0).alias("reference_price"), (F.lit(92.0) + delay / 20).alias("bid"), (F.lit(95.0) + delay / 25).alias("ask"),
    )
    r = prices.executability(q)
    return r.select("event_id", "status", F.round("age_minutes", 4).alias("age_minutes"),
                    F.concat_ws("|", "reason_codes").alias("reasons"))


def previous_close(spark, sf_dir):
    actions = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("action_id"),
        F.pmod("o_custkey", F.lit(table(spark, sf_dir, "supplier").count())).alias("code"),
        F.to_date("o_orderdate").alias("ex_date"),
    )
    r = prices.previous_session_close(actions, views.bars(spark, sf_dir))
    return r.select("action_id", "code", _day("reference_date"), "reference_close")


def terms(spark, sf_dir):
    """Corporate-action terms spelled from the columns of each line item."""
    li = table(spark, sf_dir, "lineitem")
    types = F.array(*[F.lit(t) for t in ("CASH_DIVIDEND_NORMAL", "CASH_DIVIDEND_SPECIAL", "BONUS_SHARES", "STOCK_SPLIT",
                                         "REVERSE_SPLIT", "RIGHTS_ISSUE", "MERGER")])
    dec = lambda c: c.cast("decimal(20,6)")
    official = F.col("l_returnflag") != "N"
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("action_id"),
        F.element_at(types, F.col("l_linenumber")).alias("action_type"),
        F.when(F.col("l_returnflag") == "A", "OFFICIAL_FACTOR").when(F.col("l_returnflag") == "R", "OFFICIAL_REFERENCE_PRICE")
        .when(F.col("l_linenumber") == 7, "NO_AUTOMATIC_FORMULA").otherwise("REPRODUCIBLE_MECHANICAL").alias("formula_mode"),
        dec(F.col("l_quantity") * 10 + 50).alias("previous_close"),
        dec(F.when(F.col("l_linenumber") < 3, F.col("l_partkey"))).alias("cash_per_share"),
        dec(F.when(F.col("l_linenumber").isin(3, 4, 5), F.col("l_quantity") / 8)).alias("new_shares_per_old_share"),
        dec(F.when(F.col("l_linenumber") == 6, F.col("l_quantity") / 4)).alias("rights_new_shares_per_old_share"),
        dec(F.when(F.col("l_linenumber") == 6, F.lit(60))).alias("subscription_price"),
        dec(F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 9 + 40)).alias("official_reference_price"),
        dec(F.when(F.col("l_returnflag") == "A", F.col("l_quantity") / 64)).alias("official_factor"),
        dec(F.when(official & (F.col("l_linestatus") == "O"), F.lit(2))).alias("official_position_quantity_multiplier"),
        F.when(F.col("l_linestatus") == "O", "NOT_APPLICABLE").otherwise("ROUND_DOWN").alias("fractional_entitlement_policy"),
    )


def adjustments(spark, sf_dir):
    a = ca.calculate_adjustments(terms(spark, sf_dir))
    return a.select(
        "action_id", F.concat_ws("|", "issue_codes").alias("issues"), "factor_status",
        *[F.round(F.col(c).cast("double"), 8).alias(c) for c in (
            "theoretical_ex_price", "reference_price_factor", "position_quantity_multiplier", "return_price_multiplier",
            "cash_distribution", "rights_cash_contribution")],
        "return_engine_treatment", "return_engine_ready", "reference_price_use",
    )


def _factor_ledger(spark, sf_dir):
    """Terms of every line item against the supplier's last close before its order date."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ex_date"))
    t = terms(spark, sf_dir)
    keyed = t.withColumn("o_orderkey", F.split("action_id", "-")[0].cast("bigint")).withColumn(
        "code", F.split("action_id", "-")[3].cast("bigint"))
    # Read for its days, its prices and the ledger: written once.
    schedule = materialise(keyed.join(orders, "o_orderkey").select("action_id", "code", "ex_date"))
    reference = prices.previous_session_close(schedule, views.bars(spark, sf_dir)).select(
        "action_id", "reference_date", F.col("reference_close").cast("decimal(20,6)").alias("reference_close"))
    disclosure = t.withColumns({
        "review_status": F.when(F.col("formula_mode") == "OFFICIAL_FACTOR", "ACCEPTED").otherwise("PENDING"),
        "evidence_text": F.concat_ws("  ", F.lit("Notice of"), "action_type", F.lit("TERMS")),
        "evidence_excerpt": F.concat_ws(" ", "action_type", F.lit("terms")),
    })
    return ca.build_factor_ledger(schedule, disclosure, reference)[0]


def factor_ledger_status(spark, sf_dir):
    return ca.ledger_status(_factor_ledger(spark, sf_dir))


def factor_ledger(spark, sf_dir):
    ledger = _factor_ledger(spark, sf_dir)
    return ledger.select(F.explode_outer("ledger_codes").alias("code"), "return_engine_ready").groupBy(
        "code", "return_engine_ready").agg(F.count("*").alias("actions"))


def index_contract(spark, sf_dir):
    """Order priorities as benchmark series of daily totals, written as text."""
    raw = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("benchmark_code"), F.to_date("o_orderdate").alias("trade_date")
    ).agg(F.concat(F.when(F.count("*") > 2, "").otherwise("+"), F.count("*").cast("string")).alias("benchmark_value"))
    registry = spark.createDataFrame(
        [(c, "BROAD_MARKET") for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")], "benchmark_code string, market_scope string")
    checked = prices.normalise_benchmark(raw, registry)
    return checked.groupBy("benchmark_code", F.concat_ws("|", "issue_codes").alias("issues")).agg(
        F.count("*").alias("rows"), F.sum("value").cast("double").alias("total"))


QUERIES = {
    "bars_daily": daily_bars,
    "bars_returns": returns,
    "bars_liquidity_metrics": liquidity,
    "bars_window_signals": window_signals,
    "bars_change_mismatch": change_mismatch,
    "bars_ohlc_contract": ohlc_contract,
    "bars_research_contract": research_bar_contract,
    "bars_latest_finding": latest_finding,
    "bars_series_coverage": coverage,
    "bars_session_gaps": gaps,
    "fundamentals_quality": yearly_fundamentals,
    "orders_fill_estimate": fills,
    "quotes_executability": quotes,
    "actions_previous_close": previous_close,
    "actions_adjustments": adjustments,
    "actions_factor_ledger": factor_ledger, "actions_ledger_status": factor_ledger_status,
    "benchmark_normalised": index_contract,
}

RET = """, r AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY trade_date) - 1 AS ret FROM bars)"""
STATED = """, st AS (SELECT *, round((close / open - 1) * 100, 6) AS chg,
    close / lag(close) OVER (PARTITION BY code ORDER BY trade_date) - 1 AS ret FROM bars)"""
TERMS = """
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS action_id, l_linenumber AS ln,
      ['CASH_DIVIDEND_NORMAL','CASH_DIVIDEND_SPECIAL','BONUS_SHARES','STOCK_SPLIT','REVERSE_SPLIT','RIGHTS_ISSUE','MERGER'][l_linenumber] AS action,
      CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'R' THEN 'R' ELSE CASE WHEN l_linenumber = 7 THEN 'P' ELSE 'M' END END AS mode,
      l_quantity * 10 + 50 AS close, CASE WHEN l_linenumber < 3 THEN l_partkey END AS cash,
      CASE WHEN l_linenumber IN (3,4,5) THEN l_quantity / 8 END AS fresh, CASE WHEN l_linenumber = 6 THEN l_quantity / 4 END AS ratio,
      CASE WHEN l_linenumber = 6 THEN 60 END AS sub, CASE WHEN l_returnflag = 'R' THEN l_quantity * 9 + 40 END AS ref,
      CASE WHEN l_returnflag = 'A' THEN l_quantity / 64 END AS fac,
      CASE WHEN l_returnflag <> 'N' AND l_linestatus = 'O' THEN 2 END AS mult, l_linestatus = 'O' AS exact,
      l_orderkey, l_suppkey FROM lineitem"""
JUDGED = f"""
    SELECT *, concat_ws('|', CASE WHEN cash <= 0 AND FALSE THEN '' END,
        CASE WHEN mode = 'M' AND ln < 3 AND NOT coalesce(cash > 0 AND cash < close, FALSE) THEN 'CASH_NOT_BELOW_CLOSE' END,
        CASE WHEN mode = 'M' AND ln = 4 AND fresh <= 1 THEN 'STOCK_SPLIT_NOT_ABOVE_ONE' END,
        CASE WHEN mode = 'M' AND ln = 5 AND fresh >= 1 THEN 'REVERSE_SPLIT_NOT_BELOW_ONE' END) AS issues,
        CASE WHEN mode IN ('F','R') AND ln < 3 THEN TRUE WHEN mode IN ('F','R') AND ln IN (3,4,5) THEN mult IS NOT NULL
             WHEN mode = 'M' AND ln < 3 THEN TRUE WHEN mode = 'M' AND ln IN (3,4,5) THEN exact ELSE FALSE END AS ready
    FROM ({TERMS})"""
ORACLE = {
    "bars_daily": with_views(["bars"], """
        SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, open, high, low, close, volume,
               round(turnover, 2) AS turnover, trades
        FROM bars"""),
    "bars_returns": with_views(["bars"], RET + """
        SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, round(ret, 6) AS daily_return FROM r"""),
    "bars_liquidity_metrics": with_views(["bars"], RET + """
        SELECT code, count(*) AS sessions, count(*) FILTER (volume > 0) AS traded_sessions,
               count(*) FILTER (volume IS NULL) AS missing_volume_sessions, count(*) FILTER (volume = 0) AS zero_volume_sessions,
               count(*) FILTER (abs(ret) < 1e-15) AS zero_return_sessions,
               round(count(*) FILTER (volume IS NULL OR volume = 0) / count(*), 6) AS nontrading_ratio,
               round(median(volume) FILTER (volume > 0), 4) AS median_volume,
               round(median(turnover) FILTER (turnover > 0), 4) AS median_turnover,
               round(avg(abs(ret) / turnover) FILTER (turnover > 0 AND volume > 0) * 1e6, 6) AS amihud_per_million
        FROM r GROUP BY 1"""),
    "bars_window_signals": with_views(["bars"], RET + """
        , l AS (SELECT *, trade_date = max(trade_date) OVER (PARTITION BY code) AS is_last FROM r),
        s AS (SELECT code, count(*) AS n, arg_min(close, trade_date) AS c0, arg_max(close, trade_date) AS c1, max(close) AS cm,
                     stddev_pop(ret) AS vol, arg_max(ret, trade_date) AS lr, arg_max(volume, trade_date) AS lv,
                     median(volume) FILTER (NOT is_last AND volume > 0) AS mv,
                     count(*) FILTER (volume IS NULL OR volume = 0) AS nt FROM l GROUP BY 1),
        x AS (SELECT *, c1 / c0 - 1 AS tr, lv / mv AS vr, nt / n AS ntr FROM s)
        SELECT code, signal_kind, n, direction, round(vol, 6) AS volatility, round(c1 / cm - 1, 6) AS drawdown,
               round(strength, 6) AS strength, round(materiality, 6) AS materiality, round(value, 6) AS value FROM (
          SELECT *, 'TECHNICAL' AS signal_kind,
                 CASE WHEN tr > 0.005 THEN 'POSITIVE' WHEN tr < -0.005 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS direction,
                 least(1.0, abs(tr) / 0.10) AS strength, least(1.0, 0.4 + n / 100.0) AS materiality, tr AS value FROM x WHERE n >= 5
          UNION ALL
          SELECT *, 'PRICE_ACTIVITY', CASE WHEN lr > 0.002 THEN 'POSITIVE' WHEN lr < -0.002 THEN 'NEGATIVE' ELSE 'NEUTRAL' END,
                 CASE WHEN vr IS NULL THEN least(1.0, abs(lr) / 0.05)
                      ELSE least(1.0, least(1.0, abs(lr) / 0.05) * least(2.0, greatest(0.5, vr))) END,
                 CASE WHEN vr IS NULL THEN 0.35 ELSE 0.6 END, vr FROM x WHERE n >= 5
          UNION ALL
          SELECT *, 'LIQUIDITY', CASE WHEN ntr >= 0.2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END, least(1.0, ntr / 0.5), 0.8, ntr
          FROM x WHERE n >= 5
          UNION ALL SELECT *, 'INSUFFICIENT_BARS', 'NEUTRAL', NULL, NULL, NULL FROM x WHERE n < 5)"""),
    "bars_change_mismatch": with_views(["bars"], STATED + """
        SELECT code, count(*) AS mismatches, CAST(max(trade_date) AS VARCHAR) AS last_mismatch FROM st
        WHERE abs(ret * 100 - chg) > 0.06 GROUP BY 1"""),
    "bars_ohlc_contract": with_views(["bars"], """
        SELECT 'NO_TRADE' AS state, u.code, count(*) AS rows FROM bars b,
          LATERAL (SELECT unnest(['NON_TRADED_HAS_OHLC', 'NON_TRADED_HAS_ACTIVITY']) AS code) u WHERE trades <= 1 GROUP BY 1, 2"""),
    "bars_research_contract": with_views(["bars"], """
        SELECT CASE WHEN trades > 1 THEN 'ADJUSTED' ELSE 'RAW' END AS price_basis,
               CASE WHEN trades > 1 THEN NULL ELSE 'RAW_NOT_RAW_UNADJUSTED' END AS code, count(*) AS rows
        FROM bars WHERE trades <= 1 AND volume <= 40 GROUP BY 1, 2
        UNION ALL SELECT 'ADJUSTED', 'ADJUSTED_WITHOUT_METHOD', count(*) FROM bars WHERE trades > 1 AND volume > 40"""),
    "bars_latest_finding": with_views(["bars"], STATED + """
        SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, round(c, 4) AS change,
               CASE WHEN c > 0.05 THEN 'POSITIVE' WHEN c < -0.05 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS direction,
               round(least(abs(c) / 5.0, 1.0), 4) AS strength, round(least(abs(c) / 3.0, 1.0), 4) AS materiality
        FROM (SELECT code, max(trade_date) AS trade_date, arg_max(chg, trade_date) AS c FROM st GROUP BY 1)"""),
    "bars_series_coverage": with_views(["bars", "cal"], """
        SELECT code, count(*) AS row_count, CAST(min(b.trade_date) AS VARCHAR) AS date_start, CAST(max(b.trade_date) AS VARCHAR) AS date_end,
               (SELECT count(*) FROM cal WHERE is_trading_day) - count(DISTINCT c.trade_date) AS missing_sessions,
               count(*) FILTER (c.trade_date IS NULL) AS extra_sessions
        FROM bars b LEFT JOIN (SELECT trade_date FROM cal WHERE is_trading_day) c ON c.trade_date = b.trade_date GROUP BY 1"""),
    "bars_session_gaps": with_views(["bars", "cal"], """
        SELECT k.code, count(*) AS missing, CAST(min(c.trade_date) AS VARCHAR) AS first_gap, CAST(max(c.trade_date) AS VARCHAR) AS last_gap
        FROM (SELECT DISTINCT code FROM bars) k CROSS JOIN (SELECT trade_date FROM cal WHERE is_trading_day) c
        WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.code = k.code AND b.trade_date = c.trade_date) GROUP BY 1"""),
    "fundamentals_quality": """
        WITH p AS (SELECT o_custkey AS code, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS rev,
                     sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END) AS ni,
                     sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS cf,
                     sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END) AS debt, max(o_totalprice) - 100000 AS eq
                   FROM orders GROUP BY 1, 2),
        j AS (SELECT c.*, CASE WHEN abs(q.rev) >= 1e-12 THEN c.rev / abs(q.rev) - CASE WHEN q.rev > 0 THEN 1 ELSE -1 END END AS rg,
                     CASE WHEN abs(q.ni) >= 1e-12 THEN c.ni / abs(q.ni) - CASE WHEN q.ni > 0 THEN 1 ELSE -1 END END AS ig,
                     CASE WHEN c.eq > 0 THEN c.debt / c.eq END AS de
              FROM p c JOIN p q ON q.code = c.code AND q.year + 1 = c.year),
        v AS (SELECT *, CAST(ni > 0 AS INT) + CAST(cf > 0 AS INT) + CAST(cf >= ni AS INT) + CAST(coalesce(rg > 0, FALSE) AS INT)
                     + CAST(coalesce(ig > 0, FALSE) AS INT) + CAST(coalesce(de <= 1.5, FALSE) AS INT) AS t FROM j)
        SELECT code, year, CASE WHEN t >= 4 THEN 'POSITIVE' WHEN t <= 2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS direction,
               round(t / 6.0, 6) AS quality_vote_share, round(rg, 6) AS revenue_growth, round(ig, 6) AS net_income_growth,
               round(de, 6) AS debt_to_equity, round(abs(t / 6.0 - 0.5) * 2, 6) AS strength FROM v""",
    "orders_fill_estimate": with_views(["bars"], """
        , o AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side, l_linenumber AS quantity,
                  CAST(volume * 5 AS BIGINT) AS sv, low AS bid, CASE WHEN l_tax < 0.08 THEN high END AS ask, trades > 3 AS halted,
                  l_discount > 0.09 AS up, l_discount < 0.01 AS down
                FROM lineitem JOIN bars ON code = l_suppkey AND trade_date = CAST(l_shipdate AS DATE)),
        b AS (SELECT *, concat_ws('|', CASE WHEN halted THEN 'TRADING_NOT_AVAILABLE' END,
                    CASE WHEN side = 'BUY' AND up THEN 'UPPER_LIMIT_QUEUE_NO_FILL_ASSUMPTION' END,
                    CASE WHEN side = 'SELL' AND down THEN 'LOWER_LIMIT_QUEUE_NO_FILL_ASSUMPTION' END,
                    CASE WHEN sv = 0 THEN 'ZERO_SESSION_VOLUME' END,
                    CASE WHEN CASE WHEN side = 'BUY' THEN ask ELSE bid END IS NULL THEN 'SIDE_QUOTE_MISSING' END) AS blocked FROM o),
        f AS (SELECT *, CASE WHEN blocked = '' THEN least(quantity, CAST(floor(sv * 0.05::DOUBLE) AS BIGINT)) ELSE 0 END AS filled FROM b),
        g AS (SELECT *, CASE WHEN filled > 0 THEN filled / sv END AS rate, least(1.0, filled / sv / 0.05) AS cap FROM f),
        h AS (SELECT *, CASE WHEN filled > 0 THEN CASE WHEN side = 'BUY' THEN ask ELSE bid END
                          * (1 + 0.005 * cap * CASE WHEN side = 'BUY' THEN 1 ELSE -1 END) * filled / 1000 ELSE 0 END AS notional FROM g)
        SELECT side, CASE WHEN filled <= 0 THEN 'NO_FILL' WHEN filled = quantity THEN 'FILLED' ELSE 'PARTIAL_FILL' END AS fill_status,
               CASE WHEN blocked <> '' THEN blocked WHEN filled <= 0 THEN 'PARTICIPATION_CAP_ROUNDS_TO_ZERO'
                    WHEN filled < quantity THEN 'ORDER_EXCEEDS_PARTICIPATION_CAP' ELSE '' END AS reasons,
               count(*) AS orders, CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(quantity - filled) AS BIGINT) AS unfilled,
               round(sum(notional), 2) AS notional, round(sum(CASE WHEN filled > 0 THEN notional * (0.001 + 0.005 * cap) ELSE 0 END), 3) AS cost,
               round(avg(CASE WHEN blocked <> '' THEN NULL WHEN filled <= 0 THEN 0.0 ELSE rate END), 6) AS participation
        FROM h GROUP BY 1, 2, 3"""),
    "quotes_executability": """
        WITH q AS (SELECT *, epoch_us(ts) AS p, floor(value * 600000) AS d1, floor(value * 1000000) AS d2,
                     92.0 + value / 20 AS bid, 95.0 + value / 25 AS ask FROM events)
        SELECT event_id, CASE WHEN r = '' THEN 'EXECUTABLE' ELSE 'DETECTED_NOT_EXECUTABLE' END AS status,
               round(d2 / 60e6, 4) AS age_minutes, r AS reasons FROM (
          SELECT *, concat_ws('|', CASE WHEN event_type = 'error' THEN 'EXECUTION_FEED_NOT_AUTHORIZED' END,
             CASE WHEN event_type = 'signup' THEN 'MISSING_FEED_ENTITLEMENT_ID' END,
             CASE WHEN abs(1.0 - d1 / 60e6) > 1 THEN 'DELAY_DECLARATION_MISMATCH' END,
             CASE WHEN d2 / 60e6 > 2 THEN 'STALE_OR_FUTURE_EXECUTION_SNAPSHOT' END,
             CASE WHEN event_type = 'view' THEN 'NON_EXECUTABLE_MARKET_PHASE' END,
             CASE WHEN event_type = 'click' THEN 'TRADING_STATUS_HALTED' END,
             CASE WHEN ask < bid THEN 'CROSSED_QUOTE' END,
             CASE WHEN ask / 100.0 >= 1.10::DOUBLE - 1e-12 THEN 'UPPER_LIMIT_QUEUE_OR_CENSORING' END,
             CASE WHEN bid / 100.0 <= 0.95::DOUBLE + 1e-12 THEN 'LOWER_LIMIT_STATE' END) AS r FROM q)""",
    "actions_previous_close": with_views(["bars"], """
        , a AS (SELECT o_orderkey AS action_id, o_custkey % (SELECT count(*) FROM supplier) AS code, CAST(o_orderdate AS DATE) - 1 AS d FROM orders)
        SELECT action_id, a.code, CAST(b.trade_date AS VARCHAR) AS reference_date, b.close AS reference_close
        FROM a ASOF LEFT JOIN bars b ON a.code = b.code AND a.d >= b.trade_date"""),
    "actions_adjustments": f"""
        SELECT action_id, issues, CASE WHEN issues = '' THEN CASE mode WHEN 'P' THEN 'pending' WHEN 'M' THEN 'reproducible' ELSE 'official' END END AS factor_status,
          CASE WHEN issues = '' THEN round(CASE mode WHEN 'F' THEN close * fac WHEN 'R' THEN ref WHEN 'M' THEN
            CASE WHEN ln < 3 THEN close - cash WHEN ln = 3 THEN close / (1 + fresh) WHEN ln IN (4,5) THEN close / fresh
                 WHEN ln = 6 THEN (close + ratio * sub) / (1 + ratio) END END, 8) END AS theoretical_ex_price,
          CASE WHEN issues = '' THEN round(CASE mode WHEN 'F' THEN fac WHEN 'R' THEN ref / close WHEN 'M' THEN
            CASE WHEN ln < 3 THEN (close - cash) / close WHEN ln = 3 THEN 1 / (1 + fresh) WHEN ln IN (4,5) THEN 1 / fresh
                 WHEN ln = 6 THEN (close + ratio * sub) / (1 + ratio) / close END END, 8) END AS reference_price_factor,
          CASE WHEN issues = '' THEN round(CASE WHEN mode IN ('F','R') THEN mult WHEN mode = 'M' THEN
            CASE WHEN ln < 3 THEN 1 WHEN ln = 3 THEN 1 + fresh WHEN ln IN (4,5) THEN fresh WHEN ln = 6 THEN 1 + ratio END END, 8) END AS position_quantity_multiplier,
          CASE WHEN issues = '' THEN round(CASE WHEN ln < 3 THEN 1 WHEN ln IN (3,4,5) AND ready THEN
            CASE WHEN mode IN ('F','R') THEN mult WHEN ln = 3 THEN 1 + fresh ELSE fresh END END, 8) END AS return_price_multiplier,
          CASE WHEN issues = '' THEN CAST(cash AS DOUBLE) END AS cash_distribution,
          CASE WHEN issues = '' AND mode = 'M' AND ln = 6 THEN round(ratio * sub, 8) END AS rights_cash_contribution,
          CASE WHEN issues = '' THEN CASE WHEN mode = 'P' THEN 'BLOCKED_PENDING_OFFICIAL_TERMS' WHEN ln < 3 THEN 'RAW_PRICE_PLUS_CASH_COMPONENT'
            WHEN ln IN (3,4,5) AND ready THEN 'RAW_PRICE_TIMES_QUANTITY_MULTIPLIER'
            WHEN mode = 'R' AND ln IN (3,4,5) THEN 'BLOCKED_MISSING_QUANTITY_MULTIPLIER'
            WHEN mode = 'M' AND ln IN (3,4,5) THEN 'BLOCKED_FRACTIONAL_ENTITLEMENT_POLICY'
            WHEN mode = 'M' AND ln = 6 THEN 'BLOCKED_RIGHTS_EXERCISE_OR_SALE_POLICY'
            ELSE 'BLOCKED_ACTION_SPECIFIC_RETURN_POLICY' END END AS return_engine_treatment,
          issues = '' AND ready AS return_engine_ready,
          CASE WHEN issues = '' THEN CASE WHEN mode = 'P' THEN 'UNRESOLVED' WHEN ln = 1 THEN 'DISPLAY_AND_TOTAL_RETURN_INDEX_ONLY'
            WHEN ln = 2 THEN 'TRADING_REFERENCE_AND_INDEX' ELSE 'CORPORATE_ACTION_REFERENCE' END END AS reference_price_use
        FROM ({JUDGED})""",
    "actions_ledger_status": with_views(["bars"], f"""
        , a AS (SELECT j.*, CAST(o_orderdate AS DATE) - 1 AS d FROM ({JUDGED}) j JOIN orders ON o_orderkey = l_orderkey),
        m AS (SELECT a.*, b.trade_date AS rd, CAST(b.close AS DECIMAL(20,6)) AS rc FROM a ASOF LEFT JOIN bars b ON a.l_suppkey = b.code AND a.d >= b.trade_date),
        c AS (SELECT list_filter([CASE WHEN mode <> 'F' THEN 'DISCLOSURE_NOT_ACCEPTED' END,
                 CASE WHEN mode IN ('R','M') AND rd IS NULL THEN 'PRICE_REFERENCE_MISSING' END,
                 CASE WHEN mode IN ('R','M') AND rc <> CAST(close AS DECIMAL(20,6)) THEN 'PRICE_REFERENCE_DIFFERS' END,
                 CASE WHEN issues <> '' THEN issues END], lambda x: x IS NOT NULL) AS codes, issues = '' AND ready AS ready FROM m)
        SELECT count(*) AS actions, count(*) FILTER (WHERE len(codes) > 0) AS blocked, count(*) FILTER (WHERE len(codes) = 0 AND ready) AS ready,
          CASE WHEN count(*) FILTER (WHERE len(codes) > 0) > 0 THEN 'BLOCKED' WHEN count(*) FILTER (WHERE len(codes) = 0 AND ready) < count(*) THEN 'PARTIAL' ELSE 'PASS' END AS status
        FROM c"""),
    "actions_factor_ledger": with_views(["bars"], f"""
        , a AS (SELECT j.*, CAST(o_orderdate AS DATE) - 1 AS d FROM ({JUDGED}) j JOIN orders ON o_orderkey = l_orderkey),
        m AS (SELECT a.*, b.trade_date AS rd, CAST(b.close AS DECIMAL(20,6)) AS rc FROM a ASOF LEFT JOIN bars b ON a.l_suppkey = b.code AND a.d >= b.trade_date),
        c AS (SELECT list_filter([CASE WHEN mode <> 'F' THEN 'DISCLOSURE_NOT_ACCEPTED' END,
                 CASE WHEN mode IN ('R','M') AND rd IS NULL THEN 'PRICE_REFERENCE_MISSING' END,
                 CASE WHEN mode IN ('R','M') AND rc <> CAST(close AS DECIMAL(20,6)) THEN 'PRICE_REFERENCE_DIFFERS' END,
                 CASE WHEN issues <> '' THEN issues END], lambda x: x IS NOT NULL) AS codes, issues = '' AND ready AS ready FROM m)
        SELECT code, ready AS return_engine_ready, count(*) AS actions FROM (
          SELECT unnest(CASE WHEN len(codes) = 0 THEN [NULL] ELSE codes END) AS code, ready FROM c) GROUP BY 1, 2"""),
    "benchmark_normalised": """
        WITH r AS (SELECT o_orderpriority AS benchmark_code, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1, 2)
        SELECT benchmark_code, concat_ws('|', CASE WHEN benchmark_code = '4-NOT SPECIFIED' THEN 'BENCHMARK_NOT_REGISTERED' END,
                 CASE WHEN n <= 2 THEN 'BENCHMARK_VALUE_NOT_CANONICAL' END) AS issues, count(*) AS rows, CAST(sum(n) AS DOUBLE) AS total
        FROM r GROUP BY 1, 2""",
}
