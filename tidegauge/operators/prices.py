"""Daily bars: contracts, returns, liquidity, price-window and order-book signals.

A bar table has one row per (code, trade_date); ``duplicate_bars`` proves it.
With that, every window over a code is bounded by the trading calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.operators.pit import interval_join

# Fixed values.
ZERO_RETURN = 1e-15
CHANGE_TOLERANCE = 0.06
TRADED_STATES = ("TRADED", "TRADED_THEN_SUSPENDED")
EOD_STATES = TRADED_STATES + ("NO_TRADE", "SUSPENDED", "HALTED", "NOT_LISTED_OR_NOT_ELIGIBLE")
CA_STATES = ("officially_adjusted", "raw_unadjusted", "not_applicable", "unknown")
EXECUTABLE_PHASES = ("OPENING_AUCTION", "CONTINUOUS", "CLOSING_AUCTION", "TRADE_AT_LAST")
ANALYST_MINIMUM_BARS = 5


def _by_code() -> Window:
    return Window.partitionBy("code").orderBy("trade_date")


def duplicate_bars(bars: DataFrame) -> DataFrame:
    """(code, trade_date) keys that occur more than once."""
    return bars.groupBy("code", "trade_date").agg(F.count("*").alias("rows")).where("rows > 1")


def check_ohlc(bars: DataFrame, state: str | None = None) -> DataFrame:
    """OHLC sanity; untraded states must carry no prices and no activity."""
    traded = R.in_set(state, TRADED_STATES) if state else F.lit(True)
    prices = ("open", "high", "low", "close")
    all_positive = F.lit(True)
    none_present = F.lit(True)
    for p in prices:
        all_positive = all_positive & R.finite(p, 0.001)
        none_present = none_present & F.col(p).isNull()
    activity = [c for c in ("volume", "turnover", "trades") if c in bars.columns]
    moved, idle = F.lit(True), F.lit(True)
    for c in activity:
        moved = moved & R.finite(c) & (F.col(c) > 0)
        idle = idle & (F.coalesce(F.col(c), F.lit(0)) == 0)
    rules = [
        R.must("OHLC_NOT_POSITIVE", ~traded | all_positive),
        R.never("OHLC_HIGH_CONSTRAINT", traded & (F.col("high") < F.greatest("open", "close", "low"))),
        R.never("OHLC_LOW_CONSTRAINT", traded & (F.col("low") > F.least("open", "close", "high"))),
        R.must("TRADED_REQUIRES_ACTIVITY", ~traded | moved),
    ]
    if state:
        rules += [
            R.must("TRADING_STATE_UNKNOWN", R.in_set(state, EOD_STATES)),
            R.must("NON_TRADED_HAS_OHLC", traded | none_present),
            R.must("NON_TRADED_HAS_ACTIVITY", traded | idle),
        ]
    return R.check(bars, *rules)


def check_research_bar(bars: DataFrame) -> DataFrame:
    """Vendor bar contract: identifiers, capture, basis and adjustment status agree."""
    basis, ca = F.upper("price_basis"), F.col("corporate_action_status")
    checked = check_ohlc(bars.drop("trades")).withColumnRenamed("issue_codes", "_ohlc")
    rules = R.code_array(
        R.must("SECURITY_CODE_FORM", F.col("code").cast("string").rlike(r"^[0-9]{1,12}$")),
        R.must("SOURCE_ID_INVALID", R.present("source_id")),
        R.must("PRICE_BASIS_UNKNOWN", basis.isin("RAW", "ADJUSTED")),
        R.must("CURRENCY_NOT_KWD", F.upper("currency") == "KWD"),
        R.must("UNIT_UNKNOWN", F.col("unit").isin("fils", "KWD")),
        R.must("CORPORATE_ACTION_STATUS_INVALID",
               ca.isin("raw_unadjusted", "provider_adjusted_method_unverified", "officially_adjusted")),
        R.never("RAW_NOT_RAW_UNADJUSTED", (basis == "RAW") & (ca != "raw_unadjusted")),
        R.never("ADJUSTED_WITHOUT_METHOD", (basis == "ADJUSTED")
                & ~ca.isin("provider_adjusted_method_unverified", "officially_adjusted")),
    )
    return checked.withColumn("issue_codes", F.concat("_ohlc", rules)).drop("_ohlc")


def daily_returns(bars: DataFrame) -> DataFrame:
    """Close-to-close return per code; the first bar has none."""
    prev = F.lag("close").over(_by_code())
    return bars.withColumn("prev_close", prev).withColumn("daily_return", F.try_divide(F.col("close"), prev) - 1.0)


def change_mismatches(bars: DataFrame, change: str = "change_percent", tolerance: float = CHANGE_TOLERANCE) -> DataFrame:
    """Bars whose stated change differs from the recomputed one beyond the tolerance."""
    expected = F.col("daily_return") * 100.0
    return daily_returns(bars).where(
        F.col("prev_close").isNotNull() & (F.abs(expected - F.col(change)) > tolerance)
    ).withColumn("expected_change", expected)


def increasing_dates(series: DataFrame, key: str, day: str, seq: str) -> DataFrame:
    """Rows whose date does not follow the previous row of the same series in input order.

    Run it after the duplicate-key check: with unique dates a series is no longer
    than the calendar.
    """
    order = Window.partitionBy(key).orderBy(seq)
    return series.withColumn("previous_date", F.lag(day).over(order)).where(F.col(day) <= F.col("previous_date"))


def liquidity_metrics(bars: DataFrame) -> DataFrame:
    """Sessions, missing and zero volume, zero returns, medians and Amihud per code."""
    returns = daily_returns(bars)
    volume, turnover, ret = F.col("volume"), F.col("turnover"), F.abs("daily_return")
    missing, zero = F.count_if(volume.isNull()), F.count_if(volume == 0)
    return returns.groupBy("code").agg(
        F.count("*").alias("sessions"),
        F.count_if(volume > 0).alias("traded_sessions"),
        missing.alias("missing_volume_sessions"),
        zero.alias("zero_volume_sessions"),
        F.count_if(ret < ZERO_RETURN).alias("zero_return_sessions"),
        ((missing + zero) / F.count("*")).alias("nontrading_ratio"),
        F.median(F.when(volume > 0, volume)).alias("median_volume"),
        F.median(F.when(turnover > 0, turnover)).alias("median_turnover"),
        F.avg(F.when((turnover > 0) & (volume > 0), F.try_divide(ret, turnover))).alias("amihud_illiquidity"),
    )


def banded_direction(value: Column, band: float) -> Column:
    return F.when(value > band, "POSITIVE").when(value < -band, "NEGATIVE").otherwise("NEUTRAL")


def scaled_strength(value: Column, full_scale: float) -> Column:
    return F.least(F.lit(1.0), F.abs(value) / full_scale)


def price_window_signals(bars: DataFrame) -> DataFrame:
    """Momentum, activity and liquidity signal per code, three rows each.

    Codes with fewer than five bars get one INSUFFICIENT_BARS row instead.
    """
    last_date = F.max("trade_date").over(Window.partitionBy("code"))
    r = daily_returns(bars).withColumn("is_last", F.col("trade_date") == last_date)
    volume = F.col("volume")
    s = r.groupBy("code").agg(
        F.count("*").alias("n"),
        F.min_by("close", "trade_date").alias("first_close"),
        F.max_by("close", "trade_date").alias("last_close"),
        F.max("close").alias("max_close"),
        F.stddev_pop("daily_return").alias("volatility"),
        F.max_by("daily_return", "trade_date").alias("last_return"),
        F.max_by("volume", "trade_date").alias("last_volume"),
        F.median(F.when(~F.col("is_last") & (volume > 0), volume)).alias("median_prior_volume"),
        (F.count_if(volume.isNull()) + F.count_if(volume == 0)).alias("nontrading"),
    )
    trailing = F.try_divide("last_close", "first_close") - 1.0
    ratio = F.col("last_volume") / F.col("median_prior_volume")
    activity = scaled_strength(F.col("last_return"), 0.05)
    weighted = F.when(
        ratio.isNotNull(), F.least(F.lit(1.0), activity * F.least(F.lit(2.0), F.greatest(F.lit(0.5), ratio)))
    ).otherwise(activity)
    nontrading = F.col("nontrading") / F.col("n")

    def signal(kind, direction, strength, materiality, value):
        return F.struct(
            F.lit(kind).alias("signal_kind"), direction.alias("direction"), strength.alias("strength"),
            materiality.alias("materiality"), value.alias("value"),
        )

    enough = F.array(
        signal("TECHNICAL", banded_direction(trailing, 0.005), scaled_strength(trailing, 0.10),
               F.least(F.lit(1.0), F.lit(0.4) + F.col("n") / 100.0), trailing),
        signal("PRICE_ACTIVITY", banded_direction(F.col("last_return"), 0.002), weighted,
               F.when(ratio.isNotNull(), 0.6).otherwise(0.35), ratio),
        signal("LIQUIDITY", F.when(nontrading >= 0.20, "NEGATIVE").otherwise("NEUTRAL"),
               F.least(F.lit(1.0), nontrading / 0.50), F.lit(0.8), nontrading),
    )
    none = F.array(
        signal("INSUFFICIENT_BARS", F.lit("NEUTRAL"), F.lit(None).cast("double"), F.lit(None).cast("double"),
               F.lit(None).cast("double"))
    )
    return s.select(
        "code", "n", "volatility", (F.try_divide("last_close", "max_close") - 1.0).alias("drawdown"),
        F.explode(F.when(F.col("n") >= ANALYST_MINIMUM_BARS, enough).otherwise(none)).alias("s"),
    ).select("code", "n", "volatility", "drawdown", "s.*")


def growth(current: Column, prior: Column) -> Column:
    return F.when(
        F.abs(prior) >= 1e-12, F.try_divide(current, F.abs(prior)) - F.when(prior > 0, 1.0).otherwise(-1.0)
    )


def fundamentals_quality(current: DataFrame, prior: DataFrame, *key: str) -> DataFrame:
    """Six quality votes of a period against its predecessor."""
    fields = ("revenue", "net_income", "operating_cash_flow", "total_debt", "equity")
    c = current.select(*key, *[F.col(f).alias(f"c_{f}") for f in fields])
    p = prior.select(*key, *[F.col(f).alias(f"p_{f}") for f in fields])
    j = c.join(p, list(key))
    leverage = F.when(F.col("c_equity") > 0, F.try_divide("c_total_debt", "c_equity"))
    revenue_growth = growth(F.col("c_revenue"), F.col("p_revenue"))
    income_growth = growth(F.col("c_net_income"), F.col("p_net_income"))
    votes = [
        F.col("c_net_income") > 0,
        F.col("c_operating_cash_flow") > 0,
        F.col("c_operating_cash_flow") >= F.col("c_net_income"),
        revenue_growth > 0,
        income_growth > 0,
        leverage <= 1.5,
    ]
    total = F.lit(0)
    for v in votes:
        total = total + F.coalesce(v, F.lit(False)).cast("int")
    share = total / F.lit(6.0)
    return j.select(
        *key, share.alias("quality_vote_share"), revenue_growth.alias("revenue_growth"),
        income_growth.alias("net_income_growth"), leverage.alias("debt_to_equity"),
        F.when(total >= 4, "POSITIVE").when(total <= 2, "NEGATIVE").otherwise("NEUTRAL").alias("direction"),
        (F.abs(share - 0.5) * 2).alias("strength"),
    )


def latest_price_finding(bars: DataFrame, change: str = "change_percent") -> DataFrame:
    """Direction, strength and materiality of each code's latest stated change."""
    last = bars.groupBy("code").agg(
        F.max("trade_date").alias("trade_date"), F.max_by(change, "trade_date").alias("change")
    )
    return last.select(
        "code", "trade_date", "change", banded_direction(F.col("change"), 0.05).alias("direction"),
        F.bround(F.least(F.abs("change") / 5.0, F.lit(1.0)), 6).alias("strength"),
        F.bround(F.least(F.abs("change") / 3.0, F.lit(1.0)), 6).alias("materiality"),
    )


def series_coverage(series: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Rows, first and last date, zero volumes, missing and extra sessions per series.

    ``sessions(trade_date)`` is the official calendar; missing sessions are
    counted by set sizes and listed by ``missing_sessions``.
    """
    official = sessions.select("trade_date", F.lit(True).alias("official")).distinct()
    total = official.count()
    return series.join(F.broadcast(official) if total <= 200_000 else official, "trade_date", "left").groupBy(key).agg(
        F.count("*").alias("row_count"),
        F.min("trade_date").alias("date_start"), F.max("trade_date").alias("date_end"),
        (F.lit(total) - F.count_distinct(F.when(F.col("official"), F.col("trade_date")))).alias("missing_sessions"),
        F.count_distinct(F.when(F.col("official").isNull(), F.col("trade_date"))).alias("extra_sessions"),
    )


def session_gaps(series: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Maximal runs of missing sessions per series: ``key, first_session, last_session, sessions``, the ends as session numbers.

    Each series meets its own next session (``lead``), so no series x calendar table is built. The windows hold one row
    per session of the calendar; a series without any official session misses all of them. Repeated dates count once.
    """
    numbered = number_sessions(sessions)
    held = series.select(key, "trade_date").distinct().join(numbered, "trade_date", "left").select(
        key, F.explode(F.array(F.lit(0), F.coalesce("session_number", F.lit(0)))).alias("_at")).distinct()
    total = numbered.agg(F.coalesce(F.max("session_number"), F.lit(0)).alias("_total"))
    following = F.lead("_at").over(Window.partitionBy(key).orderBy("_at"))
    runs = held.withColumn("_next", following).join(F.broadcast(total)).select(  # one row of totals
        key, (F.col("_at") + 1).alias("first_session"), (F.coalesce("_next", F.col("_total") + 1) - 1).alias("last_session"))
    return runs.where("first_session <= last_session").withColumn("sessions", F.expr("last_session - first_session + 1"))


def number_sessions(sessions: DataFrame) -> DataFrame:
    """``(trade_date, session_number)`` of the official sessions, from 1; the calendar bounds the window."""
    return sessions.select("trade_date").where("trade_date IS NOT NULL").distinct().withColumn(
        "session_number", F.row_number().over(Window.orderBy("trade_date")))


def missing_sessions(series: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Every (series, session) that should exist and does not."""
    runs = session_gaps(series, sessions, key).select(key, F.explode(F.sequence("first_session", "last_session")).alias("session_number"))
    return runs.join(number_sessions(sessions), "session_number").select(key, "trade_date")


def fill_estimate(
    orders: DataFrame, max_participation: float = 0.05, fees_bps: float = 10.0, impact_bps: float = 50.0
) -> DataFrame:
    """Liquidity-capped fill of one order against its session, as columns.

    Needs side, quantity, session_volume, bid, ask, trading_status and the two
    limit-queue flags.
    """
    buy = F.col("side") == "BUY"
    quote = F.when(buy, F.col("ask")).otherwise(F.col("bid"))
    blocked = R.code_array(
        R.must("TRADING_NOT_AVAILABLE", F.upper("trading_status") == "TRADED"),
        R.never("UPPER_LIMIT_QUEUE_NO_FILL_ASSUMPTION", buy & F.col("upper_limit_queue")),
        R.never("LOWER_LIMIT_QUEUE_NO_FILL_ASSUMPTION", ~buy & F.col("lower_limit_queue")),
        R.never("SESSION_VOLUME_MISSING", F.col("session_volume").isNull()),
        R.never("ZERO_SESSION_VOLUME", F.col("session_volume") == 0),
        R.never("SIDE_QUOTE_MISSING", quote.isNull()),
    )
    fee, impact = fees_bps / 10_000, impact_bps / 10_000
    staged = orders.withColumn("_blocked", blocked).withColumn(
        "_filled",
        F.when(
            F.size("_blocked") == 0,
            F.least(F.col("quantity"), F.floor(F.col("session_volume") * F.lit(max_participation))),
        ).otherwise(0),
    )
    filled = F.col("_filled")
    rate = F.when(filled > 0, F.try_divide(filled, F.col("session_volume")))
    to_cap = F.least(F.lit(1.0), rate / max_participation)
    price = quote * (F.lit(1.0) + F.lit(impact) * to_cap * F.when(buy, 1).otherwise(-1))
    notional = price * filled / 1000.0
    return staged.select(
        *[F.col(c) for c in orders.columns],
        F.when(filled <= 0, "NO_FILL").when(filled == F.col("quantity"), "FILLED").otherwise("PARTIAL_FILL").alias(
            "fill_status"
        ),
        filled.alias("filled_quantity"), (F.col("quantity") - filled).alias("unfilled_quantity"),
        F.when(filled > 0, price).alias("fill_price"),
        F.when(filled > 0, notional).otherwise(0.0).alias("gross_notional"),
        F.when(filled > 0, notional * (F.lit(fee) + F.lit(impact) * to_cap)).otherwise(0.0).alias("estimated_cost"),
        F.when(F.size("_blocked") > 0, F.lit(None).cast("double")).when(filled <= 0, 0.0).otherwise(rate).alias(
            "participation_rate"
        ),
        F.when(F.size("_blocked") > 0, F.col("_blocked"))
        .when(filled <= 0, F.array(F.lit("PARTICIPATION_CAP_ROUNDS_TO_ZERO")))
        .when(filled < F.col("quantity"), F.array(F.lit("ORDER_EXCEEDS_PARTICIPATION_CAP")))
        .otherwise(F.array().cast("array<string>")).alias("reason_codes"),
    )


def executability(quotes: DataFrame, authorized=("LICENSED_VENDOR", "BROKER_AUTHENTICATED", "DIRECT_MARKET_FEED"), max_age_minutes: float = 2.0) -> DataFrame:
    """Whether a quote snapshot could be traded on at its decision time, with every reason."""
    micros = F.unix_micros
    age = (micros("decision_at") - micros("provider_as_of")) / 60e6
    measured = (micros("observed_at") - micros("provider_as_of")) / 60e6
    times = F.col("decision_at").isNotNull() & F.col("observed_at").isNotNull() & F.col("provider_as_of").isNotNull()
    two_sided = R.finite("bid", 0.001) & R.finite("ask", 0.001) & R.finite("reference_price", 0.001)
    status = F.upper(F.coalesce("trading_status", F.lit("")))
    reasons = R.code_array(
        R.must("EXECUTION_FEED_NOT_AUTHORIZED", F.upper("feed_access").isin(*authorized)),
        R.must("MISSING_FEED_ENTITLEMENT_ID", R.present("entitlement_id")),
        R.must("EXECUTION_EVIDENCE_UNRESOLVED", R.is_sha256("raw_sha256")),
        R.never("EXECUTION_TIMESTAMP_ORDER",
                (F.col("provider_as_of") > F.col("observed_at")) | (F.col("observed_at") > F.col("decision_at"))),
        R.never("DELAY_DECLARATION_MISMATCH", times & (F.abs(F.col("delay_minutes") - measured) > 1)),
        R.never("STALE_OR_FUTURE_EXECUTION_SNAPSHOT", (age < 0) | (age > max_age_minutes)),
        R.must("INVALID_EXECUTION_TIMESTAMPS", times & R.finite("delay_minutes", 0)),
        R.must("NON_EXECUTABLE_MARKET_PHASE", F.upper("market_phase").isin(*EXECUTABLE_PHASES)),
        F.when(status != "TRADED", F.concat(F.lit("TRADING_STATUS_"), F.when(status == "", "UNKNOWN").otherwise(status))),
        R.never("CROSSED_QUOTE", two_sided & (F.col("ask") < F.col("bid"))),
        R.never("UPPER_LIMIT_QUEUE_OR_CENSORING", two_sided & (F.try_divide("ask", "reference_price") >= 1.10 - 1e-12)),
        R.never("LOWER_LIMIT_STATE", two_sided & (F.try_divide("bid", "reference_price") <= 0.95 + 1e-12)),
        R.must("INVALID_TWO_SIDED_QUOTE", two_sided),
    )
    return quotes.withColumn("reason_codes", reasons).withColumn("age_minutes", age).withColumn(
        "status", F.when(F.size("reason_codes") > 0, "DETECTED_NOT_EXECUTABLE").otherwise("EXECUTABLE")
    )


def previous_session_close(actions: DataFrame, bars: DataFrame, at: str = "ex_date") -> DataFrame:
    """As-of join: the last close strictly before a date.

    Each bar is valid from the day after it to its successor's day, so the
    as-of becomes a bucketed interval join and no action meets all bars.
    """
    spans = bars.select(
        "code", F.date_add("trade_date", 1).alias("_from"), F.lead("trade_date").over(_by_code()).alias("_to"),
        F.col("trade_date").alias("reference_date"), F.col("close").alias("reference_close"),
    )
    return interval_join(actions, spans, ["code"], at, "_from", "_to", "left").drop("_from", "_to")


def normalise_benchmark(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Raw (benchmark_code, trade_date, text value) joined to its registry row and checked."""
    value = F.col("benchmark_value").cast("string")
    joined = raw.join(registry, "benchmark_code", "left")
    checked = R.check(
        joined.withColumn("value", value.try_cast("decimal(20,6)")),
        R.must("BENCHMARK_NOT_REGISTERED", F.col("market_scope").isNotNull()),
        R.must("BENCHMARK_VALUE_NOT_CANONICAL", value.rlike(r"^(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$")),
        R.must("BENCHMARK_VALUE_OUT_OF_RANGE", F.col("value") > 0),
    )
    return checked
