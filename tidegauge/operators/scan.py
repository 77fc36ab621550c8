"""Post-open scan: admission reasons in a fixed order, then scores per horizon.

The first admitted observation of a security wins; later ones are duplicates
whatever their own defects. That needs only the smallest admitted sequence
number per security, an aggregate, not an ordered walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.lab import HORIZONS

OBSERVATION_SCHEMA = (
    "official_code string, observed_at timestamp, source_id string, source_role string, rights_status string, "
    "latency_class string, last_price_sar double, average_daily_turnover_sar double, identity_verified boolean, "
    "factors array<struct<factor_id:string,value:double,known_at:timestamp,source_id:string,rights_status:string>>"
)
MAXIMUM_AGE_MINUTES = 15
MINIMUM_TURNOVER = 1_000_000.0


def own_reason(scan_at: Column, maximum_age_minutes: int, minimum_turnover: float) -> Column:
    """Why a row is refused on its own account, first reason only."""
    age = F.unix_micros(scan_at) - F.unix_micros("observed_at")
    return (
        F.when(age < 0, "OBSERVATION_FROM_FUTURE")
        .when(age > maximum_age_minutes * 60_000_000, "STALE_MARKET_OBSERVATION")
        .when(F.col("latency_class") == "END_OF_DAY", "END_OF_DAY_DATA_NOT_VALID_FOR_POST_OPEN_SCAN")
        .when(~F.coalesce("identity_verified", F.lit(False)), "IDENTITY_UNVERIFIED")
        .when(~F.coalesce(F.col("average_daily_turnover_sar") >= minimum_turnover, F.lit(False)), "LIQUIDITY_FLOOR_NOT_MET")
        .when(F.exists("factors", lambda f: f["known_at"] > scan_at), "FEATURE_LEAKAGE_AFTER_SCAN_CUTOFF")
    )


def admit(
    observations: DataFrame, maximum_age_minutes: int = MAXIMUM_AGE_MINUTES, minimum_turnover: float = MINIMUM_TURNOVER
) -> DataFrame:
    """Every observation with its ``reason``; NULL means admitted. Needs scan_id, scan_at, seq."""
    judged = observations.withColumn("_own", own_reason(F.col("scan_at"), maximum_age_minutes, minimum_turnover))
    first = judged.where("_own IS NULL").groupBy("scan_id", "official_code").agg(F.min("seq").alias("_first"))
    return judged.join(first, ["scan_id", "official_code"], "left").withColumn(
        "reason",
        F.when(F.col("seq") > F.col("_first"), "DUPLICATE_SECURITY_OBSERVATION").otherwise(F.col("_own")),
    ).drop("_own", "_first")


def scan_gate(scans: DataFrame, sessions: DataFrame) -> DataFrame:
    """Which scans may run: trading day, half an hour after the open, before the session end.

    ``sessions(trade_date, is_trading_day, open_at, close_at)``.
    """
    joined = scans.withColumn("trade_date", F.to_date("scan_at")).join(sessions, "trade_date", "left")
    return joined.select(
        *[F.col(c) for c in scans.columns],
        F.when(~F.coalesce("is_trading_day", F.lit(False)), "MARKET_CLOSED")
        .when(F.col("scan_at") < F.col("open_at") + F.expr("INTERVAL 30 MINUTES"), "SCAN_BEFORE_OPEN_PLUS_30_MINUTES")
        .when(F.col("scan_at") > F.col("close_at"), "SCAN_AFTER_TRADING_SESSION").alias("abstain_reason"),
    )


def rank_candidates(admitted: DataFrame, weights: dict[str, dict[str, float]], top_n: int = 25) -> DataFrame:
    """Top rows per scan and horizon; the limit is applied before the shuffle."""
    if set(weights) != set(HORIZONS):
        raise ValueError("weights are required for all governed horizons")

    def score(h: str) -> Column:
        table = F.create_map(*[F.lit(x) for kv in sorted(weights[h].items()) for x in kv])
        return F.bround(
            F.aggregate(
                "factors", F.lit(0.0),
                lambda acc, f: acc + F.coalesce(F.element_at(table, f["factor_id"]), F.lit(0.0)) * f["value"],
            ), 12)

    scored = admitted.select(
        "scan_id", "official_code", "observed_at", "source_id", "latency_class",
        F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), score(h).alias("score")) for h in HORIZONS])).alias("s"),
    ).select("scan_id", "official_code", "observed_at", "source_id", "latency_class", "s.horizon", "s.score")
    order = Window.partitionBy("scan_id", "horizon").orderBy(F.desc("score"), F.asc("official_code"))
    return (
        scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
        .withColumn("research_status", F.when(F.col("score") > 0, "RESEARCH_CANDIDATE").otherwise("RESEARCH_WATCHLIST"))
    )
