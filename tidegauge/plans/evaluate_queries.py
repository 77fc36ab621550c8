"""Ranking, evaluation, replay metrics and the post-open scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import evaluate as ev
from tidegauge.operators import scan
from tidegauge.operators.lab import HORIZONS
from tidegauge.plans import views
from tidegauge.plans.views import table, with_views
from tidegauge.session import broadcast_if_small, materialise


def _rows(spark, sf_dir):
    return materialise(ev.outcome_returns(views.outcomes(spark, sf_dir)))


def returns(spark, sf_dir):
    r = ev.outcome_returns(views.outcomes(spark, sf_dir))
    return r.select("decision_id", "code", "selected", "fill_status",
                    *[F.round(c, 6).alias(c) for c in ("comparable_gross", "comparable_net_excess", "executed_net_excess")])


def rank_ics(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return ev.rank_ic(r.where("NOT abstained"), "score", "comparable_net_excess").select(
        "decision_id", "scored", F.round("rank_ic", 6).alias("rank_ic"))


def metrics(spark, sf_dir):
    m = ev.evaluate_forecasts(_rows(spark, sf_dir), views.TOP_K)
    return m.select("decision_dates", "denominator_rows", "selected_count", "probability_rows", *[
        F.round(c, 6).alias(c) for c in ("abstention_rate", "mean_rank_ic", "mean_precision_selected", "mean_recall_at_k",
                                         "mean_selected_executed_net_excess", "non_fill_rate", "brier_score")])


def top_k(spark, sf_dir):
    r = ev.outcome_returns(views.outcomes(spark, sf_dir))
    return ev.actual_top_k(r, "comparable_gross", views.TOP_K).select("decision_id", "code", "actual_rank", "selected")


def replay(spark, sf_dir):
    r = ev.outcome_returns(views.outcomes(spark, sf_dir))
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("sector"))
    joined = r.join(nation, "code")
    sector = broadcast_if_small(materialise(
        joined.groupBy("decision_id", "sector").agg(F.avg("comparable_gross").alias("sector_return"))))
    rows = materialise(joined.join(sector, ["decision_id", "sector"]).select(
        "decision_id", "code", "score", "rank", "selected", "abstained", F.col("comparable_gross").alias("gross"),
        (F.col("comparable_gross") - 0.0015).alias("net"), F.col("comparable_net_excess").alias("market_excess"),
        (F.col("comparable_gross") - F.col("sector_return")).alias("sector_excess")))
    m = ev.replay_metrics(rows, views.TOP_K, 40)
    keep = ("primary_agreement", "primary_wilson_low", "primary_wilson_high", "top1_agreement", "top1_wilson_low",
            "top1_wilson_high", "actionable_rate", "market_rate", "mean_gross", "mean_net", "mean_market_excess",
            "mean_sector_excess", "mean_recall_at_k", "mean_primary_rank_ic", "mean_market_rank_ic")
    return m.select("decision_sessions", "effective_decisions", "denominator_rows", "selected_rows",
                    *[F.round(c, 6).alias(c) for c in keep])


def _features(spark, sf_dir):
    b = views.bars(spark, sf_dir)
    return b.select(
        F.col("trade_date").cast("string").alias("decision_id"), "code",
        F.round(F.col("close") / F.col("open") - 1.0, 6).alias("relative_return_5d"),
        F.round(F.col("high") / F.col("low") - 1.0, 6).alias("relative_return_20d"),
        (F.round("turnover", 2) / 1e6).alias("relative_value_20d"),
        (F.col("volume") / 100.0).alias("relative_volume_20d"),
        F.when(F.col("trades") > 1, F.col("trades") / 10.0).alias("official_event_net_30d"),
        F.when(F.col("volume") > 20, F.lit(0.5)).alias("liquidity_percentile"))


def heuristic(spark, sf_dir):
    r = ev.heuristic_rank(_features(spark, sf_dir), views.TOP_K)
    return r.select("decision_id", "code", "rank", "selected", "decision_status", F.round("score", 9).alias("score"),
                    F.round("feature_coverage", 6).alias("feature_coverage"))


def rank_contract(spark, sf_dir):
    """Supplied ranks ordered by code instead of by score."""
    r = views.outcomes(spark, sf_dir).select("decision_id", "code", "score", "rank", (F.col("rank") <= 3).alias("selected")).na.fill(
        False, ["selected"])
    c = ev.check_ranks(r, views.TOP_K)
    return c.select(F.explode("issue_codes").alias("issue"), "decision_id").groupBy("issue").agg(
        F.count("*").alias("rows"), F.count_distinct("decision_id").alias("decisions"))


def outcome_match(spark, sf_dir):
    p = views.bars(spark, sf_dir).select(F.col("trade_date").cast("string").alias("decision_id"), "code",
                                         F.col("volume").alias("size"), F.col("trades").alias("n"))
    o = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'").groupBy(
        F.to_date("l_shipdate").cast("string").alias("decision_id"), F.col("l_suppkey").alias("code")).agg(
        F.sum("l_quantity").alias("size"), F.count("*").alias("n"))
    m = ev.match_outcomes(p, o, ["size", "n"])
    return m.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("rows"), F.sum("code").alias("codes"))


def observations(spark, sf_dir):
    """Events as intraday observations of one scan a day at noon."""
    e = table(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts")
    noon = day + F.expr("INTERVAL 12 HOURS")
    known = F.timestamp_micros(F.unix_micros(F.col("ts")) - F.floor(F.col("value") * 1000000) + 20000000)

    def factor(name, value):
        return F.struct(F.lit(name).alias("factor_id"), value.alias("value"), known.alias("known_at"),
                        F.lit("x").alias("source_id"), F.lit("PUBLIC_RESEARCH_ALLOWED").alias("rights_status"))

    return e.select(
        F.col("event_id").alias("seq"), F.to_date("ts").cast("string").alias("scan_id"), noon.alias("scan_at"),
        F.lpad(F.col("user_id").cast("string"), 4, "0").alias("official_code"), F.col("ts").alias("observed_at"),
        F.lit("src").alias("source_id"), F.when(F.col("event_type") == "view", "END_OF_DAY").otherwise("DELAYED").alias("latency_class"),
        (F.col("event_type") != "error").alias("identity_verified"), (F.col("value") * 1e5).alias("average_daily_turnover_sar"),
        F.array(factor("MOMENTUM", F.col("value") / 100.0 - 0.3), factor("FLOW", F.when(F.col("event_type") == "purchase", 1.0).otherwise(-0.1))).alias("factors"))


SCAN_MINUTES = 360


def scan_reasons(spark, sf_dir):
    a = scan.admit(observations(spark, sf_dir), SCAN_MINUTES)
    return a.groupBy("scan_id", "reason").agg(F.count("*").alias("rows"), F.sum("seq").alias("seq_checksum"))


WEIGHTS = {h: {"MOMENTUM": 0.5 + i / 10.0, "FLOW": 0.25 - i / 10.0} for i, h in enumerate(HORIZONS)}


def scan_candidates(spark, sf_dir):
    a = scan.admit(observations(spark, sf_dir), SCAN_MINUTES).where("reason IS NULL")
    return scan.rank_candidates(a, WEIGHTS, 10).select(
        "scan_id", "horizon", "official_code", "rank", F.round("score", 6).alias("score"), "research_status")


QUERIES = {
    "forecast_outcome_returns": returns, "forecast_rank_ic": rank_ics, "forecast_metrics": metrics, "forecast_actual_top_k": top_k,
    "forecast_outcome_match": outcome_match, "replay_metrics": replay, "rank_heuristic": heuristic, "rank_contract": rank_contract,
    "scan_admission_reasons": scan_reasons, "scan_candidates_by_horizon": scan_candidates,
}

EXEC = """CASE WHEN selected AND volume > 30 THEN next_close / (close * 1.001) - 1 - market - 0.0015 WHEN selected THEN -market END"""
SCAN = """obs AS (SELECT event_id AS seq, CAST(CAST(ts AS DATE) AS VARCHAR) AS scan_id, lpad(CAST(user_id AS VARCHAR), 4, '0') AS official_code,
      epoch_us(date_trunc('day', ts) + INTERVAL 12 HOUR) - epoch_us(ts) AS age, event_type, value,
      epoch_us(ts) - CAST(floor(value * 1000000) AS BIGINT) + 20000000 > epoch_us(date_trunc('day', ts) + INTERVAL 12 HOUR) AS leak FROM events),
    own AS (SELECT *, CASE WHEN age < 0 THEN 'OBSERVATION_FROM_FUTURE' WHEN age > 21600000000 THEN 'STALE_MARKET_OBSERVATION'
      WHEN event_type = 'view' THEN 'END_OF_DAY_DATA_NOT_VALID_FOR_POST_OPEN_SCAN' WHEN event_type = 'error' THEN 'IDENTITY_UNVERIFIED'
      WHEN value * 1e5 < 1000000 THEN 'LIQUIDITY_FLOOR_NOT_MET' WHEN leak THEN 'FEATURE_LEAKAGE_AFTER_SCAN_CUTOFF' END AS own FROM obs),
    adm AS (SELECT *, CASE WHEN seq > min(CASE WHEN own IS NULL THEN seq END) OVER (PARTITION BY scan_id, official_code)
      THEN 'DUPLICATE_SECURITY_OBSERVATION' ELSE own END AS reason FROM own)"""
ORACLE = {
    "forecast_outcome_returns": with_views(["bars", "outc"], f"""
        SELECT decision_id, code, selected, CASE WHEN selected THEN CASE WHEN volume > 30 THEN 'FILLED' ELSE 'NOT_FILLED' END ELSE 'MARKET_OBSERVED' END AS fill_status,
               round(gross, 6) AS comparable_gross, round(net, 6) AS comparable_net_excess, round({EXEC}, 6) AS executed_net_excess FROM outc"""),
    "forecast_rank_ic": with_views(["bars", "outc", "ranks", "ics"], "SELECT decision_id, scored, round(rank_ic, 6) AS rank_ic FROM ics"),
    "forecast_metrics": with_views(["bars", "outc", "ranks", "ics"], f"""
        , d AS (SELECT decision_id, count(*) AS n, count(*) FILTER (abstained) AS ab, count(*) FILTER (selected) AS sel,
                  count(*) FILTER (selected AND net > 0) AS hits, count(*) FILTER (selected AND volume <= 30) AS nf, sum({EXEC}) AS es,
                  sum(CASE WHEN score IS NOT NULL THEN pow(least(1.0, abs(score)) - CASE WHEN net > 0 THEN 1 ELSE 0 END, 2) END) AS bs, count(score) AS bn FROM outc GROUP BY 1),
        t AS (SELECT decision_id, avg(CASE WHEN selected THEN 1.0 ELSE 0.0 END) AS recall FROM (SELECT *, row_number() OVER
                  (PARTITION BY decision_id ORDER BY net DESC, code) AS ar FROM outc) WHERE ar <= 5 GROUP BY 1)
        SELECT count(*) AS decision_dates, CAST(sum(n) AS BIGINT) AS denominator_rows, CAST(sum(sel) AS BIGINT) AS selected_count,
               CAST(sum(bn) AS BIGINT) AS probability_rows, round(sum(ab) / sum(n), 6) AS abstention_rate, round(avg(rank_ic), 6) AS mean_rank_ic,
               round(avg(CASE WHEN sel > 0 THEN hits / sel END), 6) AS mean_precision_selected, round(avg(recall), 6) AS mean_recall_at_k,
               round(sum(es) / sum(sel), 6) AS mean_selected_executed_net_excess, round(sum(nf) / sum(sel), 6) AS non_fill_rate,
               round(sum(bs) / sum(bn), 6) AS brier_score FROM d LEFT JOIN ics USING (decision_id) LEFT JOIN t USING (decision_id)"""),
    "forecast_actual_top_k": with_views(["bars", "outc"], """
        SELECT decision_id, code, ar AS actual_rank, selected FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY gross DESC, code) AS ar
        FROM outc) WHERE ar <= 5"""),
    "forecast_outcome_match": """
        WITH p AS (SELECT l_shipdate AS d, l_suppkey AS c, sum(l_quantity) AS s, count(*) AS n, sum(l_quantity) FILTER (l_returnflag <> 'A') AS s2,
                     count(*) FILTER (l_returnflag <> 'A') AS n2 FROM lineitem GROUP BY 1, 2)
        SELECT concat_ws('|', CASE WHEN n2 = 0 THEN 'OUTCOME_MISSING' END, CASE WHEN n2 > 0 AND s <> s2 THEN 'MISMATCH:size' END,
                         CASE WHEN n2 > 0 AND n <> n2 THEN 'MISMATCH:n' END) AS issues, count(*) AS rows, CAST(sum(c) AS BIGINT) AS codes FROM p GROUP BY 1""",
    "replay_metrics": with_views(["bars", "outc"], """
        , j AS (SELECT o.*, gross - avg(gross) OVER (PARTITION BY decision_id, s_nationkey) AS sx FROM outc o JOIN supplier ON s_suppkey = code),
        k AS (SELECT *, rank() OVER (PARTITION BY decision_id ORDER BY score) + (count(*) OVER (PARTITION BY decision_id, score) - 1) / 2.0 AS rs,
                     rank() OVER (PARTITION BY decision_id ORDER BY gross) + (count(*) OVER (PARTITION BY decision_id, gross) - 1) / 2.0 AS rg,
                     rank() OVER (PARTITION BY decision_id ORDER BY net) + (count(*) OVER (PARTITION BY decision_id, net) - 1) / 2.0 AS rn
              FROM j WHERE NOT abstained),
        i AS (SELECT decision_id, CASE WHEN count(*) > 1 AND stddev_pop(rs) > 0 AND stddev_pop(rg) > 0 THEN corr(rs, rg) END AS ig,
                     CASE WHEN count(*) > 1 AND stddev_pop(rs) > 0 AND stddev_pop(rn) > 0 THEN corr(rs, rn) END AS inn FROM k GROUP BY 1),
        t AS (SELECT decision_id, avg(CASE WHEN selected THEN 1.0 ELSE 0.0 END) AS recall FROM (SELECT *, row_number() OVER
                  (PARTITION BY decision_id ORDER BY gross DESC, code) AS ar FROM j) WHERE ar <= 5 GROUP BY 1),
        a AS (SELECT count(DISTINCT decision_id) AS ds, count(DISTINCT CASE WHEN selected THEN decision_id END) AS ed, count(*) AS dr,
                count(*) FILTER (selected) AS n, count(*) FILTER (selected AND gross > 0) AS h, count(*) FILTER (selected AND rk = 1) AS tn,
                count(*) FILTER (selected AND rk = 1 AND gross > 0) AS th, count(*) FILTER (selected AND gross - 0.0015 > 0) AS ah,
                count(*) FILTER (selected AND net > 0) AS mh, avg(gross) FILTER (selected) AS mg, avg(net) FILTER (selected) AS mn,
                avg(sx) FILTER (selected) AS ms FROM j),
        w AS (SELECT *, h / n AS p, th / tn AS q, 3.841458820694124 AS z2 FROM a)
        SELECT ds AS decision_sessions, ed AS effective_decisions, dr AS denominator_rows, n AS selected_rows, round(p, 6) AS primary_agreement,
          round(((p + z2 / (2 * n)) - 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n), 6) AS primary_wilson_low,
          round(((p + z2 / (2 * n)) + 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n), 6) AS primary_wilson_high,
          round(q, 6) AS top1_agreement,
          round(((q + z2 / (2 * tn)) - 1.959963984540054 * sqrt(q * (1 - q) / tn + z2 / (4.0 * tn * tn))) / (1 + z2 / tn), 6) AS top1_wilson_low,
          round(((q + z2 / (2 * tn)) + 1.959963984540054 * sqrt(q * (1 - q) / tn + z2 / (4.0 * tn * tn))) / (1 + z2 / tn), 6) AS top1_wilson_high,
          round(ah / n, 6) AS actionable_rate, round(mh / n, 6) AS market_rate, round(mg, 6) AS mean_gross, round(mg - 0.0015, 6) AS mean_net,
          round(mn, 6) AS mean_market_excess, round(ms, 6) AS mean_sector_excess, round((SELECT avg(recall) FROM t), 6) AS mean_recall_at_k,
          round((SELECT avg(ig) FROM i), 6) AS mean_primary_rank_ic, round((SELECT avg(inn) FROM i), 6) AS mean_market_rank_ic FROM w"""),
    "rank_heuristic": with_views(["bars"], """
        , f AS (SELECT CAST(trade_date AS VARCHAR) AS decision_id, code, (4 + CASE WHEN trades > 1 THEN 1 ELSE 0 END + CASE WHEN volume > 20 THEN 1 ELSE 0 END) / 6.0 AS cov,
                  0.25::DOUBLE * round(close / open - 1, 6) + 0.15::DOUBLE * round(high / low - 1, 6) + 0.2::DOUBLE * (round(turnover, 2) / 1e6) + 0.15::DOUBLE * (volume / 100.0)
                  + 0.15::DOUBLE * CASE WHEN trades > 1 THEN trades / 10.0 ELSE 0 END + 0.1::DOUBLE * CASE WHEN volume > 20 THEN 0.5 ELSE 0 END AS raw FROM bars),
        g AS (SELECT *, CASE WHEN cov >= 0.67 THEN raw END AS score FROM f),
        h AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY score DESC NULLS LAST, code) AS p FROM g)
        SELECT decision_id, code, CASE WHEN score IS NOT NULL THEN p END AS rank, score IS NOT NULL AND p <= 5 AS selected,
               CASE WHEN score IS NULL THEN 'ABSTAIN' ELSE 'DETECTED' END AS decision_status, round(score, 9) AS score, round(cov, 6) AS feature_coverage FROM h"""),
    "rank_contract": with_views(["bars", "outc"], """
        SELECT 'SELECTED_NOT_TOP_K' AS issue, count(*) AS rows, count(DISTINCT decision_id) AS decisions FROM outc
        WHERE score IS NOT NULL AND rk BETWEEN 4 AND 5"""),
    "scan_admission_reasons": f"""WITH {SCAN} SELECT scan_id, reason, count(*) AS rows, CAST(sum(seq) AS BIGINT) AS seq_checksum FROM adm GROUP BY 1, 2""",
    "scan_candidates_by_horizon": f"""WITH {SCAN}, s AS (SELECT scan_id, horizon, official_code,
          round((value / 100.0 - 0.3) * (0.5 + i / 10.0) + CASE WHEN event_type = 'purchase' THEN 1.0 ELSE -0.1 END * (0.25 - i / 10.0), 12) AS score
          FROM adm, (VALUES ('INTRADAY', 0), ('NEXT_SESSION', 1), ('WEEK', 2), ('MONTH', 3), ('YEAR', 4)) h(horizon, i) WHERE reason IS NULL)
        SELECT scan_id, horizon, official_code, rank, round(score, 6) AS score,
               CASE WHEN score > 0 THEN 'RESEARCH_CANDIDATE' ELSE 'RESEARCH_WATCHLIST' END AS research_status
        FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, horizon ORDER BY score DESC, official_code) AS rank FROM s) WHERE rank <= 10""",
}
