"""Event laboratory over orders as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.operators import lab
from tidegauge.plans import views
from tidegauge.plans.views import LAB, with_views

CODE_PATTERN = r"^[0-9]{4,}$"


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clean(lab.check_events(views.lab_events(spark, sf_dir), CODE_PATTERN))


def _run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    run_at = F.lit(views.RUN_AT).cast("timestamp")
    # The gate minimums are relaxed only so that the smallest scale reaches the fit.
    return lab.run_nightly(_clean(spark, sf_dir), "nightly", run_at, minimum_probe=100)


def holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    scored = lab.score_nightly(run, "nightly", F.lit(views.RUN_AT).cast("timestamp"))
    return scored.select(
        "horizon", "event_count",
        F.round("mean_absolute_error", 8).alias("mean_absolute_error"),
        F.round("directional_hit_rate", 8).alias("directional_hit_rate"),
    )


def fitted_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)["weights"].select(
        "horizon", "factor_id", F.round("base_weight", 8).alias("base_weight"),
        F.round("validation_scale", 8).alias("validation_scale"), F.round("weight", 8).alias("weight"),
    )


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lab.temporal_split(_clean(spark, sf_dir))
    return split.groupBy("cohort", "split").agg(
        F.count("*").alias("n"),
        F.min("prediction_at").cast("string").alias("first_at"),
        F.max("prediction_at").cast("string").alias("last_at"),
        F.sum(F.col("event_id").cast("bigint")).alias("id_checksum"),
    )


def sealed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)["predictions"].select(
        "event_id", "horizon", "cohort", F.round("score", 8).alias("score"), "direction"
    )


def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = lab.check_events(views.lab_events(spark, sf_dir), CODE_PATTERN)
    return R.issues(checked, "event_contract", "event_id")


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.cohort_gate(_clean(spark, sf_dir)).select(
        "primary_count", "probe_count", "total_count", "status", F.concat_ws(",", "reasons").alias("reasons")
    )


QUERIES = {
    "nightly_holdout_metrics": holdout_metrics,
    "nightly_fitted_weights": fitted_weights,
    "nightly_split_sizes": split_sizes,
    "nightly_sealed_predictions": sealed_predictions,
    "nightly_event_contract": contract_issues,
    "nightly_cohort_gate": gate,
}

ORACLE = {
    "nightly_holdout_metrics": with_views(LAB, """
        SELECT horizon, count(*) AS event_count, round(avg(abs(score - y)), 8) AS mean_absolute_error,
               round(avg(CASE WHEN (CASE WHEN score > 1e-12 THEN 1 WHEN score < -1e-12 THEN -1 ELSE 0 END)
                              = (CASE WHEN y > 1e-12 THEN 1 WHEN y < -1e-12 THEN -1 ELSE 0 END)
                              THEN 1.0 ELSE 0.0 END), 8) AS directional_hit_rate
        FROM lab_pred GROUP BY 1"""),
    "nightly_fitted_weights": with_views(LAB, """
        SELECT r.horizon, factor_id, round(base, 8) AS base_weight, round(scale, 8) AS validation_scale,
               round(base * scale, 8) AS weight
        FROM lab_raw r JOIN lab_scale s ON s.horizon = r.horizon"""),
    "nightly_split_sizes": with_views(LAB[:2], """
        SELECT cohort, split, count(*) AS n, strftime(min(prediction_at), '%Y-%m-%d %H:%M:%S') AS first_at,
               strftime(max(prediction_at), '%Y-%m-%d %H:%M:%S') AS last_at,
               CAST(sum(CAST(event_id AS BIGINT)) AS BIGINT) AS id_checksum
        FROM lab_split GROUP BY 1, 2"""),
    "nightly_sealed_predictions": with_views(LAB, """
        SELECT event_id, horizon, cohort, round(score, 8) AS score,
               CASE WHEN score > 1e-12 THEN 'UP' WHEN score < -1e-12 THEN 'DOWN' ELSE 'FLAT' END AS direction
        FROM lab_pred"""),
    "nightly_event_contract": with_views(LAB[:1], """
        SELECT 'event_contract' AS operator, event_id AS row_key, u.code AS code, 'ERROR' AS severity
        FROM lab_base, LATERAL (SELECT unnest(['OUTCOME_HORIZONS_INCOMPLETE', 'DENOMINATOR_INCOMPLETE']) AS code) u
        WHERE NOT admitted"""),
    "nightly_cohort_gate": with_views(LAB[:1], """
        SELECT p AS primary_count, q AS probe_count, n AS total_count,
               CASE WHEN p < 50 OR q < 300 THEN 'STOP_TRAINING' ELSE 'READY_TO_SPLIT' END AS status,
               concat_ws(',', CASE WHEN p < 50 THEN 'PRIMARY_EVENT_MINIMUM_NOT_MET' END,
                              CASE WHEN q < 300 THEN 'PROBE_EVENT_MINIMUM_NOT_MET' END) AS reasons
        FROM (SELECT count(*) FILTER (cohort = 'PRIMARY') AS p, count(*) FILTER (cohort = 'PROBE') AS q,
                     count(*) AS n FROM lab_base WHERE admitted)"""),
}
