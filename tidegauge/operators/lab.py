"""Event laboratory: contract, gate, chronological split, fit, seal, score.

Input is one row per event with nested ``factors`` and ``outcomes``. Factors are
exploded only for the fit, where five map-side sums per factor leave one row per
factor to shuffle; scoring reads the small weight table as map columns and never
shuffles the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.functions.digest import table_digest
from tidegauge.operators.ordering import positions
from tidegauge.session import materialise

# Governed horizons, admitted source roles and rights, thresholds.
HORIZONS = ("INTRADAY", "NEXT_SESSION", "WEEK", "MONTH", "YEAR")
COHORTS = ("PRIMARY", "PROBE")
SOURCE_ROLES = ("OFFICIAL_VERIFICATION", "REGULATORY_EVIDENCE", "ISSUER_DISCLOSURE", "LICENSED_MARKET_DATA")
RIGHTS = ("PUBLIC_RESEARCH_ALLOWED", "LICENSED_RESEARCH_ALLOWED")
MINIMUM_PRIMARY = 50
MINIMUM_PROBE = 300
LOOKBACK_YEARS = 10
SCALE_LIMIT = 3.0
FLAT_BAND = 1e-12

EVENT_SCHEMA = (
    "event_id string, official_code string, prediction_at timestamp, event_at timestamp, "
    "evidence_known_at timestamp, cohort string, event_type string, source_id string, "
    "source_role string, rights_status string, "
    "factors array<struct<factor_id:string,value:double,known_at:timestamp,source_id:string,rights_status:string>>, "
    "outcomes array<struct<horizon:string,excess_return:double,known_at:timestamp,price_basis:string>>, "
    "denominator_complete boolean, corporate_actions_reconciled boolean, identity_verified boolean"
)


def _every(values: Column, holds: Column) -> Column:
    """No value is null and ``holds``, a statement on their extreme, is true; true of no values.

    Says what ``forall`` says without calling a lambda for every element of every row.
    """
    least = F.get(F.sort_array(values), 0)  # nulls come first
    return (F.size(values) == 0) | (least.isNotNull() & holds)


def check_events(events: DataFrame, code_pattern: str = r"^[0-9]{4}$") -> DataFrame:
    """Leakage and completeness contract of one event row."""
    factor_ids, factors_known = F.col("factors.factor_id"), F.col("factors.known_at")
    horizons, outcomes_known = F.col("outcomes.horizon"), F.col("outcomes.known_at")
    distinct_horizons = F.array_distinct(horizons)
    all_horizons = F.size(distinct_horizons) == len(HORIZONS)
    for horizon in HORIZONS:
        all_horizons = all_horizons & F.array_contains(horizons, horizon)
    return R.check(
        events,
        R.must("EVENT_ID_REQUIRED", R.present("event_id")),
        R.must("OFFICIAL_CODE_FORM", F.col("official_code").rlike(code_pattern)),
        R.must("COHORT_UNKNOWN", R.in_set("cohort", COHORTS)),
        R.must("PREDICTION_AFTER_EVENT", F.col("prediction_at") <= F.col("event_at")),
        R.must("EVIDENCE_BEFORE_EVENT", F.col("evidence_known_at") >= F.col("event_at")),
        R.must("SOURCE_ROLE_NOT_AUTHORITATIVE", R.in_set("source_role", SOURCE_ROLES)),
        R.must("RIGHTS_NOT_ADMITTED", R.in_set("rights_status", RIGHTS)),
        R.must("SOURCE_ID_REQUIRED", R.present("source_id")),
        R.must("FACTORS_REQUIRED", F.size("factors") > 0),
        R.never("FACTOR_ID_DUPLICATE", F.size(F.array_distinct(factor_ids)) != F.size("factors")),
        R.must(
            "FEATURE_LEAKAGE_AFTER_PREDICTION_CUTOFF",
            _every(factors_known, F.array_max(factors_known) <= F.col("prediction_at")),
        ),
        R.never("OUTCOME_HORIZON_DUPLICATE", F.size(distinct_horizons) != F.size("outcomes")),
        R.must("OUTCOME_HORIZONS_INCOMPLETE", all_horizons),
        R.must(
            "OUTCOME_LEAKAGE_AT_PREDICTION_CUTOFF",
            _every(outcomes_known, F.array_min(outcomes_known) > F.col("prediction_at")),
        ),
        R.must("OUTCOME_BEFORE_EVENT", _every(outcomes_known, F.array_min(outcomes_known) >= F.col("event_at"))),
        R.must("DENOMINATOR_INCOMPLETE", F.col("denominator_complete")),
        R.must("CORPORATE_ACTIONS_UNRECONCILED", F.col("corporate_actions_reconciled")),
        R.must("IDENTITY_UNVERIFIED", F.col("identity_verified")),
    )


def check_cutoffs(events: DataFrame, run_at: Column, lookback_years: int = LOOKBACK_YEARS) -> DataFrame:
    """Nothing older than the lookback and nothing known only after the run."""
    earliest = F.add_months(run_at.cast("date"), -12 * lookback_years).cast("timestamp") + (
        run_at - F.date_trunc("day", run_at)
    )
    return R.check(
        events,
        R.must(
            "EVENT_OUTSIDE_GOVERNED_LOOKBACK_WINDOW",
            (F.col("event_at") >= earliest) & (F.col("event_at") <= run_at),
        ),
        R.must("EVENT_EVIDENCE_NOT_KNOWN_AT_RUN_CUTOFF", F.col("evidence_known_at") <= run_at),
        R.must(
            "OUTCOME_NOT_KNOWN_AT_RUN_CUTOFF", _every(F.col("outcomes.known_at"), F.array_max("outcomes.known_at") <= run_at)
        ),
    )


def cohort_gate(
    events: DataFrame, minimum_primary: int = MINIMUM_PRIMARY, minimum_probe: int = MINIMUM_PROBE
) -> DataFrame:
    """One row: cohort counts, contract breaches when checked, status and stop reasons."""
    breaches = F.count_if(F.size("issue_codes") > 0) if "issue_codes" in events.columns else F.lit(0)
    return events.agg(
        F.count_if(F.col("cohort") == "PRIMARY").alias("primary_count"),
        F.count_if(F.col("cohort") == "PROBE").alias("probe_count"),
        F.count("*").alias("total_count"),
        breaches.alias("breach_count"),
    ).withColumn(
        "reasons",
        R.code_array(
            R.never("PRIMARY_EVENT_MINIMUM_NOT_MET", F.col("primary_count") < minimum_primary),
            R.never("PROBE_EVENT_MINIMUM_NOT_MET", F.col("probe_count") < minimum_probe),
        ),
    ).withColumn("status", F.when(F.size("reasons") > 0, "STOP_TRAINING").otherwise("READY_TO_SPLIT"))


def split_boundaries(events: DataFrame) -> list:
    """Per cohort the last training and last validation key: ``(cohort, size, train, validation)``.

    Cohorts may hold any share of the events, so positions come from a global
    range sort of the three key columns; the nested rows are never shuffled.
    """
    placed = positions(
        events.select("cohort", "prediction_at", "event_id"), ["prediction_at", "event_id"], ["cohort"]
    )
    sizes = placed.groupBy("cohort").agg(F.count("*").alias("size"))
    key = F.struct("prediction_at", "event_id")
    at = [F.max(F.when(F.col("position") == F.floor(F.col("size") * F.lit(share)), key)) for share in (0.60, 0.80)]
    # At most one row per governed cohort.
    return (
        placed.join(F.broadcast(sizes), "cohort")
        .groupBy("cohort")
        .agg(F.first("size").alias("size"), at[0].alias("train"), at[1].alias("validation"))
        .collect()
    )


def temporal_split(events: DataFrame) -> DataFrame:
    """60/20/20 by time inside each cohort, boundaries floored, ties by event id."""
    key = F.struct("prediction_at", "event_id")
    split = F.lit("HOLDOUT")
    for row in split_boundaries(events):
        for name in ("validation", "train"):
            edge = row[name]
            if edge is None:
                continue
            last = F.struct(
                F.lit(edge["prediction_at"]).cast("timestamp").alias("prediction_at"),
                F.lit(edge["event_id"]).alias("event_id"),
            )
            label = "TRAINING" if name == "train" else "VALIDATION"
            split = F.when((F.col("cohort") == row["cohort"]) & (key <= last), label).otherwise(split)
    return events.withColumn("split", split)


def split_problems(split: DataFrame) -> DataFrame:
    """Cohorts whose training, validation or holdout part is empty, and repeated event ids."""
    parts = split.groupBy("cohort").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in ("TRAINING", "VALIDATION", "HOLDOUT")]
    )
    short = parts.where("TRAINING < 1 OR VALIDATION < 1 OR HOLDOUT < 1").select(
        F.lit("temporal_split").alias("operator"), F.col("cohort").alias("row_key"),
        F.lit("COHORT_TOO_SMALL_FOR_SPLIT").alias("code"), F.lit("ERROR").alias("severity"),
    )
    repeated = split.groupBy("event_id").count().where("count > 1").select(
        F.lit("temporal_split").alias("operator"), F.col("event_id").cast("string").alias("row_key"),
        F.lit("EVENT_ID_NOT_UNIQUE").alias("code"), F.lit("ERROR").alias("severity"),
    )
    return short.unionByName(repeated)


def _outcome(horizon: str) -> Column:
    """The first outcome of the horizon, found by position: a lambda would be called for every element of every row."""
    return F.col("outcomes.excess_return")[F.array_position(F.col("outcomes.horizon"), horizon) - 1]


_LIMB = 1 << 30


def exact_sum(value: Column) -> Column:
    """The sum of doubles, each first taken to 60 binary places: exact, so it does not depend on the order or the partitions.

    Two runs on clusters of different size fit the same weights and seal the same packet. Each value is cut into four whole
    numbers of 30 bits, the first larger, whose sums stay inside a bigint for 2 ** 32 rows; decimals would cost a parse of the
    number's text and a new object a row. Values stay below 10 ** 20; the laboratory's results are rounded to 12 places.
    """
    limb = F.lit(float(_LIMB))
    # NaN and infinity count as null and a larger number fails, as casts to decimal(38,18) do.
    value = F.when(F.abs(value) < 1e20, value).otherwise(value.cast("decimal(38,18)").cast("double"))
    high = (value / limb).cast("bigint")
    rest = value - high * limb
    whole = rest.cast("bigint")
    part = (rest - whole) * limb
    low = part.cast("bigint")
    tail = F.rint((part - low) * limb).cast("bigint")
    s_high, s_whole, s_low, s_tail = (F.sum(x) for x in (high, whole, low, tail))
    carried = s_whole + F.call_function("div", s_low, F.lit(_LIMB))
    return (s_high * limb + carried) + ((s_low % _LIMB) / limb + s_tail / (limb * limb))


def base_weights(training: DataFrame) -> DataFrame:
    """Per horizon and factor: sum of value x outcome, scaled to unit absolute mass."""
    per_factor = (
        training.select("factors", F.explode(F.array(F.struct(*[_outcome(h).alias(h) for h in HORIZONS]))).alias("_y"))
        .select(F.explode("factors").alias("f"), "_y.*")
        .groupBy(F.col("f.factor_id").alias("factor_id"))
        .agg(*[exact_sum(F.col("f.value") * F.col(h)).alias(h) for h in HORIZONS])
    )
    long = per_factor.unpivot(["factor_id"], list(HORIZONS), "horizon", "raw_weight")
    mass = long.groupBy("horizon").agg(exact_sum(F.abs("raw_weight")).alias("mass"))
    return long.join(F.broadcast(mass), "horizon").select(
        "horizon", "factor_id", "raw_weight",
        F.coalesce(F.try_divide("raw_weight", "mass"), F.lit(0.0)).alias("base_weight"),
    )


def event_scores(events: DataFrame, weights: DataFrame, column: str, carried: list[Column]) -> DataFrame:
    """Per event a ``score_<horizon>`` for every horizon: factor values times weights, unlisted factors counting nothing.

    The weights meet the exploded factors in a join on the factor, whatever
    their number; sums combine before the one shuffle by event.
    """
    wide = weights.groupBy("factor_id").agg(*[F.sum(F.when(F.col("horizon") == h, F.col(column))).alias(f"_w{i}") for i, h in enumerate(HORIZONS)])
    # Only the carried columns and the factors leave the nested rows.
    rows = events.select(*carried, F.explode_outer("factors").alias("_f"))
    names = [c for c in rows.columns if c != "_f"]
    met = rows.withColumn("factor_id", F.col("_f.factor_id")).join(wide, "factor_id", "left")
    sums = [exact_sum(F.coalesce(F.col("_f.value") * F.col(f"_w{i}"), F.lit(0.0))).alias(f"score_{h}") for i, h in enumerate(HORIZONS)]
    return met.groupBy("event_id").agg(*[F.first(n).alias(n) for n in names if n != "event_id"], *sums)


def fit_and_calibrate(training: DataFrame, validation: DataFrame) -> DataFrame:
    """Calibrated weights ``(horizon, factor_id, base_weight, validation_scale, weight)``."""
    base = materialise(base_weights(training))
    scored = event_scores(validation, base, "base_weight", [F.col("event_id"), *[_outcome(h).alias(f"y_{h}") for h in HORIZONS]])
    s, y = (lambda h: F.col(f"score_{h}")), (lambda h: F.col(f"y_{h}"))
    sums = scored.agg(*[exact_sum(s(h) * y(h)).alias(f"{h}_sy") for h in HORIZONS], *[exact_sum(s(h) * s(h)).alias(f"{h}_ss") for h in HORIZONS])
    scale = [
        F.struct(F.lit(h).alias("horizon"), F.greatest(F.lit(-SCALE_LIMIT), F.least(
            F.lit(SCALE_LIMIT), F.coalesce(F.try_divide(F.col(f"{h}_sy"), F.col(f"{h}_ss")), F.lit(0.0)))).alias("scale"))
        for h in HORIZONS]
    scales = sums.select(F.inline(F.array(*scale)))
    return base.join(F.broadcast(scales), "horizon").select(
        "horizon", "factor_id", "base_weight",
        F.bround("scale", 12).alias("validation_scale"),
        F.bround(F.col("base_weight") * F.col("scale"), 12).alias("weight"),
    )


def blind_holdout(split: DataFrame) -> DataFrame:
    return split.where("split = 'HOLDOUT'").select(
        "event_id", "official_code", "prediction_at", "cohort", "factors"
    )


def outcome_vault(split: DataFrame) -> DataFrame:
    return split.where("split = 'HOLDOUT'").select("event_id", F.explode("outcomes").alias("o")).select(
        "event_id", "o.horizon", "o.excess_return", "o.known_at"
    )


def direction(value: Column) -> Column:
    return F.when(value > FLAT_BAND, "UP").when(value < -FLAT_BAND, "DOWN").otherwise("FLAT")


def predict(blind: DataFrame, weights: DataFrame) -> DataFrame:
    """One prediction per blind event and horizon."""
    keys = ["event_id", "official_code", "cohort", "prediction_at"]
    scored = event_scores(blind, weights, "weight", [F.col(k) for k in keys])
    rows = scored.select(*keys, F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"score_{h}").alias("raw")) for h in HORIZONS])))
    return rows.select(*keys, "horizon", F.bround("raw", 12).alias("score"), direction(F.col("raw")).alias("direction"))


def seal(predictions: DataFrame, run_id: str) -> DataFrame:
    """The seal row stored beside the packet before any outcome is read."""
    return table_digest(predictions).select(
        F.lit(run_id).alias("run_id"), "row_count", F.col("table_sha256").alias("seal_sha256")
    )


def verify_seal(predictions: DataFrame, seal_row: DataFrame, run_id: str) -> bool:
    now = seal(predictions, run_id).first()
    then = seal_row.first()
    return then is not None and now["seal_sha256"] == then["seal_sha256"]


def _measures() -> list[Column]:
    return [
        F.count("*").alias("event_count"),
        F.bround(exact_sum(F.abs(F.col("score") - F.col("excess_return"))) / F.count(F.col("score") - F.col("excess_return")), 12).alias("mean_absolute_error"),
        F.bround(F.avg((F.col("direction") == direction(F.col("excess_return"))).cast("double")), 12).alias("directional_hit_rate"),
    ]


def run_nightly(events: DataFrame, run_id: str, run_at: Column, **gate) -> dict[str, DataFrame]:
    """The whole laboratory; stops at the gate or at any contract breach."""
    events = materialise(events)
    checked = check_cutoffs(events, run_at)
    problems = R.issues(checked, "nightly_cutoffs", "event_id")
    prepared = cohort_gate(checked, **gate)
    first = prepared.first()
    result = {"gate": prepared, "issues": problems}
    if first["status"] == "STOP_TRAINING" or first["breach_count"]:
        return result
    split = temporal_split(events)
    problems = split_problems(split)
    if problems.limit(1).count():
        return {**result, "issues": problems}
    weights = materialise(
        fit_and_calibrate(split.where("split = 'TRAINING'"), split.where("split = 'VALIDATION'"))
    )
    # Packet, vault and both seals are stored tables: a seal must not be recomputed from what it guards.
    packet = materialise(predict(blind_holdout(split), weights))
    vault = materialise(outcome_vault(split))
    return {
        **result,
        "split": split,
        "weights": weights,
        "predictions": packet,
        "seal": materialise(seal(packet, run_id)),
        "vault": vault,
        "vault_seal": materialise(seal(vault, run_id)),
    }


def score_nightly(run: dict[str, DataFrame], run_id: str, scored_at: Column) -> DataFrame:
    """Open the vault only for an intact packet with the exact denominator.

    One full outer join carries the mismatch count, the late outcomes and the
    sums of every horizon; the first two are checked before the rest is shown.
    """
    if not verify_seal(run["predictions"], run["seal"], run_id):
        raise ValueError("SEALED_PACKET_TAMPERED")
    if not verify_seal(run["vault"], run["vault_seal"], run_id):
        raise ValueError("OUTCOME_VAULT_TAMPERED")
    joined = run["predictions"].withColumn("_p", F.lit(True)).join(run["vault"].withColumn("_v", F.lit(True)), ["event_id", "horizon"], "full_outer")
    sums = materialise(joined.groupBy("horizon").agg(
        F.count_if(F.col("_p").isNull() | F.col("_v").isNull()).alias("mismatch"), F.count_if(F.col("known_at") > scored_at).alias("late"), *_measures()))
    found = sums.agg(F.sum("mismatch").alias("mismatch"), F.sum("late").alias("late")).first()
    if found["mismatch"]:
        raise ValueError("HOLDOUT_PREDICTION_OUTCOME_DENOMINATOR_MISMATCH")
    if found["late"]:
        raise ValueError("HOLDOUT_OUTCOME_NOT_YET_AVAILABLE")
    return sums.drop("mismatch", "late")


def purge_training(training: DataFrame, test: DataFrame, embargo_days: int) -> DataFrame:
    """Training samples with ``kept`` and the reasons of the removed ones.

    A sample stays only if its whole information interval ends before the first
    held-out cutoff. Overlap with any held-out interval implies the opposite, so
    two scalars of the test side decide everything and no interval join is run.
    """
    edge = test.agg(F.min("feature_cutoff").alias("start"), F.max("label_end").alias("end")).first()
    if edge["start"] is None:
        raise ValueError("test samples are required")
    start, end = [F.lit(edge[k]).cast("timestamp") for k in ("start", "end")]
    late = F.col("label_end") >= start
    embargoed = (F.col("feature_cutoff") > end) & (F.col("feature_cutoff") <= end + F.expr(f"INTERVAL {int(embargo_days)} DAYS"))
    reasons = R.code_array(R.never("NOT_STRICTLY_PRIOR", late), R.never("IN_EMBARGO", embargoed))
    return training.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0)


def assert_causal(training: DataFrame, test: DataFrame) -> None:
    """Raise when a training sample reaches the first held-out cutoff."""
    if purge_training(training, test, 0).where("NOT kept").limit(1).count():
        raise ValueError("training label intervals overlap test boundary")
