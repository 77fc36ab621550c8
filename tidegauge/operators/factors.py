"""Factor snapshots, admission and decision classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.session import broadcast_if_small

STATUSES = ("OBSERVED", "MISSING", "NOT_APPLICABLE", "REJECTED")
ADMITTED_RIGHTS = ("PUBLIC_RESEARCH_ALLOWED", "LICENSED_MODEL_USE")
REQUIRED_GATES = ("corporate_actions", "feature_snapshot", "identity", "pack", "policy_hash", "timing", "universe")


def check_inputs(inputs: DataFrame, registry: DataFrame, universe: DataFrame) -> DataFrame:
    """Factor inputs against the registry and the frozen universe.

    ``registry(factor_id, required, window_hours)``; ``universe(decision_id,
    code, decision_at)``.
    """
    reg = broadcast_if_small(registry.select("factor_id", F.lit(True).alias("_reg"), "window_hours"))
    u = universe.select("decision_id", "code", "decision_at")
    key = ["decision_id", "code", "factor_id"]
    repeated = inputs.groupBy(*key).agg(F.count("*").alias("_n"))
    joined = inputs.join(repeated, key).join(reg, "factor_id", "left").join(u, ["decision_id", "code"], "left")
    status = F.col("status")
    has_value = F.col("value_num").isNotNull() | F.col("value_enum").isNotNull()
    age = F.unix_micros("decision_at") - F.unix_micros("available_at")
    return R.check(
        joined,
        R.never("FACTOR_KEY_DUPLICATE", F.col("_n") > 1),
        R.must("FACTOR_UNKNOWN", F.col("_reg")),
        R.never("SECURITY_OUTSIDE_DENOMINATOR", F.col("decision_at").isNull()),
        R.must("FACTOR_STATUS_UNKNOWN", R.in_set("status", STATUSES)),
        R.never("MISSING_MUST_BE_EMPTY", (status == "MISSING") & (has_value | F.col("available_at").isNotNull())),
        R.never("STATUS_MUST_NOT_CARRY_VALUE", status.isin("NOT_APPLICABLE", "REJECTED") & has_value),
        R.never("OBSERVED_WITHOUT_VALUE", (status == "OBSERVED") & (~has_value | F.col("available_at").isNull())),
        R.never("LOOK_AHEAD_AVAILABILITY", age < 0),
        R.never("OUTSIDE_REGISTRY_WINDOW", (status != "REJECTED") & (age > F.col("window_hours") * F.lit(3_600_000_000))),
    ).drop("_n", "_reg", "window_hours")


def snapshot(universe: DataFrame, inputs: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per decision and security: status counts, required coverage, default disposition.

    Missing slots are counted as registry size minus supplied slots, so the
    security x registry grid is never built.
    """
    sizes = registry.agg(F.count("*").alias("n"), F.count_if("required").alias("r")).first()
    side = inputs.join(broadcast_if_small(registry.select("factor_id", "required")), "factor_id")
    status = F.col("status")
    counts = side.groupBy("decision_id", "code").agg(
        F.count_if(status == "OBSERVED").alias("o"), F.count_if(status == "NOT_APPLICABLE").alias("na"),
        F.count_if(status == "REJECTED").alias("rj"),
        F.count_if((status == "OBSERVED") & F.col("required")).alias("rq"),
        F.bool_or((F.col("factor_id") == "security_trading_status") & (status == "OBSERVED") & (F.col("value_enum") == "TRADING")).alias("trades"),
    )
    j = universe.join(counts, ["decision_id", "code"], "left").na.fill(0, ["o", "na", "rj", "rq"]).withColumn(
        "trades", F.coalesce("trades", F.lit(False))
    )
    coverage = F.col("rq") / F.lit(float(sizes["r"])) if sizes["r"] else F.lit(1.0)
    reason = (
        F.when(F.col("rj") > 0, "FACTOR_REJECTED").when(F.col("rq") < sizes["r"], "REQUIRED_FACTOR_MISSING")
        .when(~F.col("trades"), "SECURITY_NOT_TRADABLE").otherwise("DISPOSITION_NOT_SUPPLIED")
    )
    named = {
        "FACTOR_REJECTED": ("UNRESOLVED", "FACTOR_VALIDATION"), "REQUIRED_FACTOR_MISSING": ("ABSTAINED", "FACTOR_INPUTS"),
        "SECURITY_NOT_TRADABLE": ("REJECTED", "SECURITY_STATUS"), "DISPOSITION_NOT_SUPPLIED": ("UNRESOLVED", "DISPOSITION"),
    }
    look = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in named.items() for x in (k, v[i])]), F.col("reason_code"))
    return j.withColumn("reason_code", reason).select(
        "decision_id", "code", F.col("o").alias("observed"), (F.lit(sizes["n"]) - F.col("o") - F.col("na") - F.col("rj")).alias("missing"),
        F.col("na").alias("not_applicable"), F.col("rj").alias("rejected"), coverage.alias("required_coverage"),
        look(0).alias("disposition"), look(1).alias("first_failed_stage"), "reason_code",
    )


def recheck_snapshot(stored: DataFrame, universe: DataFrame, inputs: DataFrame, registry: DataFrame) -> DataFrame:
    """A stored snapshot against a recomputation: denominator and every count."""
    fields = ("observed", "missing", "not_applicable", "rejected", "required_coverage", "disposition", "reason_code")
    now = snapshot(universe, inputs, registry).select("decision_id", "code", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_now"))
    then = stored.withColumn("_then", F.lit(True))
    return R.check(
        then.join(now, ["decision_id", "code"], "full_outer"),
        R.never("SECURITY_MISSING_FROM_SNAPSHOT", F.col("_then").isNull()),
        R.never("SECURITY_NOT_IN_UNIVERSE", F.col("_now").isNull()),
        *[R.never(f"RECOUNT:{f}", F.col("_then") & F.col("_now") & ~F.col(f).eqNullSafe(F.col(f"_{f}"))) for f in fields],
    ).select("decision_id", "code", "issue_codes")


def admit_factors(uses: DataFrame, registry: DataFrame) -> DataFrame:
    """Factor uses (factor_id, known_at) against rights, testing and availability."""
    side = broadcast_if_small(registry.select("factor_id", F.lit(True).alias("_reg"), "rights_status", "point_in_time_tested", "available_from"))
    return R.check(
        uses.join(side, "factor_id", "left"),
        R.must("FACTOR_NOT_REGISTERED", F.col("_reg")),
        R.must("RIGHTS_NOT_ADMITTED", R.in_set("rights_status", ADMITTED_RIGHTS)),
        R.must("POINT_IN_TIME_UNTESTED", F.col("point_in_time_tested")),
        R.never("NOT_AVAILABLE_AT_KNOWN_AT", F.col("known_at") < F.col("available_from")),
    ).drop("_reg", "rights_status", "point_in_time_tested", "available_from")


def profiles() -> Column:
    """Speculative and investment profile classes of a feature row."""
    liquidity = F.upper(F.coalesce("liquidity_bucket", F.lit("UNKNOWN")))
    unit = lambda c: R.finite(c, 0, 1)
    speculative = (
        (unit("volatility_percentile") & (F.col("volatility_percentile") >= 0.75)) | liquidity.isin("THIN", "MICRO")
        | F.coalesce("discontinuity_flag", F.lit(False))
    )
    investment = (
        unit("fundamental_quality_score") & unit("balance_sheet_risk") & unit("cash_flow_quality")
        & (F.col("fundamental_quality_score") >= 0.60) & (F.col("balance_sheet_risk") <= 0.40)
        & (F.col("cash_flow_quality") >= 0.60) & liquidity.isin("HIGH", "MEDIUM")
    )
    found = R.code_array(R.never("SPECULATIVE_PROFILE", speculative), R.never("INVESTMENT_PROFILE", investment))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("UNCLASSIFIED_PROFILE")))


def classify_decisions(rows: DataFrame, safety_margin: float, execution_required: bool = True) -> DataFrame:
    """Decision ladder: gates, model, probability, edge, execution."""
    gates = [R.must(f"{g.upper()}_GATE_FAILED", F.col(f"gate_{g}")) for g in REQUIRED_GATES]
    executes = F.coalesce(F.col("execution_status") == "EXECUTABLE", F.lit(False))
    gap = F.col("expected_net_edge").isNull() | F.col("estimated_cost").isNull()
    model = R.must("MODEL_NOT_PROSPECTIVELY_VALIDATED", F.col("model_validated"))
    reasons = R.code_array(
        *gates, model,
        R.never("PROBABILITY_NOT_ALLOWED", F.col("probability").isNotNull() & ~F.coalesce("probability_allowed", F.lit(False))),
        R.never("EDGE_OR_COST_MISSING", gap),
        R.never("EDGE_NOT_ABOVE_COST_AND_MARGIN", F.col("expected_net_edge") <= F.col("estimated_cost") + safety_margin),
        R.never("EXECUTION_REQUIRED_AND_NOT_PASSED", F.lit(execution_required) & ~executes),
    )
    watch = F.exists("reason_codes", lambda r: r.endswith("_GATE_FAILED") | (r == "MODEL_NOT_PROSPECTIVELY_VALIDATED"))
    return rows.withColumn("reason_codes", reasons).withColumn("profile_classes", profiles()).withColumn(
        "decision_status",
        F.when((F.size("reason_codes") == 0) & executes, "HIGH_BUY_OPPORTUNITY")
        .when(F.size("reason_codes") == 0, "QUALIFIED_RESEARCH_NOT_YET_EXECUTABLE").when(watch, "WATCH").otherwise("ABSTAIN"),
    )
