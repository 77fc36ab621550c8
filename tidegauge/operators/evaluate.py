"""Forecast evaluation: ranks, information coefficients, returns, precision and recall.

A decision may cover any number of securities, so ranks come from global range
sorts and top-k from limited windows (Spark prunes those map-side); everything
else is a two-level aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.operators.ordering import average_ranks, positions

# Fixed values.
WILSON_Z = 1.959963984540054
TARGET_RULES = ("NET_EXCESS_GT_0", "GROSS_RETURN_GTE_5", "GROSS_RETURN_GTE_10", "TOTAL_AND_EXCESS_GT_0",
                "GROSS_ADJUSTED_RETURN_GT_0")
COST_FIELDS = ("fees_return", "spread_return", "slippage_return", "market_impact_return")
HEURISTIC_WEIGHTS = {
    "relative_return_5d": 0.25, "relative_return_20d": 0.15, "relative_value_20d": 0.20,
    "relative_volume_20d": 0.15, "official_event_net_30d": 0.15, "liquidity_percentile": 0.10,
}
MINIMUM_FEATURE_COVERAGE = 0.67


def outcome_returns(rows: DataFrame) -> DataFrame:
    """Comparable and executed returns of a prediction joined to its outcome."""
    benchmark = F.try_divide("benchmark_exit_value", "benchmark_entry_value") - 1.0
    cash = F.col("cash_distribution_return")
    factor = F.col("price_adjustment_factor")
    gross = F.try_divide(F.col("market_exit_price") * factor, F.col("market_entry_price")) - 1.0 + cash
    executed = F.try_divide(F.col("executed_exit_price") * factor, F.col("executed_entry_price")) - 1.0 + cash
    cost = F.lit(0.0)
    for c in COST_FIELDS:
        cost = cost + F.col(c)
    filled = F.col("selected") & (F.col("fill_status") == "FILLED")
    held = F.col("selected") & (F.col("fill_status") == "NOT_FILLED")
    rule = F.col("target_rule")
    net = gross - benchmark
    realised = (
        F.when(rule == "NET_EXCESS_GT_0", net > 0)
        .when(rule == "GROSS_RETURN_GTE_5", gross >= 0.05)
        .when(rule == "GROSS_RETURN_GTE_10", gross >= 0.10)
        .when(rule == "TOTAL_AND_EXCESS_GT_0", (gross > 0) & (net > 0))
        .when(rule == "GROSS_ADJUSTED_RETURN_GT_0", gross > 0)
    )
    return rows.withColumns({
        "comparable_gross": gross,
        "benchmark_return": benchmark,
        "comparable_net_excess": net,
        "executed_gross": F.when(filled, executed).when(held, 0.0),
        "executed_net_excess": F.when(filled, executed - benchmark - cost).when(held, -benchmark),
        "event_realised": realised,
    })


def match_outcomes(predictions: DataFrame, outcomes: DataFrame, fields: Sequence[str], keys=("decision_id", "code")) -> DataFrame:
    """Prediction against outcome or ledger by key, one code per differing field."""
    keys = list(keys)
    p = predictions.select(*keys, *[F.col(f).alias(f"p_{f}") for f in fields]).withColumn("_p", F.lit(True))
    o = outcomes.select(*keys, *[F.col(f).alias(f"o_{f}") for f in fields]).withColumn("_o", F.lit(True))
    both = F.col("_p").isNotNull() & F.col("_o").isNotNull()
    rules = [
        R.never("OUTCOME_MISSING", F.col("_o").isNull()),
        R.never("OUTCOME_WITHOUT_PREDICTION", F.col("_p").isNull()),
    ] + [R.never(f"MISMATCH:{f}", both & ~F.col(f"p_{f}").eqNullSafe(F.col(f"o_{f}"))) for f in fields]
    return R.check(p.join(o, keys, "full_outer"), *rules).select(*keys, "issue_codes")


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation that is NULL for fewer than two rows or no variance."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(x) >= 2) & (spread > 0), F.try_divide(F.covar_pop(x, y), spread))


def rank_ics(
    rows: DataFrame, score: str, outcomes: dict[str, str], group: Sequence[str] = ("decision_id",), key: str = "code",
) -> DataFrame:
    """Spearman correlation of a score with several outcomes per decision, ties sharing their mean rank.

    Score and outcomes are ranked together, as measures of one long table, in a
    single global sort. Returns the group, ``scored_<name>`` and ``<name>`` per
    outcome.
    """
    group = list(group)
    names = list(outcomes)
    scored = rows.where(F.col(score).isNotNull()).select(
        *group, key, F.col(score).cast("double").alias("_score"), *[F.col(c).cast("double").alias(n) for n, c in outcomes.items()])
    long = scored.unpivot([*group, key], ["_score", *names], "_measure", "_value").where("_value IS NOT NULL")
    ranked = average_ranks(long, "_value", [*group, "_measure"], "_rank", [key])
    wide = ranked.groupBy(*group, key).agg(*[F.max(F.when(F.col("_measure") == m, F.col("_rank"))).alias(f"_r_{m}") for m in ("_score", *names)])
    paired = wide.select(*group, *[c for n in names for c in (
        F.when(F.col(f"_r_{n}").isNotNull(), F.col("_r__score")).alias(f"_s_{n}"), F.col(f"_r_{n}").alias(f"_o_{n}"))])
    return paired.groupBy(*group).agg(*[c for n in names for c in (
        F.count(f"_o_{n}").alias(f"scored_{n}"), guarded_corr(f"_s_{n}", f"_o_{n}").alias(n))])


def rank_ic(rows: DataFrame, score: str, outcome: str, group: Sequence[str] = ("decision_id",), key: str = "code") -> DataFrame:
    """Spearman correlation of score and one outcome per decision."""
    return rank_ics(rows, score, {"rank_ic": outcome}, group, key).withColumnRenamed("scored_rank_ic", "scored")


def actual_top_k(rows: DataFrame, value: str, k: int, group: str = "decision_id", key: str = "code") -> DataFrame:
    """The k best realised rows per decision; the window limit is pushed below the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(value), F.asc(key))
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).withColumnRenamed("_rn", "actual_rank")


def recall_at_k(rows: DataFrame, value: str, k: int, group: str = "decision_id") -> DataFrame:
    return actual_top_k(rows, value, k, group).groupBy(group).agg(
        (F.count_if(F.col("selected") & ~F.col("abstained")) / F.count("*")).alias("recall")
    )


def evaluate_forecasts(rows: DataFrame, top_k: int = 5) -> DataFrame:
    """One row of metrics over rows carrying ``outcome_returns`` columns.

    Means over decisions come from per-decision aggregates, means over rows
    from row sums, so no decision is ever collected.
    """
    chosen = F.col("selected") & ~F.col("abstained")
    per_decision = rows.groupBy("decision_id").agg(
        F.count("*").alias("rows"),
        F.count_if("abstained").alias("abstained"),
        F.count_if(chosen).alias("selected"),
        F.count_if(chosen & F.col("event_realised")).alias("hits"),
        F.count_if(chosen & (F.col("fill_status") == "NOT_FILLED")).alias("nonfills"),
        F.sum(F.when(chosen, F.col("executed_net_excess"))).alias("executed_sum"),
        F.count(F.when(chosen, F.col("executed_net_excess"))).alias("executed_n"),
        F.sum(F.pow(F.col("probability") - F.col("event_realised").cast("double"), 2.0)).alias("brier_sum"),
        F.count("probability").alias("brier_n"),
    )
    ics = rank_ic(rows.where(~F.col("abstained")), "score", "comparable_net_excess").select("decision_id", "rank_ic")
    recalls = recall_at_k(rows, "comparable_net_excess", top_k)
    joined = per_decision.join(ics, "decision_id", "left").join(recalls, "decision_id", "left")
    return joined.agg(
        F.count("*").alias("decision_dates"),
        F.sum("rows").alias("denominator_rows"),
        F.try_divide(F.sum("abstained"), F.sum("rows")).alias("abstention_rate"),
        F.avg("rank_ic").alias("mean_rank_ic"),
        F.avg(F.when(F.col("selected") > 0, F.col("hits") / F.col("selected"))).alias("mean_precision_selected"),
        F.avg("recall").alias("mean_recall_at_k"),
        F.try_divide(F.sum("executed_sum"), F.sum("executed_n")).alias("mean_selected_executed_net_excess"),
        F.sum("selected").alias("selected_count"),
        F.try_divide(F.sum("nonfills"), F.sum("selected")).alias("non_fill_rate"),
        F.try_divide(F.sum("brier_sum"), F.sum("brier_n")).alias("brier_score"),
        F.sum("brier_n").alias("probability_rows"),
    )


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Two-sided 95% Wilson bounds, clamped to the unit interval."""
    z2 = WILSON_Z * WILSON_Z
    p = F.try_divide(hits, n)
    scale = 1.0 + F.try_divide(F.lit(z2), n)
    centre = (p + F.try_divide(F.lit(z2 / 2.0), n)) / scale
    margin = F.lit(WILSON_Z) * F.sqrt(F.try_divide(p * (1.0 - p), n) + F.try_divide(F.lit(z2 / 4.0), n * n)) / scale
    return F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)


def replay_metrics(rows: DataFrame, top_k: int, minimum_effective: int) -> DataFrame:
    """Session-replay metrics over ``gross, net, market_excess, sector_excess`` rows; one row.

    Every metric is NULL unless enough decisions select something.
    """
    chosen = F.col("selected")
    labels = {"primary": "gross", "actionable": "net", "market": "market_excess", "sector": "sector_excess"}
    per = rows.groupBy("decision_id").agg(
        F.count("*").alias("rows"), F.count_if(chosen).alias("selected"),
        *[F.count_if(chosen & (F.col(v) > 0)).alias(f"{k}_hits") for k, v in labels.items()],
        *[F.sum(F.when(chosen, F.col(v))).alias(f"{k}_sum") for k, v in labels.items()],
        F.count_if(chosen & (F.col("rank") == 1)).alias("top1"),
        F.count_if(chosen & (F.col("rank") == 1) & (F.col("gross") > 0)).alias("top1_hits"),
    )
    live = rows.where(~F.col("abstained"))
    per = per.join(rank_ics(live, "score", {f"{k}_ic": labels[k] for k in ("primary", "market", "sector")}), "decision_id", "left")
    per = per.join(recall_at_k(rows, "gross", top_k), "decision_id", "left")
    total = per.agg(
        F.count("*").alias("decision_sessions"), F.count_if(F.col("selected") > 0).alias("effective_decisions"),
        F.sum("rows").alias("denominator_rows"), F.sum("selected").alias("selected_rows"),
        F.sum("top1").alias("top1_rows"), F.sum("top1_hits").alias("top1_hits"),
        *[F.sum(f"{k}_hits").alias(f"{k}_hits") for k in labels],
        *[F.sum(f"{k}_sum").alias(f"{k}_sum") for k in labels],
        F.avg("recall").alias("recall"), *[F.avg(f"{k}_ic").alias(f"{k}_ic") for k in ("primary", "market", "sector")],
    )
    ok = (F.col("effective_decisions") >= minimum_effective) & (F.col("selected_rows") > 0)
    n = F.col("selected_rows")
    lo, hi = wilson(F.col("primary_hits"), n)
    t_lo, t_hi = wilson(F.col("top1_hits"), F.col("top1_rows"))
    shown = {
        "primary_agreement": F.try_divide(F.col("primary_hits"), n), "primary_wilson_low": lo, "primary_wilson_high": hi,
        "top1_agreement": F.try_divide(F.col("top1_hits"), F.col("top1_rows")), "top1_wilson_low": t_lo, "top1_wilson_high": t_hi,
        "actionable_rate": F.try_divide(F.col("actionable_hits"), n), "market_rate": F.try_divide(F.col("market_hits"), n),
        "sector_rate": F.try_divide(F.col("sector_hits"), n),
        "mean_gross": F.try_divide(F.col("primary_sum"), n), "mean_net": F.try_divide(F.col("actionable_sum"), n),
        "mean_market_excess": F.try_divide(F.col("market_sum"), n), "mean_sector_excess": F.try_divide(F.col("sector_sum"), n),
        "mean_recall_at_k": F.col("recall"), "mean_primary_rank_ic": F.col("primary_ic"),
        "mean_market_rank_ic": F.col("market_ic"), "mean_sector_rank_ic": F.col("sector_ic"),
    }
    return total.select(
        "decision_sessions", "effective_decisions", "denominator_rows", "selected_rows",
        *[F.when(ok, c).alias(name) for name, c in shown.items()],
    )


def heuristic_rank(rows: DataFrame, top_k: int, minimum_coverage: float = MINIMUM_FEATURE_COVERAGE, group: str = "decision_id") -> DataFrame:
    """Weighted feature score, abstain below coverage, rank by (score desc, code), top-k flag."""
    present, score = F.lit(0), F.lit(0.0)
    for name, weight in HEURISTIC_WEIGHTS.items():
        present = present + F.col(name).isNotNull().cast("int")
        score = score + F.coalesce(F.col(name) * weight, F.lit(0.0))
    coverage = present / F.lit(float(len(HEURISTIC_WEIGHTS)))
    scored = rows.withColumn("feature_coverage", coverage).withColumn(
        "score", F.when(F.col("feature_coverage") >= minimum_coverage, score)
    )
    placed = positions(scored, [F.desc_nulls_last("score"), F.asc("code")], [group], "_p")
    abstained = F.col("score").isNull()
    return placed.withColumns({
        "abstained": abstained,
        "rank": F.when(~abstained, F.col("_p")),
        "selected": ~abstained & (F.col("_p") <= top_k),
        "decision_status": F.when(abstained, "ABSTAIN").otherwise("DETECTED"),
    }).drop("_p")


def check_ranks(rows: DataFrame, top_k: int, group: str = "decision_id") -> DataFrame:
    """Supplied ranks must be the positions by (score desc, code), selected exactly the first k."""
    placed = positions(rows, [F.desc_nulls_last("score"), F.asc("code")], [group], "_p")
    expected = F.when(F.col("score").isNotNull(), F.col("_p"))
    return R.check(
        placed,
        R.never("RANK_NOT_DERIVED_FROM_SCORE", ~F.col("rank").eqNullSafe(expected)),
        R.never("SELECTED_NOT_TOP_K", F.col("selected") != F.coalesce(expected <= top_k, F.lit(False))),
    ).drop("_p")
