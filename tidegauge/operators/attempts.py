"""Attempt logs of source searches: the order of attempts, the outcome of each route, and the report made from them.

A run of at most ``RUN_ROWS`` rows is checked inside its own group, so its log is shuffled once, by run. In a longer run a row
finds the rows before it by joining on ``event_seq``, one row to one row: a run that holds most of the log is checked by
all tasks alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.session import broadcast_if_small, materialise

# Fixed values.
NEXT_STRATEGY = ("NEXT_EMPTY_STRATEGY", "NEXT_STRATEGY_AFTER_TRANSIENT_EXHAUSTED", "NEXT_REJECTED_STRATEGY")
LAST_STRATEGY = 4
BOUND_FIELDS = ("wave_id", "source_id", "route_id", "strategy_id", "strategy_ordinal", "attempt_ordinal", "window_from", "window_to", "final_url")
ROUTE = ("run_id", "source_id", "route_id")
COMPLETE = ("QUALIFIED", "ZERO_RESULT")
RUN_ROWS = 512  # log rows, reported sources or waves of a run that is checked in one group
KEPT = ("event_type", "retry_disposition", *BOUND_FIELDS)


def _apart(log: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """Groups whose rows do not follow each other."""
    spread = log.groupBy(*keys).agg((F.max("event_seq") - F.min("event_seq") + 1 != F.count("*")).alias(name))
    return spread.where(name)


def _steps(p: Callable[[str], Column], q: Callable[[str], Column]) -> Column:
    """How a row follows the two rows before it, given as ``p`` (one before) and ``q`` (two before)."""
    def same_route(row: Callable[[str], Column]) -> Column:
        return F.coalesce((row("source_id") == F.col("source_id")) & (row("route_id") == F.col("route_id")), F.lit(False))

    # The capture attempt before this one in its route; a control event between them is passed over.
    direct = same_route(p) & (p("event_type") == "CAPTURE_ATTEMPT")
    over = same_route(p) & (p("event_type") != "CAPTURE_ATTEMPT") & same_route(q) & (q("event_type") == "CAPTURE_ATTEMPT")

    def last(column: str) -> Column:
        return F.when(direct, p(column)).when(over, q(column))

    attempt, begun = F.col("event_type") == "CAPTURE_ATTEMPT", F.coalesce(direct | over, F.lit(False))
    strategy, tried, step = F.col("strategy_ordinal"), F.col("attempt_ordinal"), last("retry_disposition")
    bound = F.lit(True)
    for c in BOUND_FIELDS:
        bound = bound & F.col(c).eqNullSafe(p(c))
    return F.struct(
        p("wave_id").alias("wave"),
        (attempt & ~begun & ((strategy != 1) | (tried != 1))).alias("start"),
        (attempt & begun & (strategy == last("strategy_ordinal")) & ((step != "RETRY_TRANSIENT") | (tried != last("attempt_ordinal") + 1))).alias("retry"),
        (attempt & begun & (strategy == last("strategy_ordinal") + 1) & (~step.isin(*NEXT_STRATEGY) | (tried != 1))).alias("next"),
        (attempt & begun & ~(strategy - last("strategy_ordinal")).isin(0, 1)).alias("gap"),
        (~attempt & ~F.coalesce((p("event_type") == "CAPTURE_ATTEMPT") & (p("retry_disposition") == "RETRY_TRANSIENT") & bound, F.lit(False))).alias("unbound"))


def _joined(log: DataFrame, sources: DataFrame, waves: DataFrame) -> DataFrame:
    """Rows of runs of any length with their steps and the facts of their groups, by joins."""
    def before(steps: int, prefix: str) -> DataFrame:
        return log.select("run_id", (F.col("event_seq") + steps).alias("event_seq"), *[F.col(c).alias(f"{prefix}{c}") for c in KEPT])

    side = sources.select("run_id", "source_id", F.col("wave_id").alias("_wave"), F.col("window_from").alias("_from"), F.col("window_to").alias("_to"), F.lit(True).alias("_known"))
    ordinals = waves.select("run_id", "wave_id", F.col("ordinal").alias("_ordinal"))
    earlier = waves.select("run_id", F.col("wave_id").alias("p_wave_id"), F.col("ordinal").alias("_ordinal_before"))
    renamed = log.where("event_type = 'CAPTURE_ATTEMPT'").groupBy("run_id", "strategy_ordinal").agg(
        (F.count_distinct("strategy_id") > 1).alias("_renamed")).where("_renamed")
    at = ["run_id", "event_seq"]
    steps = _steps(lambda c: F.col(f"p_{c}"), lambda c: F.col(f"q_{c}"))
    placed = log.join(before(1, "p_"), at, "left").join(before(2, "q_"), at, "left").select(*log.columns, "p_wave_id", steps.alias("_step"))
    return (
        placed.join(side, ["run_id", "source_id"], "left").join(ordinals, ["run_id", "wave_id"], "left").join(earlier, ["run_id", "p_wave_id"], "left")
        .join(_apart(log, ("run_id", "source_id"), "_source_apart"), ["run_id", "source_id"], "left")
        .join(_apart(log, ROUTE, "_route_apart"), list(ROUTE), "left").join(renamed, ["run_id", "strategy_ordinal"], "left"))


def _grouped(log: DataFrame, sources: DataFrame, waves: DataFrame) -> DataFrame:
    """The same for runs of at most ``RUN_ROWS`` rows, sources and waves: all is looked up inside the run.

    Numbers, sources and waves that repeat multiply a row as the joins do.
    """
    recent = F.collect_list(F.struct("event_seq", *KEPT)).over(Window.partitionBy("run_id").orderBy("event_seq").rangeBetween(-2, -1))
    recent = F.when(F.col("event_seq").isNotNull(), recent)

    def back(steps: int) -> Column:
        found = F.filter("_recent", lambda r: r["event_seq"] == F.col("event_seq") - steps)
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.get(found, F.lit(0))))  # no row: one null

    steps = F.flatten(F.transform(back(1), lambda p: F.transform(back(2), lambda q: _steps(lambda c: p[c], lambda c: q[c]))))
    placed = log.withColumn("_recent", recent).select(*log.columns, steps.alias("_steps"))

    def over(value: Column, *keys: str) -> Column:
        found = value
        for k in keys:
            found = F.when(F.col(k).isNotNull(), found)
        return found

    in_source, in_route, in_strategy = [Window.partitionBy("run_id", *keys) for keys in (["source_id"], ["source_id", "route_id"], ["strategy_ordinal"])]

    def apart(w) -> Column:
        return F.max("event_seq").over(w) - F.min("event_seq").over(w) + 1 != F.count("*").over(w)

    name = F.when(F.col("event_type") == "CAPTURE_ATTEMPT", F.col("strategy_id"))
    placed = placed.withColumns({
        "_source_apart": over(apart(in_source), "source_id"), "_route_apart": over(apart(in_route), "source_id", "route_id"),
        "_renamed": over(F.min(name).over(in_strategy) != F.max(name).over(in_strategy), "strategy_ordinal")})
    listed = sources.groupBy("run_id").agg(F.collect_list(F.struct("source_id", "wave_id", "window_from", "window_to")).alias("_sources"))
    ranked = waves.groupBy("run_id").agg(F.collect_list(F.struct("wave_id", "ordinal")).alias("_waves"))
    facts = ["_source_apart", "_route_apart", "_renamed"]
    j = placed.join(listed, "run_id", "left").join(ranked, "run_id", "left").select(*log.columns, *facts, "_sources", "_waves", F.explode_outer("_steps").alias("_step"))
    j = j.withColumn("_side", F.explode_outer(F.filter("_sources", lambda s: s["source_id"] == F.col("source_id"))))
    j = j.withColumn("_own", F.explode_outer(F.filter("_waves", lambda w: w["wave_id"] == F.col("wave_id"))))
    j = j.withColumn("_before", F.explode_outer(F.filter("_waves", lambda w: w["wave_id"] == F.col("_step.wave"))))
    return j.select(
        *log.columns, "_step", *facts, F.col("_side.wave_id").alias("_wave"), F.col("_side.window_from").alias("_from"), F.col("_side.window_to").alias("_to"),
        F.when(F.col("_side").isNotNull(), F.lit(True)).alias("_known"), F.col("_own.ordinal").alias("_ordinal"), F.col("_before.ordinal").alias("_ordinal_before"))


def check_attempt_log(log: DataFrame, sources: DataFrame, waves: DataFrame) -> DataFrame:
    """Every row of ``log`` with its codes.

    ``log(run_id, event_seq, event_type, wave_id, source_id, route_id, strategy_id, strategy_ordinal, attempt_ordinal,
    window_from, window_to, final_url, retry_disposition, ...)``; ``event_type`` is CAPTURE_ATTEMPT or RETRY_CONTROL_EVENT.
    ``sources(run_id, source_id, wave_id, window_from, window_to)`` and ``waves(run_id, wave_id, ordinal)`` are the
    report's. A capture attempt continues the one before it in its route: as a retry if that was transient, as the next
    strategy if that was passed on; a control event binds to the transient attempt right before it.
    """
    # Runs too long for one group, and rows without a run: at most a key per RUN_ROWS rows.
    sized = [d.groupBy("run_id").agg(F.count("*").alias("n")).where((F.col("n") > RUN_ROWS) | F.col("run_id").isNull()).select("run_id") for d in (log, sources, waves)]
    long = materialise(sized[0].unionByName(sized[1]).unionByName(sized[2]).distinct().withColumnRenamed("run_id", "_run"))
    if not long.limit(1).count():
        j = _grouped(log, sources, waves)
    else:
        in_long, known = F.col("run_id").eqNullSafe(F.col("_run")), broadcast_if_small(long)
        codes = ["_step", "_wave", "_from", "_to", "_known", "_ordinal", "_ordinal_before", "_source_apart", "_route_apart", "_renamed"]
        j = _grouped(log.join(known, in_long, "left_anti"), sources.join(known, in_long, "left_anti"), waves.join(known, in_long, "left_anti")).unionByName(
            _joined(log.join(known, in_long, "left_semi"), sources, waves).select(*log.columns, *codes))
    attempt = F.col("event_type") == "CAPTURE_ATTEMPT"
    checked = R.check(
        j,
        R.must("ATTEMPT_SOURCE_UNREPORTED", F.col("_known")),
        R.never("ATTEMPT_WAVE_MISMATCH", F.col("_known") & ((F.col("wave_id") != F.col("_wave")) | F.col("_ordinal").isNull())),
        R.never("WAVE_ORDER_BACKWARD", F.col("_ordinal") < F.col("_ordinal_before")),
        R.never("ATTEMPT_WINDOW_MISMATCH", F.col("_known") & ~(F.col("window_from").eqNullSafe(F.col("_from")) & F.col("window_to").eqNullSafe(F.col("_to")))),
        R.never("SOURCE_ROWS_NOT_CONTIGUOUS", F.col("_source_apart")),
        R.never("ROUTE_ROWS_NOT_CONTIGUOUS", F.col("_route_apart")),
        R.never("STRATEGY_ORDINAL_RENAMED", attempt & F.col("_renamed")),
        R.never("ROUTE_START_NOT_ONE", F.col("_step.start")),
        R.never("RETRY_CONTRADICTS_DISPOSITION", F.col("_step.retry")),
        R.never("STRATEGY_CONTRADICTS_DISPOSITION", F.col("_step.next")),
        R.never("STRATEGY_NOT_CONTIGUOUS", F.col("_step.gap")),
        R.never("CONTROL_EVENT_UNBOUND", F.col("_step.unbound")))
    return checked.select(*log.columns, "issue_codes")


def route_outcomes(log: DataFrame, interrupted: DataFrame | None = None) -> DataFrame:
    """What each route came to: ``(run_id, source_id, route_id, wave_id, attempts, strategies, terminal, route_status, coverage_complete, issue_codes)``.

    ``log`` also has ``state, error_code, query_status, zero_result, qualified_items, quality_flags, has_content,
    content_sha256, proof_sha256``. Four strategies that each ended empty with a stored, proven and distinct answer are a
    zero result; otherwise the last attempt decides. A route must not end on a disposition that asks for more, except in
    ``interrupted(run_id, source_id)`` sources that ran out of budget.
    """
    attempts = log.where("event_type = 'CAPTURE_ATTEMPT'")
    shown = ["strategy_id", "strategy_ordinal", "retry_disposition", "state", "error_code", "query_status", "zero_result", "qualified_items", "quality_flags",
             "has_content", "content_sha256", "proof_sha256", "final_url"]
    ended = attempts.groupBy(*ROUTE, "strategy_ordinal").agg(F.count("*").alias("n"), F.max("event_seq").alias("seq"), F.max_by(F.struct(*shown), "event_seq").alias("x"))
    empty = (
        F.col("strategy_ordinal").between(1, LAST_STRATEGY) & (F.col("x.retry_disposition") == "NEXT_EMPTY_STRATEGY") & (F.col("x.state") == "AVAILABLE")
        & (F.col("x.query_status") == "ZERO_RESULT") & F.col("x.zero_result") & (F.col("x.qualified_items") == 0) & F.col("x.has_content")
        & (F.col("x.quality_flags") == 0) & (F.col("x.proof_sha256") == F.col("x.content_sha256")))
    empty = F.coalesce(empty, F.lit(False))
    routes = ended.groupBy(*ROUTE).agg(
        F.sum("n").alias("attempts"), F.count("*").alias("strategies"), F.max_by("x", "seq").alias("x"),
        (F.count_if(empty) == LAST_STRATEGY).alias("_four"), F.count_distinct(F.when(empty, F.col("x.proof_sha256"))).alias("_proofs"),
        F.count_distinct(F.when(empty, F.col("x.final_url"))).alias("_urls"))
    ends = log.groupBy(*ROUTE).agg(F.max_by("event_type", "event_seq").alias("_end"), F.min("wave_id").alias("wave_id"))
    j = routes.join(ends, list(ROUTE))
    if interrupted is None:
        j = j.withColumn("_excused", F.lit(False))
    else:
        j = j.join(interrupted.select("run_id", "source_id", F.lit(True).alias("_excused")).distinct(), ["run_id", "source_id"], "left")
    control, limited = F.col("_end") == "RETRY_CONTROL_EVENT", F.coalesce(F.col("x.error_code") == "HTTP_RATE_LIMITED", F.lit(False))
    zero = F.col("_four") & (F.col("_proofs") == LAST_STRATEGY) & (F.col("_urls") == LAST_STRATEGY)
    terminal = F.when(control, "STOP_SLEEPER_FAILURE").otherwise(F.col("x.retry_disposition"))
    status = (
        F.when(control, F.when(limited, "BLOCKED").otherwise("ERROR")).when(zero, "ZERO_RESULT").when(terminal == "STOP_QUALIFIED", "QUALIFIED")
        .when(terminal == "STOP_CAPTURE_PENDING_PARSER", "CAPTURED_PENDING_PARSER").when(terminal == "STOP_HARD_BLOCK", F.col("x.state"))
        .when(terminal.isin("STOP_RATE_LIMITED", "STOP_RETRY_BUDGET") & limited, "BLOCKED").otherwise("ERROR"))
    more = (terminal == "RETRY_TRANSIENT") | (terminal.isin(*NEXT_STRATEGY) & (F.col("x.strategy_ordinal") < LAST_STRATEGY))
    done = j.withColumns({"terminal": terminal, "route_status": status}).withColumn("coverage_complete", ~control & F.col("route_status").isin(*COMPLETE))
    return R.check(done, R.never("ROUTE_NOT_TERMINAL", ~control & more & ~F.coalesce("_excused", F.lit(False)))).select(
        *ROUTE, "wave_id", "attempts", "strategies", "terminal", "route_status", "coverage_complete", "issue_codes")


def reconcile_sources(routes: DataFrame, reported: DataFrame) -> DataFrame:
    """Reported sources against their routes.

    ``reported(run_id, source_id, status, attempt_count, route_count, completed_route_count, decision_at, watermark_before,
    initial_watermark, watermark_after, interrupted)``. A source is complete if all its routes are; then its watermark
    moves to the decision. An interrupted source keeps the watermark it had and may name more routes than it began.
    """
    has = lambda s: F.count_if(F.col("route_status") == s) > 0
    found = routes.groupBy("run_id", "source_id").agg(
        F.sum("attempts").alias("_attempts"), F.count("*").alias("_routes"), F.count_if("coverage_complete").alias("_completed"),
        F.bool_and("coverage_complete").alias("_all"), has("QUALIFIED").alias("_qualified"), has("CAPTURED_PENDING_PARSER").alias("_pending"),
        has("AUTH_REQUIRED").alias("_auth"), has("BLOCKED").alias("_blocked"))
    j = reported.join(found, ["run_id", "source_id"], "full_outer")
    cut = F.coalesce("interrupted", F.lit(False))
    complete = F.coalesce("_all", F.lit(False)) & ~cut
    expected = (
        F.when(complete, F.when(F.col("_qualified"), "QUALIFIED").otherwise("ZERO_RESULT")).when(F.col("_pending"), "CAPTURED_PENDING_PARSER")
        .when(F.col("_auth"), "AUTH_REQUIRED").when(F.col("_blocked"), "BLOCKED").otherwise("ERROR"))
    after = F.when(complete, F.col("decision_at")).when(cut, F.col("initial_watermark"))
    return R.check(
        j,
        R.never("ATTEMPTS_WITHOUT_REPORT", F.col("status").isNull()),
        R.never("ATTEMPT_COUNT_MISMATCH", F.col("status").isNotNull() & (F.col("attempt_count") != F.coalesce("_attempts", F.lit(0)))),
        R.never("ROUTE_COUNT_MISMATCH", F.col("status").isNotNull() & F.when(cut, F.col("route_count") < F.coalesce("_routes", F.lit(0))).otherwise(
            F.col("_routes").isNull() | (F.col("route_count") != F.col("_routes")))),
        R.never("COMPLETED_ROUTES_MISMATCH", ~cut & (F.col("completed_route_count") != F.coalesce("_completed", F.lit(0)))),
        R.never("SOURCE_STATUS_CONTRADICTS_ROUTES", F.col("_routes").isNotNull() & ~cut & (F.col("status") != expected)),
        R.never("WATERMARK_BEFORE_MISMATCH", F.col("status").isNotNull() & ~F.col("watermark_before").eqNullSafe(F.col("initial_watermark"))),
        R.never("WATERMARK_AFTER_CONTRADICTS_COVERAGE", F.col("status").isNotNull() & ~F.col("watermark_after").eqNullSafe(after)),
    ).select(*reported.columns, "issue_codes")


def reconcile_waves(sources: DataFrame, waves: DataFrame) -> DataFrame:
    """Reported waves against their sources.

    ``sources(run_id, wave_id, source_id, status, attempt_count)`` and ``waves(run_id, wave_id, ordinal, planned_sources,
    degraded_sources, attempt_count, status)``. Waves stopped by the budget are a suffix of the run, and nothing is
    reported after the first of them.
    """
    found = sources.groupBy("run_id", "wave_id").agg(
        F.count("*").alias("_sources"), F.count_if(~F.col("status").isin(*COMPLETE)).alias("_degraded"), F.sum("attempt_count").alias("_attempts"))
    stops = waves.where("status = 'BUDGET_STOPPED'").groupBy("run_id").agg(F.min("ordinal").alias("_stop"))
    j = waves.join(found, ["run_id", "wave_id"], "left").join(stops, "run_id", "left").na.fill(0, ["_sources", "_degraded", "_attempts"])
    stopped, later = F.coalesce(F.col("ordinal") >= F.col("_stop"), F.lit(False)), F.coalesce(F.col("ordinal") > F.col("_stop"), F.lit(False))
    expected = F.when(stopped, "BUDGET_STOPPED").when(F.col("planned_sources") == 0, "EMPTY").when(F.col("_degraded") > 0, "DEGRADED").otherwise("COMPLETE")
    return R.check(
        j,
        R.never("WAVE_ATTEMPT_COUNT_MISMATCH", F.col("attempt_count") != F.col("_attempts")),
        R.never("WAVE_SOURCES_MISMATCH", (~stopped & (F.col("_sources") != F.col("planned_sources"))) | (F.col("_sources") > F.col("planned_sources"))),
        R.never("WORK_AFTER_BUDGET_STOP", later & (F.col("_sources") + F.col("_attempts") > 0)),
        R.never("WAVE_DEGRADED_MISMATCH", F.col("degraded_sources") != F.when(later, F.col("planned_sources")).otherwise(F.col("_degraded"))),
        R.never("WAVE_STATUS_CONTRADICTS_SOURCES", F.col("status") != expected),
    ).select(*waves.columns, "issue_codes")
