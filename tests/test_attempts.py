"""Attempt logs: every code on a small log, route outcomes, sources and waves."""

from pyspark.sql import functions as F

from tidegauge.operators import attempts

LOG = ("run_id long, event_seq long, event_type string, wave_id string, source_id string, route_id string, strategy_id string, strategy_ordinal int, "
       "attempt_ordinal int, window_from string, window_to string, final_url string, retry_disposition string, state string, error_code string, "
       "query_status string, zero_result boolean, qualified_items int, quality_flags int, has_content boolean, content_sha256 string, proof_sha256 string")
A, C = "CAPTURE_ATTEMPT", "RETRY_CONTROL_EVENT"


def log(spark, rows, run=1):
    """``rows``: (type, source, route, strategy ordinal, attempt ordinal, disposition[, overrides])."""
    out = []
    for i, (kind, source, route, strategy, tried, disposition, *more) in enumerate(rows, 1):
        row = {"run_id": run, "event_seq": i, "event_type": kind, "wave_id": "w1", "source_id": source, "route_id": route, "strategy_id": f"s{strategy}",
               "strategy_ordinal": strategy, "attempt_ordinal": tried, "window_from": "a", "window_to": "b", "final_url": "u", "retry_disposition": disposition,
               "state": None, "error_code": None, "query_status": None, "zero_result": None, "qualified_items": None, "quality_flags": None, "has_content": None,
               "content_sha256": None, "proof_sha256": None} | (more[0] if more else {})
        out.append(tuple(row[n.split()[0]] for n in LOG.split(", ")))
    return spark.createDataFrame(out, LOG)


def codes(spark, rows):
    sources = spark.createDataFrame([(1, s, "w1", "a", "b") for s in ("x", "y")], "run_id long, source_id string, wave_id string, window_from string, window_to string")
    waves = spark.createDataFrame([(1, "w0", 0), (1, "w1", 1)], "run_id long, wave_id string, ordinal int")
    return [r.issue_codes for r in attempts.check_attempt_log(log(spark, rows), sources, waves).orderBy("event_seq").collect()]


def test_a_sound_log_has_no_codes(spark):
    rows = [(A, "x", "r1", 1, 1, "RETRY_TRANSIENT"), (A, "x", "r1", 1, 2, "NEXT_REJECTED_STRATEGY"), (A, "x", "r1", 2, 1, "STOP_QUALIFIED"),
            (A, "x", "r2", 1, 1, "RETRY_TRANSIENT"), (C, "x", "r2", 1, 1, None), (A, "y", "r1", 1, 1, "STOP_HARD_BLOCK")]
    assert codes(spark, rows) == [[]] * 6


def test_every_defect_has_its_code(spark):
    rows = [(A, "x", "r1", 1, 2, "NEXT_REJECTED_STRATEGY"), (A, "x", "r1", 1, 3, "RETRY_TRANSIENT"), (A, "x", "r1", 2, 1, "RETRY_TRANSIENT"),
            (A, "x", "r1", 4, 1, "STOP_QUALIFIED", {"window_from": "z"}), (C, "x", "r1", 4, 1, None), (A, "gone", "r1", 1, 1, "STOP_QUALIFIED"),
            (A, "x", "r9", 1, 1, "STOP_QUALIFIED", {"wave_id": "w0", "strategy_id": "other"})]
    got = codes(spark, rows)
    apart, renamed = "SOURCE_ROWS_NOT_CONTIGUOUS", "STRATEGY_ORDINAL_RENAMED"
    assert got == [
        [apart, renamed, "ROUTE_START_NOT_ONE"], [apart, renamed, "RETRY_CONTRADICTS_DISPOSITION"], [apart, "STRATEGY_CONTRADICTS_DISPOSITION"],
        ["ATTEMPT_WINDOW_MISMATCH", apart, "STRATEGY_NOT_CONTIGUOUS"], [apart, "CONTROL_EVENT_UNBOUND"], ["ATTEMPT_SOURCE_UNREPORTED", renamed],
        ["ATTEMPT_WAVE_MISMATCH", "WAVE_ORDER_BACKWARD", apart, renamed]]


def test_route_outcomes(spark):
    def empty(i, **more):
        x = {"state": "AVAILABLE", "query_status": "ZERO_RESULT", "zero_result": True, "qualified_items": 0, "quality_flags": 0, "has_content": True,
             "content_sha256": f"c{i}", "proof_sha256": f"c{i}", "final_url": f"u{i}"}
        return x | more

    rows = [(A, "x", "zero", i, 1, "NEXT_EMPTY_STRATEGY", empty(i)) for i in range(1, 5)]
    rows += [(A, "x", "twice", i, 1, "NEXT_EMPTY_STRATEGY", empty(i, final_url="same")) for i in range(1, 5)]
    rows += [(A, "x", "found", 1, 1, "STOP_QUALIFIED"), (A, "x", "auth", 1, 1, "STOP_HARD_BLOCK", {"state": "AUTH_REQUIRED"}),
             (A, "x", "slow", 1, 1, "STOP_RETRY_BUDGET", {"error_code": "HTTP_RATE_LIMITED"}), (A, "x", "lost", 1, 1, "STOP_RETRY_BUDGET"),
             (A, "x", "open", 1, 1, "RETRY_TRANSIENT"), (A, "x", "sleep", 1, 1, "RETRY_TRANSIENT", {"error_code": "HTTP_RATE_LIMITED"}), (C, "x", "sleep", 1, 1, None),
             (A, "x", "parse", 1, 1, "STOP_CAPTURE_PENDING_PARSER"), (A, "cut", "open", 1, 1, "NEXT_EMPTY_STRATEGY")]
    cut = spark.createDataFrame([(1, "cut")], "run_id long, source_id string")
    got = {(r.source_id, r.route_id): (r.route_status, r.coverage_complete, r.issue_codes) for r in attempts.route_outcomes(log(spark, rows), cut).collect()}
    assert got == {
        ("x", "zero"): ("ZERO_RESULT", True, []), ("x", "twice"): ("ERROR", False, []), ("x", "found"): ("QUALIFIED", True, []), ("x", "auth"): ("AUTH_REQUIRED", False, []),
        ("x", "slow"): ("BLOCKED", False, []), ("x", "lost"): ("ERROR", False, []), ("x", "open"): ("ERROR", False, ["ROUTE_NOT_TERMINAL"]),
        ("x", "sleep"): ("BLOCKED", False, []), ("x", "parse"): ("CAPTURED_PENDING_PARSER", False, []), ("cut", "open"): ("ERROR", False, [])}


def test_sources_and_waves_are_reconciled(spark):
    routes = attempts.route_outcomes(log(spark, [(A, "x", "r1", 1, 1, "STOP_QUALIFIED"), (A, "y", "r1", 1, 1, "STOP_HARD_BLOCK", {"state": "BLOCKED"}), (A, "z", "r1", 1, 1, "STOP_QUALIFIED")]))
    reported = spark.createDataFrame(
        [(1, "x", "QUALIFIED", 1, 1, 1, 9, 5, 5, 9, False), (1, "y", "ERROR", 2, 2, 1, 9, 4, 5, 9, False), (1, "cut", "ERROR", 0, 3, 0, 9, 5, 5, 5, True)],
        "run_id long, source_id string, status string, attempt_count long, route_count long, completed_route_count long, decision_at long, watermark_before long, "
        "initial_watermark long, watermark_after long, interrupted boolean")
    got = {r.source_id: r.issue_codes for r in attempts.reconcile_sources(routes, reported).collect()}
    assert got == {"x": [], "cut": [], "z": ["ATTEMPTS_WITHOUT_REPORT"], "y": [
        "ATTEMPT_COUNT_MISMATCH", "ROUTE_COUNT_MISMATCH", "COMPLETED_ROUTES_MISMATCH", "SOURCE_STATUS_CONTRADICTS_ROUTES", "WATERMARK_BEFORE_MISMATCH",
        "WATERMARK_AFTER_CONTRADICTS_COVERAGE"]}
    sources = spark.createDataFrame([(1, "a", "x", "QUALIFIED", 2), (1, "b", "y", "ERROR", 1), (1, "d", "q", "ERROR", 1)],
                                    "run_id long, wave_id string, source_id string, status string, attempt_count long")
    waves = spark.createDataFrame(
        [(1, "a", 1, 1, 0, 2, "COMPLETE"), (1, "b", 2, 2, 0, 3, "COMPLETE"), (1, "e", 3, 0, 0, 0, "EMPTY"), (1, "c", 4, 1, 0, 0, "BUDGET_STOPPED"), (1, "d", 5, 1, 1, 1, "EMPTY")],
        "run_id long, wave_id string, ordinal int, planned_sources long, degraded_sources long, attempt_count long, status string")
    got = {r.wave_id: r.issue_codes for r in attempts.reconcile_waves(sources, waves).collect()}
    assert got == {"a": [], "e": [], "c": [], "b": ["WAVE_ATTEMPT_COUNT_MISMATCH", "WAVE_SOURCES_MISMATCH", "WAVE_DEGRADED_MISMATCH", "WAVE_STATUS_CONTRADICTS_SOURCES"],
                   "d": ["WORK_AFTER_BUDGET_STOP", "WAVE_STATUS_CONTRADICTS_SOURCES"]}
    assert attempts.reconcile_waves(sources.where(F.lit(False)), waves.where(F.lit(False))).count() == 0


def test_runs_are_checked_alike_in_one_group_and_by_joins(spark, monkeypatch):
    import itertools

    rows = [(A, "x", f"r{i % 3}", 1 + i % 4, 1 + i % 2, d, {"wave_id": w}) for i, (d, w) in enumerate(itertools.product(("RETRY_TRANSIENT", "NEXT_REJECTED_STRATEGY", None), ("w0", "w1", None)))]
    rows += [(C, "x", "r2", 1, 1, None), (A, None, "r1", 1, 1, "STOP_QUALIFIED"), (A, "y", "r1", None, 1, "RETRY_TRANSIENT", {"strategy_id": "other"}), (A, "y", None, 1, 2, "STOP_QUALIFIED")]
    one = log(spark, rows)
    gap = one.where("event_seq <> 5").withColumn("run_id", F.lit(2).cast("long"))
    nothing = one.withColumn("run_id", F.lit(None).cast("long"))
    unplaced = one.where("event_seq < 4").withColumn("event_seq", F.lit(None).cast("long")).withColumn("run_id", F.lit(3).cast("long"))
    whole = one.unionByName(one.where("event_seq IN (3, 4, 9)")).unionByName(gap).unionByName(nothing).unionByName(unplaced).unionByName(one.withColumn("run_id", F.lit(3).cast("long")))
    sources = spark.createDataFrame([(r, s, "w1", "a", "b") for r in (1, 2, None) for s in ("x", "x", "y", None)], "run_id long, source_id string, wave_id string, window_from string, window_to string")
    waves = spark.createDataFrame([(r, w, i) for r in (1, 3) for i, w in enumerate(("w0", "w1", "w1"))], "run_id long, wave_id string, ordinal int")
    found = []
    for bound in (0, 512):  # all by joins, only rows without a run
        monkeypatch.setattr(attempts, "RUN_ROWS", bound)
        found.append(sorted(map(repr, attempts.check_attempt_log(whole, sources, waves).collect())))
    assert found[0] == found[1] and len(found[0]) > whole.count()


def test_short_runs_are_shuffled_once_by_run(spark):
    rows = log(spark, [(A, "x", "r1", 1, 1, "RETRY_TRANSIENT"), (A, "x", "r1", 1, 2, "STOP_QUALIFIED")])
    sources = spark.createDataFrame([(1, "x", "w1", "a", "b")], "run_id long, source_id string, wave_id string, window_from string, window_to string")
    waves = spark.createDataFrame([(1, "w1", 0)], "run_id long, wave_id string, ordinal int")
    plan = attempts.check_attempt_log(rows, sources, waves)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3, plan  # the log, the sources, the waves
