"""Attempt logs from line items: each order is a run of one source, its lines the attempts, four to a route.

Defects are seeded by the order's number in columns that Spark and the oracle spell alike; what follows from them is
computed on either side on its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import attempts as at
from tidegauge.plans.record_queries import tally
from tidegauge.plans.views import table

PLACE = """SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS event_seq,
    count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem"""
STEPS = f"""SELECT *, (event_seq - 1) % 4 AS j, CAST(floor((event_seq - 1) / 4) + 1 AS BIGINT) AS route, event_seq = total OR event_seq % 4 = 0 AS ends,
    run_id % 61 = 0 AS empty, run_id % 37 = 0 AND event_seq = total AND event_seq > 1 AS control FROM ({PLACE}) place"""
ORDINALS = f"""SELECT *, CASE WHEN empty THEN j + 1 WHEN run_id % 17 = 0 AND event_seq = 3 THEN 4 WHEN control AND j = 2 THEN 1 ELSE CAST(floor(j / 2) + 1 AS BIGINT) END AS strategy_ordinal,
    CASE WHEN empty THEN 1 WHEN run_id % 11 = 0 AND event_seq = 2 THEN 3 WHEN run_id % 19 = 0 AND event_seq = 1 THEN 2
         WHEN control AND j > 0 THEN CASE WHEN j = 2 THEN 2 ELSE 1 END ELSE j % 2 + 1 END AS attempt_ordinal FROM ({STEPS}) steps"""
LOG = f"""SELECT run_id, event_seq, CASE WHEN control THEN 'RETRY_CONTROL_EVENT' ELSE 'CAPTURE_ATTEMPT' END AS event_type,
    CASE WHEN run_id % 43 = 0 AND event_seq >= 3 THEN 'w0' ELSE 'w1' END AS wave_id, CASE WHEN run_id % 41 = 0 AND event_seq = 2 THEN 99 ELSE run_id % 50 END AS source_id,
    CASE WHEN run_id % 47 = 0 AND event_seq = 2 THEN 9 ELSE route END AS route_id, strategy_ordinal, attempt_ordinal,
    CASE WHEN run_id % 53 = 0 AND event_seq = 2 THEN 'other' ELSE concat('st', CAST(strategy_ordinal AS VARCHAR(9))) END AS strategy_id,
    CASE WHEN run_id % 31 = 0 AND event_seq = 1 THEN 0 ELSE run_id END AS window_from, run_id + 1 AS window_to, concat('https://example.org/', CAST(strategy_ordinal AS VARCHAR(9))) AS final_url,
    CASE WHEN empty THEN 'NEXT_EMPTY_STRATEGY' WHEN ends AND run_id % 23 = 0 THEN 'NEXT_REJECTED_STRATEGY'
         WHEN ends THEN CASE run_id % 5 WHEN 0 THEN 'STOP_QUALIFIED' WHEN 1 THEN 'STOP_HARD_BLOCK' WHEN 2 THEN 'STOP_CAPTURE_PENDING_PARSER' WHEN 3 THEN 'STOP_RATE_LIMITED' ELSE 'STOP_RETRY_BUDGET' END
         WHEN run_id % 13 = 0 AND event_seq = 2 THEN 'RETRY_TRANSIENT' WHEN j % 2 = 0 THEN 'RETRY_TRANSIENT' ELSE 'NEXT_REJECTED_STRATEGY' END AS retry_disposition,
    CASE WHEN empty THEN 'AVAILABLE' WHEN run_id % 3 = 0 THEN 'AUTH_REQUIRED' ELSE 'BLOCKED' END AS state, CASE WHEN run_id % 2 = 0 THEN 'HTTP_RATE_LIMITED' END AS error_code,
    CASE WHEN empty THEN 'ZERO_RESULT' END AS query_status, empty AS zero_result, 0 AS qualified_items, 0 AS quality_flags, run_id % 122 <> 0 AS has_content,
    concat('c', CAST(strategy_ordinal AS VARCHAR(9))) AS content_sha256, concat('c', CAST(strategy_ordinal AS VARCHAR(9))) AS proof_sha256 FROM ({ORDINALS}) ordinals"""
REPORT = "SELECT DISTINCT l_orderkey AS run_id, l_orderkey % 50 AS source_id, 'w1' AS wave_id, l_orderkey AS window_from, l_orderkey + 1 AS window_to FROM lineitem WHERE l_orderkey % 29 <> 0"
ROUTE_COUNTS = """SELECT run_id, source_id, count(*) AS attempt_count, count(DISTINCT route_id) AS route_count FROM log WHERE event_type = 'CAPTURE_ATTEMPT' GROUP BY 1, 2"""


def _log(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("attempt_lines")
    return spark.sql(LOG.replace("FROM lineitem", "FROM attempt_lines")), spark.sql(REPORT.replace("FROM lineitem", "FROM attempt_lines"))


def log_contract(spark, sf_dir):
    log, reported = _log(spark, sf_dir)
    waves = reported.select("run_id", F.explode(F.array(*[F.struct(F.lit(f"w{i}").alias("wave_id"), F.lit(i).alias("ordinal")) for i in (0, 1)])).alias("w")).select("run_id", "w.*")
    return tally(at.check_attempt_log(log, reported, waves), "run_id")


def routes(spark, sf_dir):
    log, _ = _log(spark, sf_dir)
    found = at.route_outcomes(log, log.where("run_id % 46 = 0").select("run_id", "source_id"))
    return found.groupBy("terminal", "route_status", "coverage_complete", F.concat_ws("|", "issue_codes").alias("issues")).agg(
        F.count("*").alias("routes"), F.sum("attempts").alias("attempts"), F.sum("run_id").alias("ids"))


def sources(spark, sf_dir):
    """Reports made from the log, with wrong counts, states and watermarks in some runs."""
    log, reported = _log(spark, sf_dir)
    log = log.where("run_id % 41 <> 0 AND run_id % 47 <> 0")
    counts = log.where("event_type = 'CAPTURE_ATTEMPT'").groupBy("run_id", "source_id").agg(
        F.count("*").alias("attempt_count"), F.count_distinct("route_id").alias("route_count"))
    run = F.col("run_id")
    done = (run % 5 == 0) & (run % 61 != 0) & (run % 23 != 0) & (run % 37 != 0)
    made = reported.join(counts, ["run_id", "source_id"], "left").select(
        "run_id", "source_id", F.when(done, "QUALIFIED").otherwise("BLOCKED").alias("status"),
        (F.col("attempt_count") + (run % 7 == 0).cast("int")).alias("attempt_count"), (F.col("route_count") + (run % 10 == 0).cast("int")).alias("route_count"),
        F.when(done, F.col("route_count")).otherwise(F.lit(0)).alias("completed_route_count"), (run + 2).alias("decision_at"), (run - (run % 14 == 0).cast("int")).alias("watermark_before"),
        run.alias("initial_watermark"), F.when(run % 15 == 0, 0).when(done, run + 2).alias("watermark_after"), (run % 9 == 4).alias("interrupted"))
    checked = at.reconcile_sources(at.route_outcomes(log), made.where("attempt_count IS NOT NULL"))
    return checked.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("rows"), F.sum("run_id").alias("ids"))


QUERIES = {"attempt_log_contract": log_contract, "attempt_routes": routes, "attempt_sources": sources}

SAME = " AND ".join(f"{c} IS NOT DISTINCT FROM lag({c}) OVER w" for c in at.BOUND_FIELDS)
CHAIN = """
    p AS (SELECT *, lag(event_type) OVER w AS pt, lag(route_id) OVER w = route_id AND lag(source_id) OVER w = source_id AS pr, lag(retry_disposition) OVER w AS pd,
        lag(strategy_ordinal) OVER w AS ps, lag(attempt_ordinal) OVER w AS pa, lag(wave_id) OVER w AS pw, """ + SAME + """ AS bound,
        count(*) OVER (PARTITION BY run_id, source_id) <> max(event_seq) OVER (PARTITION BY run_id, source_id) - min(event_seq) OVER (PARTITION BY run_id, source_id) + 1 AS sa,
        count(*) OVER (PARTITION BY run_id, source_id, route_id) <> max(event_seq) OVER (PARTITION BY run_id, source_id, route_id)
            - min(event_seq) OVER (PARTITION BY run_id, source_id, route_id) + 1 AS ra FROM log WINDOW w AS (PARTITION BY run_id ORDER BY event_seq)),
    re AS (SELECT run_id, strategy_ordinal, true AS ren FROM log WHERE event_type = 'CAPTURE_ATTEMPT' GROUP BY 1, 2 HAVING count(DISTINCT strategy_id) > 1),
    c AS (SELECT p.*, event_type = 'CAPTURE_ATTEMPT' AS a, coalesce(pr, false) AS b, run_id % 29 <> 0 AND source_id = run_id % 50 AS known, coalesce(ren, false) AS ren
        FROM p LEFT JOIN re USING (run_id, strategy_ordinal))"""
NEXT = "('NEXT_EMPTY_STRATEGY', 'NEXT_STRATEGY_AFTER_TRANSIENT_EXHAUSTED', 'NEXT_REJECTED_STRATEGY')"
CODES = {
    "ATTEMPT_SOURCE_UNREPORTED": "NOT known", "ATTEMPT_WAVE_MISMATCH": "known AND wave_id <> 'w1'", "WAVE_ORDER_BACKWARD": "run_id % 29 <> 0 AND wave_id < pw",
    "ATTEMPT_WINDOW_MISMATCH": "known AND window_from <> run_id", "SOURCE_ROWS_NOT_CONTIGUOUS": "sa", "ROUTE_ROWS_NOT_CONTIGUOUS": "ra", "STRATEGY_ORDINAL_RENAMED": "a AND ren",
    "ROUTE_START_NOT_ONE": "a AND NOT b AND (strategy_ordinal <> 1 OR attempt_ordinal <> 1)",
    "RETRY_CONTRADICTS_DISPOSITION": "a AND b AND strategy_ordinal = ps AND (pd <> 'RETRY_TRANSIENT' OR attempt_ordinal <> pa + 1)",
    "STRATEGY_CONTRADICTS_DISPOSITION": f"a AND b AND strategy_ordinal = ps + 1 AND (pd NOT IN {NEXT} OR attempt_ordinal <> 1)",
    "STRATEGY_NOT_CONTIGUOUS": "a AND b AND strategy_ordinal - ps NOT IN (0, 1)",
    "CONTROL_EVENT_UNBOUND": "NOT a AND NOT (pt = 'CAPTURE_ATTEMPT' AND pd = 'RETRY_TRANSIENT' AND bound)"}
ROUTES = f"""
    z AS (SELECT run_id, source_id, route_id, count(*) AS attempts, arg_max(retry_disposition, event_seq) AS d, arg_max(state, event_seq) AS st,
        bool_or(error_code IS NOT NULL) AS lim, arg_max(strategy_ordinal, event_seq) AS so,
        count(DISTINCT CASE WHEN zero_result AND has_content THEN strategy_ordinal END) = 4 AS zero FROM log WHERE event_type = 'CAPTURE_ATTEMPT' GROUP BY 1, 2, 3),
    e AS (SELECT run_id, source_id, route_id, arg_max(event_type, event_seq) <> 'CAPTURE_ATTEMPT' AS ctl FROM log GROUP BY 1, 2, 3),
    o AS (SELECT *, CASE WHEN ctl THEN 'STOP_SLEEPER_FAILURE' ELSE d END AS terminal, CASE WHEN ctl THEN CASE WHEN lim THEN 'BLOCKED' ELSE 'ERROR' END WHEN zero THEN 'ZERO_RESULT'
        WHEN d = 'STOP_QUALIFIED' THEN 'QUALIFIED' WHEN d = 'STOP_CAPTURE_PENDING_PARSER' THEN 'CAPTURED_PENDING_PARSER' WHEN d = 'STOP_HARD_BLOCK' THEN st
        WHEN d IN ('STOP_RATE_LIMITED', 'STOP_RETRY_BUDGET') AND lim THEN 'BLOCKED' ELSE 'ERROR' END AS route_status FROM z JOIN e USING (run_id, source_id, route_id))"""
DONE = "run_id % 5 = 0 AND run_id % 61 <> 0 AND run_id % 23 <> 0 AND run_id % 37 <> 0"
ORACLE = {
    "attempt_log_contract": f"WITH log AS ({LOG}), {CHAIN} SELECT concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in CODES.items())
    + ") AS issues, count(*) AS rows, CAST(sum(run_id) AS BIGINT) AS ids FROM c GROUP BY 1",
    "attempt_routes": f"""WITH log AS ({LOG}), {ROUTES} SELECT terminal, route_status, route_status IN ('QUALIFIED', 'ZERO_RESULT') AND NOT ctl AS coverage_complete,
        CASE WHEN NOT ctl AND (d = 'RETRY_TRANSIENT' OR (d IN {NEXT} AND so < 4)) AND run_id % 46 <> 0 THEN 'ROUTE_NOT_TERMINAL' ELSE '' END AS issues, count(*) AS routes,
        CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(run_id) AS BIGINT) AS ids FROM o GROUP BY 1, 2, 3, 4""",
    "attempt_sources": f"""WITH log AS (SELECT * FROM ({LOG}) x WHERE run_id % 41 <> 0 AND run_id % 47 <> 0), {ROUTES},
        s AS (SELECT run_id, sum(attempts) AS n, count(*) AS r, count(*) FILTER (route_status IN ('QUALIFIED', 'ZERO_RESULT') AND NOT ctl) AS k, bool_or(route_status = 'QUALIFIED') AS q,
            bool_or(route_status = 'CAPTURED_PENDING_PARSER') AS pe, bool_or(route_status = 'AUTH_REQUIRED') AS au, bool_or(route_status = 'BLOCKED') AS bl FROM o GROUP BY 1),
        m AS (SELECT *, run_id % 9 = 4 AS cut, k = r AND run_id % 9 <> 4 AS whole, {DONE} AS done, run_id % 29 <> 0 AS told FROM s),
        x AS (SELECT *, CASE WHEN whole THEN CASE WHEN q THEN 'QUALIFIED' ELSE 'ZERO_RESULT' END WHEN pe THEN 'CAPTURED_PENDING_PARSER' WHEN au THEN 'AUTH_REQUIRED' WHEN bl THEN 'BLOCKED' ELSE 'ERROR' END AS want,
            CASE WHEN done THEN 'QUALIFIED' ELSE 'BLOCKED' END AS status, CASE WHEN run_id % 15 = 0 THEN 0 WHEN done THEN run_id + 2 END AS wa, CASE WHEN whole THEN run_id + 2 WHEN cut THEN run_id END AS ww FROM m)
        SELECT CASE WHEN NOT told THEN 'ATTEMPTS_WITHOUT_REPORT' ELSE concat_ws('|', CASE WHEN run_id % 7 = 0 THEN 'ATTEMPT_COUNT_MISMATCH' END,
            CASE WHEN run_id % 10 = 0 AND NOT cut THEN 'ROUTE_COUNT_MISMATCH' END, CASE WHEN NOT cut AND CASE WHEN done THEN r ELSE 0 END <> k THEN 'COMPLETED_ROUTES_MISMATCH' END,
            CASE WHEN NOT cut AND status <> want THEN 'SOURCE_STATUS_CONTRADICTS_ROUTES' END, CASE WHEN run_id % 14 = 0 THEN 'WATERMARK_BEFORE_MISMATCH' END,
            CASE WHEN wa IS DISTINCT FROM ww THEN 'WATERMARK_AFTER_CONTRADICTS_COVERAGE' END) END AS issues, count(*) AS rows, CAST(sum(run_id) AS BIGINT) AS ids FROM x GROUP BY 1""",
}
