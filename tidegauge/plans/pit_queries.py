"""Calendars, identity, status and session lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import pit
from tidegauge.plans import views
from tidegauge.plans.views import table, with_views

OPEN_DAYS = 45


def _order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an interval of fixed length; intervals of one customer may overlap."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("security_id"),
        F.to_date("o_orderdate").alias("valid_from"),
        F.date_add(F.to_date("o_orderdate"), OPEN_DAYS).alias("valid_to"),
    )


def calendar_days(spark, sf_dir):
    return views.calendar(spark, sf_dir).select(
        F.col("trade_date").cast("string").alias("trade_date"), "is_trading_day", "closed_reason"
    )


def calendar_contract(spark, sf_dir):
    """The ship-date spine of line items checked against the civil calendar."""
    lo, hi = views.span(spark, sf_dir)
    seen = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).distinct().withColumn(
        "is_trading_day", F.lit(True)
    )
    return pit.check_calendar(seen, lo, hi)


def next_session(spark, sf_dir):
    return pit.next_sessions(views.calendar(spark, sf_dir)).select(
        F.col("trade_date").cast("string").alias("trade_date"), F.col("next_session").cast("string").alias("next_session")
    )


def members_by_month(spark, sf_dir):
    days = views.calendar(spark, sf_dir).where(F.col("trade_date") == F.last_day("trade_date")).select(
        F.col("trade_date").alias("as_of"),
        (F.col("trade_date").cast("timestamp") + F.expr("INTERVAL 20 HOURS")).alias("known_at"),
    )
    sums = pit.count_members(days, views.identity(spark, sf_dir), {"members": F.lit(1), "security_checksum": F.col("security_id")})
    return sums.where("members > 0").select(F.col("as_of").cast("string").alias("as_of"), "members", "security_checksum")


def members_at_cutoff(spark, sf_dir):
    as_of = F.to_date(F.lit("2000-06-30"))
    known = F.lit("2000-06-30 20:00:00").cast("timestamp")
    return pit.members_on(views.identity(spark, sf_dir), as_of, known).select(
        "code", "security_id", F.col("valid_from").cast("string").alias("valid_from")
    )


def resolution(spark, sf_dir):
    probes = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("probe_id"),
        F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("as_of"),
    )
    resolved = pit.resolve_identity(probes, _order_intervals(spark, sf_dir), "probe_id")
    return resolved.groupBy("resolution", "matches").agg(
        F.count("*").alias("probes"), F.sum("security_id").alias("security_checksum")
    )


def denominator(spark, sf_dir):
    pairs = pit.eligible_denominator(
        views.calendar(spark, sf_dir), views.identity(spark, sf_dir), views.status(spark, sf_dir)
    )
    return pairs.groupBy(F.col("trade_date").cast("string").alias("trade_date"), "status").agg(
        F.count("*").alias("eligible"), F.sum("code").alias("code_checksum")
    )


def overlap(spark, sf_dir):
    return pit.overlapping_keys(_order_intervals(spark, sf_dir), ["code"], "valid_from", "valid_to").select(
        "code", F.col("first_overlap_day").cast("string").alias("first_overlap_day")
    )


def isin_collision(spark, sf_dir):
    """Different customers sharing one (segment, nation) identifier at the same time."""
    owners = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("code"), F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("isin")
    )
    return pit.overlapping_keys(
        _order_intervals(spark, sf_dir).join(owners, "code"), ["isin"], "valid_from", "valid_to", ["code"]
    ).select("isin", F.col("first_overlap_day").cast("string").alias("first_overlap_day"))


def session_horizon(spark, sf_dir):
    """Orders at every hour of the day against sessions that close at ten; the calendar lacks each 13th of June."""
    day = F.to_date("o_orderdate")
    decisions = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("code"), day.alias("decision_day"),
        F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + F.col("o_orderkey") % 24 * 3600000000).alias("decision_at"),
        F.lit(5).alias("horizon_sessions"),
    )
    cal = views.calendar(spark, sf_dir).where("NOT (month(trade_date) = 6 AND day(trade_date) = 13)").withColumn(
        "session_close", F.col("trade_date").cast("timestamp") + F.expr("INTERVAL 10 HOURS"))
    due = pit.nth_eligible_session(decisions, cal, views.status(spark, sf_dir))
    return due.select("decision_id", F.col("due_day").cast("string").alias("due_day"), "issue_code")


def context_windows(spark, sf_dir):
    tags = pit.window_tags(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy(F.concat_ws("|", tags).alias("tags"), "event_type").agg(
        F.count("*").alias("events")
    )


def snapshot_status(spark, sf_dir):
    listed = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("ticker")
    )
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "code")
    suspended = orders.where("o_orderstatus = 'P' AND o_totalprice > 400000").select(
        "code", F.lit("MACHINERY").alias("ticker")
    )
    delisted = orders.where("o_orderstatus = 'F' AND o_totalprice > 450000").select(
        "code", F.to_date("o_orderdate").alias("delisting_date")
    )
    rows = pit.snapshot_status(listed, suspended, delisted, F.to_date(F.lit("1999-01-01")))
    return rows.select("code", "status", "reason_code", F.concat_ws("|", "issue_codes").alias("issue_codes"))


def _registry(spark, sf_dir):
    """Regions as benchmark series, effective from their customers' first order."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    first = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey").agg(F.to_date(F.max("o_orderdate")).alias("effective_from"))
    )
    return (
        nation.join(first, nation.n_nationkey == first.c_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("r_name").alias("benchmark_code"), F.date_sub("effective_from", 900).alias("effective_from"),
            F.date_sub("effective_from", 300).alias("effective_to"),
            F.when(F.col("n_nationkey") < 10, "SECTOR").otherwise("BROAD_MARKET").alias("scope"),
        )
    )


def benchmark_lookup(spark, sf_dir):
    """The series of its customer's region, looked up on the day of every order."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    home = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("benchmark_code"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("as_of"))
    probes = orders.join(home, F.col("o_custkey") == F.col("c_custkey")).select("as_of", "benchmark_code").distinct()
    return pit.benchmark_asof(probes, _registry(spark, sf_dir)).select(
        F.col("as_of").cast("string").alias("as_of"), "benchmark_code", "scope", "issue_code"
    )


def snapshots(spark, sf_dir):
    days = views.calendar(spark, sf_dir).select(
        F.col("trade_date").alias("as_of"), F.col("trade_date").cast("timestamp").alias("known_at"),
        F.lit("REGION_1").alias("benchmark_code"),
    )
    rows = pit.market_snapshot(
        days, views.calendar(spark, sf_dir), views.identity(spark, sf_dir), _registry(spark, sf_dir)
    )
    return rows.select(
        F.col("as_of").cast("string").alias("as_of"), "universe_size", "status",
        F.concat_ws("|", "blocked_reasons").alias("blocked_reasons"),
    )


def opportunity_leads(spark, sf_dir):
    observations = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("code"),
        F.date_add(F.to_date("o_orderdate"), 10).alias("as_of"),
        F.when(F.col("o_orderpriority") == "5-LOW", "CONTEXT").otherwise("OFFICIAL_VERIFICATION").alias("evidence_class"),
    )
    rows = pit.opportunity_scan(observations, _order_intervals(spark, sf_dir), 25)
    return rows.groupBy("status", "reason").agg(
        F.count("*").alias("observations"), F.sum("seq").alias("seq_checksum"),
        F.sum("security_id").alias("security_checksum"),
    )


QUERIES = {
    "calendar_days": calendar_days,
    "calendar_contract": calendar_contract,
    "calendar_next_session": next_session,
    "identity_members_by_month": members_by_month,
    "identity_members_at_cutoff": members_at_cutoff,
    "identity_resolution": resolution,
    "identity_eligible_denominator": denominator,
    "identity_interval_overlap": overlap,
    "identity_isin_collision": isin_collision,
    "session_horizon_due": session_horizon,
    "context_window_tags": context_windows,
    "snapshot_status_conflicts": snapshot_status,
    "benchmark_asof_lookup": benchmark_lookup,
    "market_snapshot_by_day": snapshots,
    "opportunity_leads": opportunity_leads,
}

ORDER_INTERVALS = f"""
    SELECT o_custkey AS code, o_orderkey AS security_id, CAST(o_orderdate AS DATE) AS valid_from,
           CAST(o_orderdate AS DATE) + {OPEN_DAYS} AS valid_to FROM orders"""
REGISTRY = """
    SELECT r_name AS benchmark_code, m - 900 AS effective_from, m - 300 AS effective_to,
           CASE WHEN n_nationkey < 10 THEN 'SECTOR' ELSE 'BROAD_MARKET' END AS scope
    FROM nation JOIN region ON n_regionkey = r_regionkey
    JOIN (SELECT c_nationkey, CAST(max(o_orderdate) AS DATE) AS m FROM orders JOIN customer ON o_custkey = c_custkey
          GROUP BY 1) ON c_nationkey = n_nationkey"""
BENCH = f"""
    SELECT d.as_of, d.code AS benchmark_code, count(scope) AS n, min(scope) AS scope
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of, r_name AS code FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) d
    LEFT JOIN ({REGISTRY}) r ON r.benchmark_code = d.code AND d.as_of BETWEEN effective_from AND effective_to
    GROUP BY 1, 2"""

ORACLE = {
    "calendar_days": with_views(["cal"], """
        SELECT CAST(trade_date AS VARCHAR) AS trade_date, is_trading_day, closed_reason FROM cal"""),
    "calendar_contract": with_views(["cal"], """
        SELECT 'calendar' AS operator, CAST(trade_date AS VARCHAR) AS row_key, 'CALENDAR_MISSING_DATE' AS code,
               'ERROR' AS severity
        FROM cal WHERE trade_date NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)"""),
    "calendar_next_session": with_views(["cal"], """
        SELECT CAST(a.trade_date AS VARCHAR) AS trade_date, CAST(min(b.trade_date) AS VARCHAR) AS next_session
        FROM cal a LEFT JOIN cal b ON b.trade_date > a.trade_date AND b.trade_date <= a.trade_date + 370
         AND b.is_trading_day GROUP BY a.trade_date"""),
    "identity_members_by_month": with_views(["cal", "ident"], """
        SELECT CAST(c.trade_date AS VARCHAR) AS as_of, count(*) AS members,
               CAST(sum(security_id) AS BIGINT) AS security_checksum
        FROM cal c JOIN ident i ON c.trade_date >= valid_from AND (valid_to IS NULL OR c.trade_date <= valid_to)
         AND s <> 'F' AND known_from <= CAST(c.trade_date AS TIMESTAMP) + INTERVAL 20 HOURS
         AND (known_to IS NULL OR CAST(c.trade_date AS TIMESTAMP) + INTERVAL 20 HOURS <= known_to)
        WHERE c.trade_date = last_day(c.trade_date) GROUP BY 1"""),
    "identity_members_at_cutoff": with_views(["ident"], """
        SELECT code, security_id, CAST(valid_from AS VARCHAR) AS valid_from FROM ident
        WHERE s <> 'F' AND valid_from <= DATE '2000-06-30' AND (valid_to IS NULL OR valid_to >= DATE '2000-06-30')
          AND known_from <= TIMESTAMP '2000-06-30 20:00:00'
          AND (known_to IS NULL OR known_to >= TIMESTAMP '2000-06-30 20:00:00')"""),
    "identity_resolution": f"""
        SELECT resolution, matches, count(*) AS probes, CAST(sum(security_id) AS BIGINT) AS security_checksum FROM (
          SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(i.security_id) AS matches,
                 CASE WHEN count(i.security_id) = 1 THEN min(i.security_id) END AS security_id,
                 CASE count(i.security_id) WHEN 1 THEN 'MATCH' WHEN 0 THEN 'MISSING' ELSE 'AMBIGUOUS' END AS resolution
          FROM lineitem LEFT JOIN ({ORDER_INTERVALS}) i
            ON i.code = l_suppkey AND CAST(l_shipdate AS DATE) BETWEEN valid_from AND valid_to
          GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""",
    "identity_eligible_denominator": with_views(["cal", "ident"], """
        SELECT CAST(trade_date AS VARCHAR) AS trade_date, status, count(*) AS eligible,
               CAST(sum(code) AS BIGINT) AS code_checksum
        FROM cal JOIN ident ON trade_date >= valid_from AND (valid_to IS NULL OR trade_date <= valid_to)
        WHERE is_trading_day AND status IN ('TRADING', 'SUSPENDED') GROUP BY 1, 2"""),
    "identity_interval_overlap": f"""
        SELECT code, CAST(min(b.valid_from) AS VARCHAR) AS first_overlap_day FROM
          (SELECT *, lag(valid_to) OVER (PARTITION BY code ORDER BY valid_from, security_id) AS before
           FROM ({ORDER_INTERVALS})) b WHERE before >= valid_from GROUP BY 1""",
    "identity_isin_collision": f"""
        WITH o AS (SELECT c_mktsegment || '-' || c_nationkey AS isin, i.* FROM ({ORDER_INTERVALS}) i
                   JOIN customer ON c_custkey = code)
        SELECT a.isin, CAST(min(greatest(a.valid_from, b.valid_from)) AS VARCHAR) AS first_overlap_day
        FROM o a JOIN o b ON a.isin = b.isin AND a.code < b.code AND a.valid_from <= b.valid_to
         AND b.valid_from <= a.valid_to GROUP BY 1""",
    "session_horizon_due": with_views(["cal", "ident"], """,
        kal AS (SELECT * FROM cal WHERE NOT (month(trade_date) = 6 AND day(trade_date) = 13)),
        gap AS (SELECT trade_date FROM cal WHERE month(trade_date) = 6 AND day(trade_date) = 13),
        days AS (SELECT code, trade_date, status FROM kal JOIN ident
                 ON trade_date >= valid_from AND (valid_to IS NULL OR trade_date <= valid_to) WHERE is_trading_day),
        due AS (SELECT code, trade_date, lead(trade_date, 5) OVER (PARTITION BY code ORDER BY trade_date) AS due_day
                FROM days WHERE status = 'TRADING')
        SELECT decision_id, CASE WHEN issue_code IS NULL THEN CAST(due_day AS VARCHAR) END AS due_day, issue_code FROM (
        SELECT o_orderkey AS decision_id, due_day,
               CASE WHEN NOT coalesce(c.is_trading_day, false) THEN 'DECISION_NOT_ON_TRADING_SESSION'
                    WHEN o_orderkey % 24 < 10 THEN 'DECISION_AT_PRECEDES_OFFICIAL_SESSION_CLOSE'
                    WHEN d.status <> 'TRADING' THEN 'DECISION_SECURITY_STATUS_NOT_TRADING'
                    WHEN EXISTS (SELECT 1 FROM gap WHERE gap.trade_date > c.trade_date AND (due_day IS NULL OR gap.trade_date < due_day))
                      THEN 'OFFICIAL_TRADING_CALENDAR_MISSING_DATE'
                    WHEN due_day IS NULL THEN 'SESSION_HORIZON_NOT_COVERED' END AS issue_code
        FROM orders LEFT JOIN kal c ON c.trade_date = CAST(o_orderdate AS DATE)
        LEFT JOIN days d ON d.code = o_custkey AND d.trade_date = c.trade_date
        LEFT JOIN due e ON e.code = o_custkey AND e.trade_date = c.trade_date)""").replace(") ,", "),"),
    "context_window_tags": """
        SELECT concat_ws('|', CASE WHEN a BETWEEN 0 AND 2880 * 3600000000 THEN 'CONTEXT_120D' END,
                              CASE WHEN a BETWEEN 0 AND 720 * 3600000000 THEN 'ACTIVE_EVENT_30D' END,
                              CASE WHEN a BETWEEN 0 AND 168 * 3600000000 THEN 'COMMUNITY_SENTIMENT_7D' END,
                              CASE WHEN a BETWEEN 0 AND 72 * 3600000000 THEN 'FRESH_CATALYST_72H' END) AS tags,
               event_type, count(*) AS events
        FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) AS a FROM events) GROUP BY 1, 2""",
    "snapshot_status_conflicts": """
        SELECT c_custkey AS code, CASE WHEN p.code IS NULL THEN 'TRADING' ELSE 'SUSPENDED' END AS status,
               CASE WHEN p.code IS NULL THEN 'ABSENT_FROM_COMPLETE_SUSPENDED_TABLE'
                    ELSE 'PRESENT_IN_CURRENT_SUSPENDED_TABLE' END AS reason_code,
               concat_ws('|', CASE WHEN p.code IS NOT NULL AND c_mktsegment <> 'MACHINERY' THEN 'SUSPENDED_TICKER_CONFLICT' END,
                         CASE WHEN f.d <= DATE '1999-01-01' THEN 'CURRENT_IDENTITY_APPEARS_DELISTED' END) AS issue_codes
        FROM customer
        LEFT JOIN (SELECT DISTINCT o_custkey AS code FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000) p
          ON p.code = c_custkey
        LEFT JOIN (SELECT o_custkey AS code, CAST(min(o_orderdate) AS DATE) AS d FROM orders
                   WHERE o_orderstatus = 'F' AND o_totalprice > 450000 GROUP BY 1) f ON f.code = c_custkey""",
    "benchmark_asof_lookup": f"""
        SELECT CAST(as_of AS VARCHAR) AS as_of, benchmark_code, CASE WHEN n = 1 THEN scope END AS scope,
               CASE WHEN n <> 1 THEN 'BENCHMARK_NOT_UNIQUELY_ACTIVE' END AS issue_code FROM ({BENCH})""",
    "market_snapshot_by_day": with_views(["cal", "ident"], f""",
        sizes AS (SELECT c.trade_date, count(*) AS n FROM cal c JOIN ident i
                  ON c.trade_date >= valid_from AND (valid_to IS NULL OR c.trade_date <= valid_to) AND s <> 'F'
                  AND known_from <= CAST(c.trade_date AS TIMESTAMP)
                  AND (known_to IS NULL OR CAST(c.trade_date AS TIMESTAMP) <= known_to) GROUP BY 1),
        marks AS (SELECT c.trade_date, count(r.scope) AS k FROM cal c LEFT JOIN ({REGISTRY}) r
                  ON r.benchmark_code = 'REGION_1' AND c.trade_date BETWEEN effective_from AND effective_to GROUP BY 1)
        SELECT CAST(c.trade_date AS VARCHAR) AS as_of, coalesce(n, 0) AS universe_size,
               CASE WHEN is_trading_day AND n > 0 AND k = 1 THEN 'READY_FOR_EVIDENCE' ELSE 'ABSTAIN' END AS status,
               concat_ws('|', CASE WHEN NOT is_trading_day THEN 'NON_TRADING_SESSION' END,
                         CASE WHEN coalesce(n, 0) = 0 THEN 'EMPTY_OR_UNVERIFIED_UNIVERSE' END,
                         CASE WHEN k <> 1 THEN 'BENCHMARK_NOT_UNIQUELY_ACTIVE' END) AS blocked_reasons
        FROM cal c LEFT JOIN sizes USING (trade_date) LEFT JOIN marks USING (trade_date)""").replace(") ,", "),"),
    "opportunity_leads": f"""
        WITH r AS (SELECT o_orderkey AS seq, count(i.security_id) AS k, min(i.security_id) AS sid, min(o_orderpriority) AS p
                   FROM orders LEFT JOIN ({ORDER_INTERVALS}) i
                     ON i.code = o_custkey AND CAST(o_orderdate AS DATE) + 10 BETWEEN valid_from AND valid_to GROUP BY 1),
        j AS (SELECT seq, CASE WHEN k = 1 THEN sid END AS sid,
                     CASE WHEN k <> 1 THEN 'IDENTITY_NOT_UNIQUELY_RESOLVED' WHEN p = '5-LOW' THEN 'CONTEXT_ONLY_SOURCE' END AS reason
              FROM r)
        SELECT CASE WHEN reason IS NOT NULL THEN 'REJECTED' WHEN rn <= 25 THEN 'CANDIDATE_CONTEXT_ONLY'
                    ELSE 'BEYOND_REQUEST_LIMIT' END AS status, reason, count(*) AS observations,
               CAST(sum(seq) AS BIGINT) AS seq_checksum, CAST(sum(sid) AS BIGINT) AS security_checksum
        FROM (SELECT *, row_number() OVER (PARTITION BY reason IS NULL ORDER BY seq) AS rn FROM j) GROUP BY 1, 2""",
}
