"""Reconciliations, provider consensus and gates over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import reconcile as rec
from tidegauge.plans import views
from tidegauge.plans.views import table


def denominator_gaps(spark, sf_dir):
    """Order keys against line-item keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return rec.key_difference(o, li, ["k"])


def totals(spark, sf_dir):
    """Bars against daily totals declared by order day: most days cannot reconcile."""
    b = views.bars(spark, sf_dir)
    declared = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("trade_date")).agg(
        F.count_distinct("l_suppkey").alias("traded_count"), F.sum("l_quantity").alias("total_volume"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount") * (F.col("l_linenumber") == 7).cast("int"))).alias("total_value"),
    )
    r = rec.totals_reconcile(
        b, declared, "trade_date",
        {"traded_count": F.count("*"), "total_volume": F.sum("volume")}, {"total_value": (F.sum("turnover"), 0.001)},
    )
    return r.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(
        F.count("*").alias("days"), F.min("trade_date").cast("string").alias("first_day"))


def query_ledger(spark, sf_dir):
    """Each order as one paged query whose rows are its line items."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m"))
    q = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("query_id"), F.to_date("o_orderdate").alias("window_from"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("window_to"),
        F.coalesce("m", F.lit(0)).alias("pages_declared"), F.coalesce("n", F.lit(0)).cast("int").alias("pages_received"),
        F.coalesce("n", F.lit(0)).alias("result_count_declared"), F.coalesce("n", F.lit(0)).alias("rows_normalized"),
        (F.col("o_orderstatus") == "F").alias("zero_result"),
    )
    c = rec.check_query_ledger(q, F.to_date(F.lit("1995-02-01")), F.to_date(F.lit("2001-07-15")))
    return c.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(
        F.count("*").alias("queries"), F.sum("query_id").alias("id_checksum"))


def dataset_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ledger = o.select(F.col("o_orderpriority").alias("dataset"), F.lit(1).alias("rows_normalized"), F.lit(False).alias("zero_result"))
    actual = o.where("o_orderstatus <> 'P' OR o_orderpriority = '1-URGENT'").groupBy(
        F.col("o_orderpriority").alias("dataset")).agg(F.count("*").alias("rows"))
    return rec.query_rows_reconcile(ledger, actual).select(
        "dataset", "declared_rows", "rows", F.concat_ws("|", "issue_codes").alias("issues"))


def _providers(spark, sf_dir):
    """Return flags as three providers of one supplier-day; quantity bands are what they report."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("trade_date"), F.col("l_returnflag").alias("provider_id")
    ).agg(
        (F.max("l_quantity") > 25).alias("heavy"), F.max("l_linestatus").alias("trading_state"),
        F.sha2(F.concat_ws("|", F.min("l_orderkey"), F.max("l_orderkey")), 256).alias("raw_sha256"),
        F.when(F.max("l_tax") > 0.07, "LIVE_DEPENDENT").when(F.max("l_tax") > 0.04, "PARTIAL").otherwise(
            "PROVEN_REAL_EVIDENCE").alias("evidence_classification"),
        F.when(F.max("l_discount") > 0.08, "RESTRICTED").otherwise("RESEARCH_USE_AUTHORIZED").alias("rights_status"),
    )


def consensus(spark, sf_dir):
    agreed, _, _ = rec.provider_consensus(_providers(spark, sf_dir), ["code", "trade_date"], ["heavy", "trading_state"])
    return agreed.select("code", F.col("trade_date").cast("string").alias("trade_date"), "provider_rows", "provider_id",
                         "raw_sha256", "evidence_classification", "rights_status")


def disagreement(spark, sf_dir):
    _, quarantine, _ = rec.provider_consensus(_providers(spark, sf_dir), ["code", "trade_date"], ["heavy", "trading_state"])
    return quarantine.select("code", F.col("trade_date").cast("string").alias("trade_date"), "provider_rows", "reason")


def supporting(spark, sf_dir):
    _, _, support = rec.provider_consensus(_providers(spark, sf_dir), ["code", "trade_date"], ["heavy", "trading_state"])
    return support.groupBy("code").agg(F.count("*").alias("hashes"), F.min("raw_sha256").alias("first_hash"))


def source_class(spark, sf_dir):
    return _providers(spark, sf_dir).groupBy("code").agg(
        rec.worst_of("evidence_classification", rec.PROVIDER_CLASSES, "PARTIAL").alias("provider_class"),
        rec.worst_of("evidence_classification", rec.COMPONENT_CLASSES, "PROVEN_REAL_EVIDENCE").alias("component_class"),
        rec.worst_of("rights_status", rec.RIGHTS_ORDER, "UNKNOWN").alias("rights"),
    )


def two_source(spark, sf_dir):
    """Suppliers against the customers of the same number as a second official list."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("code"), F.col("s_nationkey").cast("string").alias("isin"),
        F.concat_ws(" ", F.lit("The"), F.regexp_replace("s_name", "Supplier#0*", "House "), F.lit("Co")).alias("name"),
        F.lit("T").alias("ticker"))
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("code"), F.col("c_nationkey").cast("string").alias("isin"),
        F.concat_ws(" ", F.regexp_replace("c_name", "Customer#0*", "House "), F.when(F.col("c_acctbal") > 0, "Corporation").otherwise("Fund")).alias("name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "M").otherwise("T").alias("ticker"),
        F.when(F.col("c_acctbal") > 8000, F.to_date(F.lit("2030-01-01"))).otherwise(F.to_date(F.lit("2000-01-01"))).alias("listing_date"))
    r = rec.two_source_identity(s, c, F.to_date(F.lit("2020-01-01")))
    return r.select("code", F.concat_ws("|", "issue_codes").alias("issues"))


def hashes(spark, sf_dir):
    """Line-item evidence (order hash | part hash) against a manifest of orders with line totals."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.concat_ws("|", F.sha2(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), 256),
                                 F.sha2(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), 256)).alias("h"))
    manifest = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(
        F.sha2(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), 256).alias("sha256")
    ).union(table(spark, sf_dir, "part").select(F.sha2(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), 256)))
    return rec.unresolved_hashes(rows, manifest, "h", "l_suppkey").groupBy("l_suppkey").agg(
        F.count("*").alias("unresolved"), F.count_distinct("sha256").alias("distinct_hashes"))


def binding(spark, sf_dir):
    o = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_acctbal").cast("string").alias("isin"))
    s = table(spark, sf_dir, "customer").select(F.col("c_name").alias("ticker"), F.col("c_acctbal").cast("string").alias("isin"))
    r = rec.two_source_binding(o, s)
    return r.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("isins"), F.sum("code").alias("codes"))


def universe(spark, sf_dir):
    return rec.universe_checks(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code")),
        table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code")),
        table(spark, sf_dir, "events").select(F.col("user_id").alias("code")),
    )


def _gates(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(F.col("c_nationkey").alias("run_id"), F.col("c_mktsegment").alias("segment"), "o_orderstatus", "o_orderdate", "o_totalprice")


def gate_verdicts(spark, sf_dir):
    per = _gates(spark, sf_dir).groupBy("run_id", F.col("segment").alias("gate_id")).agg(
        F.max("o_totalprice").alias("top"), F.count_distinct("o_orderdate").alias("dates"), F.count("*").alias("events"))
    g = per.select("run_id", "gate_id", F.when(F.col("top") > 499000, "FAIL").otherwise("PASS").alias("status"),
                   F.when(F.col("gate_id") == "HOUSEHOLD", "INFERENCE").otherwise("CRITICAL").alias("severity"),
                   F.lit("limit").alias("failure_reason"), F.when(F.col("top") < 499900, F.lit("retry")).alias("recovery_action"),
                   "dates", "events", F.lit(110).alias("minimum_dates"), F.lit(100).alias("minimum_events"))
    v = rec.stop_gates(g, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    return v.select("run_id", "critical_failures", F.concat_ws("|", "errors").alias("errors"), "verdict")


def _components(spark, sf_dir):
    per = _gates(spark, sf_dir).groupBy(F.col("run_id").alias("gate"), F.col("segment").alias("component")).agg(
        F.max("o_totalprice").alias("top"), F.min("o_totalprice").alias("low"), F.count("*").alias("n"))
    return per.select(
        "gate", "component",
        F.when(F.col("top") > 499900, "BLOCKED").when(F.col("top") > 499000, "PARTIAL").otherwise("PASS").alias("status"),
        F.when(F.col("low") > 5000, "LIVE_DEPENDENT").otherwise("PROVEN_REAL_EVIDENCE").alias("classification"),
        (F.col("low") < 20000).alias("rights_compatible"), F.lit(0).alias("errors"),
        F.when(F.col("n") < 80, 1).otherwise(0).alias("limitations"))


def gates(spark, sf_dir):
    return rec.gate_rollup(_components(spark, sf_dir))


def foundation(spark, sf_dir):
    return rec.foundation_status(rec.gate_rollup(_components(spark, sf_dir)))


def _attempts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"),
        F.when(F.col("event_type").isin("purchase", "click", "view"), "AVAILABLE").when(F.col("event_type") == "error", "ERROR")
        .otherwise("AUTH_REQUIRED").alias("state"),
        ((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("captured"))


def captures(spark, sf_dir):
    return rec.capture_states(_attempts(spark, sf_dir))


def capture_batch(spark, sf_dir):
    return rec.capture_batch(rec.capture_states(_attempts(spark, sf_dir)))


def attempts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.select(F.col("l_orderkey").alias("source_id"), F.col("l_returnflag").alias("wave"), F.col("l_linenumber").alias("attempt_no"),
                  F.when(F.col("l_linestatus") == "O", "SUCCESS").otherwise("FAILED").alias("outcome"))
    reported = li.where("l_quantity > 5").groupBy(F.col("l_orderkey").alias("source_id"), F.col("l_returnflag").alias("wave")).agg(
        F.count("*").alias("reported_attempts"))
    r = rec.attempt_rollup(a, reported)
    return r.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(
        F.count("*").alias("routes"), F.sum("attempts").alias("attempts"), F.sum("successes").alias("successes"))


def readiness(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    per = _gates(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n"))
    series = per.select(F.col("run_id").alias("benchmark_code"), (F.col("n") >= 600).alias("complete"))
    roles = n.select(F.col("n_name").alias("role"), F.col("n_nationkey").alias("benchmark_code"))
    rules = n.select(F.col("n_regionkey").alias("product_id"), F.col("n_name").alias("role"))
    return rec.comparison_readiness(series, roles, rules)


def cutoffs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn(
        "captured_at", F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 60000000)))
    return rec.cutoff_scan(e, "events", "event_id", ["ts", "captured_at"], F.lit("2024-01-30 12:00:00").cast("timestamp"))


def bindings(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("benchmark_code"), F.col("o_orderpriority").alias("source_id"),
        F.sha2(F.concat("o_orderpriority", "o_orderstatus"), 256).alias("raw_sha256"))
    reg = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("benchmark_code")).agg(F.min("o_orderpriority").alias("source_id"))
    r = rec.binding_consistency(s, reg)
    return r.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("series"), F.sum("rows").alias("rows"))


QUERIES = {
    "reconcile_denominator": denominator_gaps, "reconcile_market_totals": totals, "reconcile_query_ledger": query_ledger,
    "reconcile_dataset_rows": dataset_rows, "providers_consensus": consensus, "providers_disagreement": disagreement,
    "providers_supporting_hashes": supporting, "providers_worst_class": source_class, "identity_two_sources": two_source,
    "evidence_unresolved_hashes": hashes, "identity_two_source_binding": binding, "universe_checks": universe,
    "gates_stop_verdict": gate_verdicts, "gates_rollup": gates, "gates_foundation_status": foundation,
    "captures_source_state": captures, "captures_batch_status": capture_batch, "attempts_rollup": attempts,
    "benchmark_comparison_ready": readiness, "cutoff_scan_events": cutoffs, "benchmark_binding_consistency": bindings,
}

PROV = """prov AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS trade_date, l_returnflag AS p, max(l_quantity) > 25 AS heavy,
    max(l_linestatus) AS st, sha256(min(l_orderkey) || '|' || max(l_orderkey)) AS h,
    CASE WHEN max(l_tax) > 0.07 THEN 'LIVE_DEPENDENT' WHEN max(l_tax) > 0.04 THEN 'PARTIAL' ELSE 'PROVEN_REAL_EVIDENCE' END AS ec,
    CASE WHEN max(l_discount) > 0.08 THEN 'RESTRICTED' ELSE 'RESEARCH_USE_AUTHORIZED' END AS rs FROM lineitem GROUP BY 1, 2, 3),
  grp AS (SELECT code, trade_date, count(*) AS n, count(DISTINCT (heavy, st)) AS sigs, min(p) AS provider_id, arg_min(h, p) AS h,
    min(CASE ec WHEN 'LIVE_DEPENDENT' THEN 1 WHEN 'PARTIAL' THEN 2 ELSE 3 END) AS ce, bool_or(rs = 'RESTRICTED') AS rr FROM prov GROUP BY 1, 2)"""
GATES = """g AS (SELECT c_nationkey AS run_id, c_mktsegment AS seg, max(o_totalprice) AS top, min(o_totalprice) AS low, count(*) AS n,
    count(DISTINCT o_orderdate) AS dates FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
COMP = GATES + """, roll AS (SELECT run_id AS gate, count(*) AS components, bool_or(top > 499900) AS b, bool_or((top > 499000 AND top <= 499900) OR n < 80) AS pt,
    bool_or(low > 5000) AS live, bool_and(low < 20000) AS rc FROM g GROUP BY 1),
  gt AS (SELECT gate, components, CASE WHEN b THEN 'BLOCKED' WHEN pt OR live OR NOT rc THEN 'PARTIAL' ELSE 'PASS' END AS status,
    CASE WHEN b THEN 'BLOCKED' WHEN live THEN 'LIVE_DEPENDENT' ELSE 'PROVEN_REAL_EVIDENCE' END AS classification, rc AND NOT b AS rights_compatible FROM roll)"""
ATT = """att AS (SELECT user_id AS source_id, count(*) AS attempts, bool_or(event_type = 'purchase' AND value > 100) AS any_captured,
    bool_and(event_type IN ('purchase','click','view') AND event_type = 'purchase' AND value > 100) AS ok, bool_or(event_type = 'signup') AS auth,
    bool_or(event_type = 'error') AS err FROM events GROUP BY 1),
  sst AS (SELECT source_id, CASE WHEN ok THEN 'AVAILABLE' WHEN any_captured THEN 'PARTIAL' WHEN auth THEN 'AUTH_REQUIRED' ELSE 'ERROR' END AS source_state,
    attempts, any_captured FROM att)"""

ORACLE = {
    "reconcile_denominator": """
        SELECT o_orderkey AS k, 'MISSING' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
        UNION ALL SELECT DISTINCT l_orderkey, 'EXTRA' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
    "reconcile_market_totals": """
        SELECT CASE WHEN ok THEN '' ELSE 'TOTAL_VALUE_DOES_NOT_RECONCILE' END AS issues, count(*) AS days, CAST(min(d) AS VARCHAR) AS first_day
        FROM (SELECT CAST(l_shipdate AS DATE) AS d, coalesce(abs(sum(CASE WHEN l_linenumber = 7 THEN l_extendedprice * l_discount END)) <= 0.001, TRUE) AS ok
              FROM lineitem GROUP BY 1) GROUP BY 1""",
    "reconcile_query_ledger": """
        SELECT concat_ws('|', CASE WHEN d < DATE '1995-02-01' OR d + 30 > DATE '2001-07-15' THEN 'QUERY_WINDOW_OUTSIDE_COLLECTION' END,
                         CASE WHEN m <> n THEN 'PAGINATION_INCOMPLETE' END,
                         CASE WHEN (s = 'F') <> (n = 0) THEN 'ZERO_RESULT_DOES_NOT_MATCH_COUNTS' END) AS issues,
               count(*) AS queries, CAST(sum(o_orderkey) AS BIGINT) AS id_checksum
        FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM orders
              LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1""",
    "reconcile_dataset_rows": """
        SELECT o_orderpriority AS dataset, count(*) AS declared_rows, count(*) FILTER (o_orderstatus <> 'P' OR o_orderpriority = '1-URGENT') AS rows,
               CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'QUERY_ROW_RECONCILIATION' END AS issues FROM orders GROUP BY 1""",
    "providers_consensus": f"""WITH {PROV}
        SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, n AS provider_rows, provider_id, h AS raw_sha256,
               CASE ce WHEN 1 THEN 'LIVE_DEPENDENT' WHEN 2 THEN 'PARTIAL' ELSE 'PROVEN_REAL_EVIDENCE' END AS evidence_classification,
               CASE WHEN rr THEN 'RESTRICTED' ELSE 'RESEARCH_USE_AUTHORIZED' END AS rights_status FROM grp WHERE sigs = 1""",
    "providers_disagreement": f"""WITH {PROV}
        SELECT code, CAST(trade_date AS VARCHAR) AS trade_date, n AS provider_rows, 'PROVIDER_DISAGREEMENT' AS reason FROM grp WHERE sigs > 1""",
    "providers_supporting_hashes": f"""WITH {PROV}
        SELECT code, count(*) AS hashes, min(h) AS first_hash FROM (
          SELECT DISTINCT p.code, p.trade_date, p.h FROM prov p JOIN grp g ON g.code = p.code AND g.trade_date = p.trade_date
          WHERE sigs = 1 AND p.h <> g.h) GROUP BY 1""",
    "providers_worst_class": f"""WITH {PROV}
        SELECT code, CASE WHEN bool_or(ec = 'LIVE_DEPENDENT') THEN 'LIVE_DEPENDENT' WHEN bool_or(ec = 'PARTIAL') THEN 'PARTIAL'
                     ELSE 'PROVEN_REAL_EVIDENCE' END AS provider_class,
               CASE WHEN bool_or(ec = 'LIVE_DEPENDENT') THEN 'LIVE_DEPENDENT' WHEN bool_or(ec = 'PARTIAL') THEN 'PARTIAL'
                     ELSE 'PROVEN_REAL_EVIDENCE' END AS component_class,
               CASE WHEN bool_or(rs = 'RESTRICTED') THEN 'RESTRICTED' ELSE 'RESEARCH_USE_AUTHORIZED' END AS rights FROM prov GROUP BY 1""",
    "identity_two_sources": """
        SELECT coalesce(s_suppkey, c_custkey) AS code, concat_ws('|', CASE WHEN s_suppkey IS NULL THEN 'MISSING_IN_FIRST_SOURCE' END,
            CASE WHEN c_custkey IS NULL THEN 'MISSING_IN_SECOND_SOURCE' END,
            CASE WHEN s_nationkey <> c_nationkey THEN 'OFFICIAL_ISIN_CONFLICT' END,
            CASE WHEN s_suppkey IS NOT NULL AND c_mktsegment = 'MACHINERY' THEN 'OFFICIAL_TICKER_CONFLICT' END,
            CASE WHEN s_suppkey IS NOT NULL AND c_acctbal > 8000 THEN 'LISTING_DATE_AFTER_IDENTITY_SNAPSHOT' END,
            CASE WHEN s_suppkey IS NOT NULL AND c_acctbal <= 0 THEN 'OFFICIAL_NAME_CONFLICT' END) AS issues
        FROM supplier FULL JOIN customer ON s_suppkey = c_custkey""",
    "evidence_unresolved_hashes": """
        SELECT l_suppkey, CAST(sum(o + p) AS BIGINT) AS unresolved,
               count(DISTINCT CASE WHEN o = 1 THEN 'o' || l_orderkey END) + count(DISTINCT CASE WHEN p = 1 THEN 'p' || l_partkey END) AS distinct_hashes
        FROM (SELECT *, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') THEN 0 ELSE 1 END AS o,
                     CASE WHEN l_partkey IN (SELECT p_partkey FROM part) THEN 0 ELSE 1 END AS p FROM lineitem)
        WHERE o + p > 0 GROUP BY 1""",
    "identity_two_source_binding": """
        SELECT concat_ws('|', CASE WHEN s IS NULL THEN 'SECONDARY_NOT_FOUND' END, CASE WHEN o IS NULL THEN 'OFFICIAL_NOT_FOUND' END,
                  CASE WHEN o > 1 THEN 'OFFICIAL_ISIN_SHARED' END, CASE WHEN s > 1 THEN 'SECONDARY_ISIN_SHARED' END) AS issues,
               count(*) AS isins, CAST(sum(code) AS BIGINT) AS codes
        FROM (SELECT s_acctbal AS i, count(*) AS o, min(s_suppkey) AS code FROM supplier GROUP BY 1)
        FULL JOIN (SELECT c_acctbal AS i, count(*) AS s FROM customer GROUP BY 1) USING (i) GROUP BY 1""",
    "universe_checks": """
        SELECT *, a = 0 AND b = 0 AND c = 0 AS full_market FROM (SELECT
          (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS covered_outside_expected,
          (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS expected_not_covered,
          (SELECT count(DISTINCT user_id) FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)) AS findings_outside_covered) t(a, b, c)"""
    .replace("SELECT *, a = 0", "SELECT a AS covered_outside_expected, b AS expected_not_covered, c AS findings_outside_covered, a = 0"),
    "gates_stop_verdict": f"""WITH {GATES}, v AS (SELECT run_id, count(*) FILTER (seg <> 'HOUSEHOLD' AND top > 499000) AS cf,
            bool_or(top > 499000 AND top >= 499900) AS nr, count(*) AS present, max(dates) AS d, max(n) AS e FROM g GROUP BY 1)
        SELECT run_id, cf AS critical_failures, concat_ws('|', CASE WHEN nr THEN 'FAILED_GATE_LACKS_RECOVERY' END,
                 CASE WHEN present < 5 THEN 'MISSING_REQUIRED_GATES' END) AS errors,
               CASE WHEN nr OR present < 5 OR cf > 0 THEN 'STOP_BACKTEST' WHEN d < 110 OR e < 100 THEN 'STOP_INFERENCE' ELSE 'READY_TO_SCORE' END AS verdict
        FROM v""",
    "gates_rollup": f"WITH {COMP} SELECT * FROM gt",
    "gates_foundation_status": f"""WITH {COMP}
        SELECT count(*) AS gates, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'BLOCKED') AS blocked,
               CASE WHEN bool_or(classification = 'BLOCKED') THEN 'BLOCKED' WHEN bool_or(classification = 'LIVE_DEPENDENT') THEN 'LIVE_DEPENDENT'
                    ELSE 'PROVEN_REAL_EVIDENCE' END AS classification,
               CASE WHEN bool_or(status = 'BLOCKED') THEN 'DATA_FOUNDATION_BLOCKED'
                    WHEN bool_and(status = 'PASS') THEN 'DATA_FOUNDATION_READY_FOR_BASELINE_BACKTEST' ELSE 'DATA_FOUNDATION_PARTIAL' END AS status FROM gt""",
    "captures_source_state": f"WITH {ATT} SELECT * FROM sst",
    "captures_batch_status": f"""WITH {ATT} SELECT count(*) AS sources, count(*) FILTER (source_state <> 'AVAILABLE') AS degraded,
        CASE WHEN NOT bool_or(any_captured) THEN 'FAILED' WHEN bool_or(source_state <> 'AVAILABLE') THEN 'DEGRADED' ELSE 'COMPLETE' END AS status FROM sst""",
    "attempts_rollup": """
        WITH a AS (SELECT l_orderkey, l_returnflag, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi,
                     count(*) FILTER (l_linestatus = 'O') AS ok, count(*) FILTER (l_quantity > 5) AS r FROM lineitem GROUP BY 1, 2)
        SELECT concat_ws('|', CASE WHEN lo <> 1 OR hi <> n OR d <> n THEN 'ATTEMPTS_NOT_CONTIGUOUS' END, CASE WHEN r = 0 THEN 'ATTEMPTS_WITHOUT_REPORT' END,
                 CASE WHEN r > 0 AND r <> n THEN 'ATTEMPT_COUNT_MISMATCH' END) AS issues,
               count(*) AS routes, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(ok) AS BIGINT) AS successes FROM a GROUP BY 1""",
    "benchmark_comparison_ready": """
        SELECT n_regionkey AS product_id, count(*) AS roles_required, count(*) FILTER (n >= 600) AS roles_ready,
               bool_and(coalesce(n >= 600, FALSE)) AS comparison_ready
        FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ON c_nationkey = n_nationkey
        GROUP BY 1""",
    "cutoff_scan_events": """
        SELECT 'events' AS operator, CAST(event_id AS VARCHAR) AS row_key, 'AFTER_CUTOFF:ts' AS code, 'ERROR' AS severity FROM events
        WHERE ts > TIMESTAMP '2024-01-30 12:00:00'
        UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), 'AFTER_CUTOFF:captured_at', 'ERROR' FROM events
        WHERE epoch_us(ts) + floor(value * 60000000) > epoch_us(TIMESTAMP '2024-01-30 12:00:00')""",
    "benchmark_binding_consistency": """
        WITH p AS (SELECT CAST(o_orderdate AS DATE) AS d, count(DISTINCT o_orderpriority || o_orderstatus) AS k,
                     min(sha256(o_orderpriority || o_orderstatus)) AS h, count(*) AS n FROM orders GROUP BY 1)
        SELECT concat_ws('|', CASE WHEN k > 1 THEN 'SERIES_HAS_SEVERAL_BINDINGS' END, CASE WHEN s > 1 THEN 'BINDING_SHARED_ACROSS_SERIES' END) AS issues,
               count(*) AS series, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT *, count(*) OVER (PARTITION BY h) AS s FROM p) GROUP BY 1""",
}
