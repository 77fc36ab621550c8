"""Orders as source observations of customers' runs, line items as their artifacts, suppliers as the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import observations as ob
from tidegauge.plans.views import table

# Scalar fields by the order key k, readable by both engines.
FIELDS = {
    "state": "CASE k % 11 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'LOST' WHEN 2 THEN 'PARTIAL' ELSE 'AVAILABLE' END",
    "query_status": "CASE WHEN k % 97 = 0 THEN 'GUESSED' WHEN s = 'P' THEN 'PARSER_DRIFT' WHEN s = 'O' AND k % 5 = 0 THEN 'ZERO_RESULT' ELSE 'QUALIFIED' END",
    "access_mode": "CASE WHEN k % 13 = 0 THEN 'SCRAPE' ELSE 'API' END",
    "age": "CASE WHEN k % 59 = 0 THEN NULL WHEN k % 53 = 0 THEN -1 ELSE k % 40 END",
    "role": "CASE WHEN k % 19 = 0 THEN '' WHEN k % 23 = 0 THEN 'FORUM' WHEN source % 4 = 0 THEN 'EXECUTION_TAPE' WHEN source % 4 = 2 THEN 'OFFICIAL_EVENT' ELSE 'NEWS_ARCHIVE' END",
    "items": "CASE WHEN k % 29 = 0 THEN -1 WHEN k % 31 = 0 THEN 1 - k % 2 WHEN s = 'O' AND k % 5 = 0 OR s = 'P' AND k % 3 > 0 THEN 0 ELSE 2 END",
    "zero": "(s = 'O' AND k % 5 = 0) <> (k % 37 = 0)",
    "flagged": "k % 17 = 0",
    "enabled_for_run": "k % 9 > 0",
    "activation": "CASE WHEN k % 21 = 0 THEN ' ' ELSE concat('A', CAST(source AS STRING)) END",
    "activation_line": "CASE WHEN k % 6 = 0 THEN 9 ELSE 1 END",
    "entitlement": "CASE WHEN k % 27 = 0 THEN '' ELSE concat('E', CAST(source AS STRING)) END",
}


def _tables(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_custkey AS run_id", "o_orderstatus AS s", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 20 HOURS AS decision_at",
        "o_orderkey % 100 + 1 AS source")
    # Dealt by order once, before they are hashed; an item without an order meets none.
    items = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", "l_returnflag AS flag").where("k IS NOT NULL").repartition(
        "k").distinct().selectExpr("*", "sha2(concat_ws(':', k, n), 256) AS sha256")
    hashes = items.groupBy("k").agg(F.sort_array(F.collect_set("sha256")).alias("h"))
    rows = orders.join(hashes, "k", "left").selectExpr("*", *[f"{e} AS {n}" for n, e in FIELDS.items()]).selectExpr(
        "run_id", "k AS row_index", "concat('s', source) AS source_id", "state", "access_mode", "decision_at",
        "timestamp_micros(unix_micros(decision_at) - age * 3600000000) AS attempted_at", "query_status",
        "CASE WHEN role <> '' THEN array(role) END AS roles_observed", "CAST(items AS BIGINT) AS qualified_items", "zero AS zero_result",
        "CASE WHEN k % 41 = 0 THEN concat(h, h) WHEN k % 43 = 0 THEN concat(h, array('XYZ')) ELSE h END AS raw_sha256s",
        "CASE WHEN flagged THEN array('CLOCK') END AS data_quality_flags", "enabled_for_run", "activation AS activation_id",
        "sha2(concat_ws(':', k, activation_line), 256) AS activation_evidence_sha256", "entitlement AS entitlement_id",
        "sha2(concat_ws(':', k, 2), 256) AS entitlement_evidence_sha256")
    artifacts = items.join(orders.select("k", "run_id", "source"), "k").selectExpr(
        "run_id", "concat('s', source + CASE WHEN n = 6 THEN 1 ELSE 0 END) AS source_id", "sha256",
        "CASE WHEN flag = 'R' THEN 'ACCESS_RECEIPT' ELSE 'RAW' END AS capture_kind")
    suppliers = table(spark, sf_dir, "supplier").where("s_suppkey % 17 <> 3").selectExpr("s_suppkey AS source")
    catalogue = suppliers.selectExpr(
        "concat('s', source) AS source_id", "CASE WHEN source % 8 = 0 THEN 'LICENSED' ELSE 'PUBLIC' END AS source_class",
        "array(CASE source % 4 WHEN 0 THEN 'EXECUTION_TAPE' WHEN 2 THEN 'OFFICIAL_EVENT' ELSE 'NEWS_ARCHIVE' END) AS roles", "array('API', 'EXPORT') AS access_modes",
        "source % 7 <> 1 AS enabled_by_default", "source % 8 = 0 AND source % 3 > 0 AS requires_entitlement")
    trust = suppliers.selectExpr("source", "explode(array('ACTIVATION', 'ENTITLEMENT')) AS binding").selectExpr(  # a new entry every month
        "*", "explode(sequence(DATE '1991-12-01', DATE '2009-12-01', INTERVAL 1 MONTH)) AS month").where("source % 15 <> 1").selectExpr(
        "concat('s', source) AS source_id", "binding", "concat(left(binding, 1), source) AS binding_id",
        "concat_ws('-', source, month, CASE WHEN source % 16 = 8 THEN binding ELSE '' END) AS entry_id",
        "CAST(month AS TIMESTAMP) AS valid_from", "CAST(add_months(month, 1) AS TIMESTAMP) AS valid_to")
    return rows, catalogue, artifacts, trust


def run_observations(spark, sf_dir):
    c = ob.check_run_observations(*_tables(spark, sf_dir))
    return c.groupBy(F.concat_ws("|", "issue_codes").alias("issues"), "stale", "contributes").agg(F.count("*").alias("rows"), F.sum("row_index").alias("checksum"))


QUERIES = {"network_run_observations": run_observations}

_IN = "effective IN ('QUALIFIED', 'ZERO_RESULT')"
CODES = {
    "SOURCE_UNKNOWN": "NOT known", "SOURCE_REPEATED": "k > first_k", "ACCESS_STATE_UNKNOWN": "state = 'LOST'", "QUERY_STATUS_UNKNOWN": "query_status = 'GUESSED'",
    "ACCESS_MODE_OUTSIDE_CONTRACT": "known AND access_mode = 'SCRAPE'", "ATTEMPT_TIME_MISSING": "age IS NULL", "ATTEMPTED_AFTER_DECISION": "age < 0",
    "ROLES_MISSING": "role = ''", "ROLES_OUTSIDE_CONTRACT": "known AND role = 'FORUM'", "QUALIFIED_ITEMS_INVALID": "items < 0",
    "ZERO_RESULT_CONTRADICTS_STATUS": "zero <> (effective = 'ZERO_RESULT')", "QUALIFIED_WITHOUT_ITEMS": "effective = 'QUALIFIED' AND items <= 0",
    "ZERO_RESULT_WITH_ITEMS": "effective = 'ZERO_RESULT' AND items <> 0", "ITEMS_WITHOUT_QUALIFICATION": f"NOT {_IN} AND items <> 0",
    "EVIDENCE_HASH_MALFORMED": "k % 43 = 0 AND k % 41 <> 0 AND n > 0", "EVIDENCE_HASH_REPEATED": "k % 41 = 0 AND n > 0",
    "EVIDENCE_NOT_OF_SOURCE": f"{_IN} AND NOT resolved", "ONLY_ACCESS_RECEIPTS": f"{_IN} AND resolved AND NOT usable",
    "ACTIVATION_MISSING": "q AND dis AND NOT (enabled_for_run AND trim(activation) <> '')",
    "ACTIVATION_EVIDENCE_UNRESOLVED": "q AND dis AND NOT (activation_line = 1 AND has1)",
    "ENTITLEMENT_UNRESOLVED": "q AND ent AND NOT (entitlement <> '' AND receipt2)",
    "TRUST_NOT_UNIQUE": "q AND (dis OR ent) AND (source % 15 = 1 OR age IS NULL OR (dis AND activation = ' ') OR (ent AND entitlement = ''))",
    "TRUST_BINDING_CHANGED": "q AND changed AND source % 15 <> 1 AND ((dis AND activation <> ' ') OR (ent AND entitlement <> ''))",
    "TRUST_ENTRIES_DIFFER": "q AND dis AND ent AND source % 16 = 8 AND source % 15 <> 1 AND age IS NOT NULL AND activation <> ' ' AND entitlement <> ''",
    "EXECUTION_TAPE_WITHOUT_LICENCE": "q AND known AND role = 'EXECUTION_TAPE' AND NOT (source % 8 = 0 AND ent)",
}
ORACLE = {
    "network_run_observations": """WITH i AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n, bool_and(l_linenumber <> 6) AS resolved,
          bool_or(l_returnflag <> 'R') FILTER (l_linenumber <> 6) AS usable, bool_or(l_linenumber = 1) AS has1,
          bool_or(l_linenumber = 2 AND l_returnflag = 'R') AS receipt2 FROM lineitem GROUP BY 1),
        o AS (SELECT o_orderkey AS k, o_custkey AS run_id, o_orderstatus AS s, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 20 HOURS AS decision_at, o_orderkey % 100 + 1 AS source FROM orders),
        f AS (SELECT *, """ + ", ".join(f"{e} AS {n}" for n, e in FIELDS.items() if n != "age") + ", " + FIELDS["age"] + """ AS age,
          source % 17 <> 3 AND source IN (SELECT s_suppkey FROM supplier) AS known, min(k) OVER (PARTITION BY run_id, source) AS first_k FROM o),
        j AS (SELECT f.*, coalesce(n, 0) AS n, coalesce(resolved AND NOT (k % 43 = 0 AND k % 41 <> 0), FALSE) AS resolved, coalesce(usable, FALSE) AS usable, coalesce(has1, FALSE) AS has1,
          coalesce(receipt2, FALSE) AS receipt2, coalesce(age > 36, FALSE) AS stale, known AND source % 7 = 1 AS dis, known AND source % 8 = 0 AND source % 3 > 0 AS ent,
          CASE WHEN age > 36 THEN 'DATA_QUALITY_REJECTED' ELSE query_status END AS effective,
          coalesce(date_trunc('month', decision_at) <> date_trunc('month', decision_at - to_hours(age::BIGINT)), FALSE) AS changed FROM f LEFT JOIN i USING (k)),
        q AS (SELECT *, effective IN ('QUALIFIED', 'ZERO_RESULT') AND state IN ('AVAILABLE', 'PARTIAL') AND NOT flagged AS q FROM j),
        t AS (SELECT k, stale, q, concat_ws('|', """ + ", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in CODES.items()) + """) AS issues FROM q)
        SELECT issues, stale, q AND issues = '' AS contributes, count(*) AS rows, CAST(sum(k) AS BIGINT) AS checksum FROM t GROUP BY 1, 2, 3""",
}
