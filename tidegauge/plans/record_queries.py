"""Contracts of research records: findings, observations, parsed inputs, manifests, replay, notices, tables read as JSON.

Every input is spelled from whole driver tables by expressions that Spark and the oracle read alike; defects are seeded
in columns, so that clean and defective rows are both in the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.digest import merkle_tree
from tidegauge.operators import contracts as ct
from tidegauge.operators import events as ev
from tidegauge.operators import foundation as fd
from tidegauge.operators import lab, ledger, network, prices, scan
from tidegauge.operators import reconcile as rec
from tidegauge.plans.ledger_queries import log, tree_sql
from tidegauge.plans.views import SQL, table, with_views
from tidegauge.session import materialise, shared_dir
from tidegauge.sources import files, html

DAY = "CAST(o_orderdate AS TIMESTAMP)"


def hours(expression: str, n: str) -> str:
    return f"{expression} + ({n}) * INTERVAL '1' HOUR"


def tally(checked: DataFrame, number: str) -> DataFrame:
    return checked.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(
        F.count("*").alias("rows"), F.sum(F.col(number).cast("bigint")).alias("ids"))


def tally_sql(codes: dict[str, str], number: str, source: str) -> str:
    cases = ", ".join(f"CASE WHEN {condition} THEN '{code}' END" for code, condition in codes.items())
    return f"SELECT concat_ws('|', {cases}) AS issues, count(*) AS rows, CAST(sum({number}) AS BIGINT) AS ids FROM {source} GROUP BY 1"


# --- exposures -------------------------------------------------------------------------
EXPOSURES = [
    "l_orderkey AS canonical_event_id", "l_suppkey AS code", "l_partkey", "l_linenumber",
    "CASE WHEN l_linenumber % 3 = 0 THEN 'DIRECT_NAMED' WHEN l_linenumber % 3 = 1 THEN 'SECTOR_EXPOSURE' ELSE 'MACRO' END AS exposure_type",
    "CAST(l_partkey % 5 AS STRING) AS sector_code", "l_shipdate AS available_at", "l_returnflag = 'A' AS factor_eligible"]
CONTEXT = [
    "o_orderkey AS canonical_event_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'SECURITY' ELSE 'SECTOR' END AS scope",
    "CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 50 ELSE o_custkey % 5 END AS STRING) AS scope_key", "o_orderdate",
    "CASE WHEN o_orderstatus = 'P' THEN 'ROUTING_ONLY' ELSE 'OFFICIAL_CONFIRMED' END AS factual_status",
    "CASE WHEN o_orderkey % 11 = 0 THEN 'SUPERSEDED' ELSE 'CURRENT' END AS correction_status"]


def exposures(spark, sf_dir):
    """Line items as exposures of their order, of which every seventeenth is unknown; suppliers but each tenth are the universe."""
    e = table(spark, sf_dir, "orders").where("o_orderkey % 17 <> 0").selectExpr(*CONTEXT).withColumns({
        "first_available_at": F.col("o_orderdate") + F.expr("INTERVAL 20 DAYS"), "decision_at": F.lit("1999-01-01").cast("timestamp"),
        "evidence_hashes": F.array(F.sha2(F.col("canonical_event_id").cast("string"), 256))}).drop("o_orderdate")
    x = table(spark, sf_dir, "lineitem").selectExpr(*EXPOSURES).withColumns({
        "decision_at": F.when(F.col("l_linenumber") == 5, F.lit("1999-01-02")).otherwise(F.lit("1999-01-01")).cast("timestamp"),
        "evidence_hashes": F.array(F.sha2((F.col("canonical_event_id") + F.when(F.col("l_partkey") % 13 == 0, 1).otherwise(0)).cast("string"), 256))})
    universe = table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("code"))
    return tally(ev.bind_exposures(x, e, universe), "canonical_event_id")


EXPOSURE_SQL = "WITH x AS (SELECT " + ", ".join(EXPOSURES) + " FROM lineitem), e AS (SELECT " + ", ".join(CONTEXT) + """ FROM orders WHERE o_orderkey % 17 <> 0),
    j AS (SELECT x.*, e.scope, e.scope_key, e.o_orderdate, e.factual_status, e.correction_status, e.scope IS NOT NULL AS found
          FROM x LEFT JOIN e USING (canonical_event_id)) """ + tally_sql({
    "EXPOSURE_OUTSIDE_DENOMINATOR": "code % 10 = 0", "EXPOSURE_EVENT_UNRESOLVED": "NOT found",
    "EXPOSURE_PREDATES_EVENT": "available_at < o_orderdate + INTERVAL 20 DAY", "EXPOSURE_CUTOFF_DIFFERS": "found AND l_linenumber = 5",
    "EXPOSURE_EVIDENCE_UNBOUND": "found AND l_partkey % 13 = 0",
    "DIRECT_NAMED_SCOPE_CONFLICT": "exposure_type = 'DIRECT_NAMED' AND scope = 'SECURITY' AND scope_key <> CAST(code AS STRING)",
    "SECTOR_SCOPE_CONFLICT": "exposure_type = 'SECTOR_EXPOSURE' AND scope = 'SECTOR' AND scope_key <> sector_code",
    "SUPERSEDED_EVENT_NOT_ELIGIBLE": "factor_eligible AND correction_status = 'SUPERSEDED'",
    "UNCONFIRMED_EVENT_NOT_ELIGIBLE": "factor_eligible AND factual_status = 'ROUTING_ONLY'"}, "canonical_event_id", "j")

# --- findings, observations, parsed inputs, run manifest --------------------------------
FINDINGS = [
    "page_id", "concat('s', CAST(page_id % 12 AS STRING)) AS source_id", "url AS source_url", "page_id % 9 AS n",
    "CASE page_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'F' ELSE 'C' END AS timing_grade",
    "CASE WHEN page_id % 19 = 0 THEN 'GOSSIP' WHEN page_id % 4 = 0 THEN 'CATALYST' ELSE 'PRICE_ACTIVITY' END AS signal_kind"]
SOURCE_ROLES = ["OFFICIAL_EVENT", "PRICE_HISTORY", "NEWS_ARCHIVE"]


def _sources(spark, sf_dir):
    """Eleven sources seen in the pages, each allowed one domain."""
    n = F.col("page_id") % 12
    return table(spark, sf_dir, "pages").where(n != 11).select(n.alias("n")).distinct().select(
        F.concat(F.lit("s"), F.col("n").cast("string")).alias("source_id"),
        F.when(F.col("n") % 2 == 0, "example.com").otherwise("example.org").alias("allowed_domain"),
        F.lit(SOURCE_ROLES[:2]).alias("roles"), F.lit("B").alias("timing_ceiling"), F.lit("EDITORIAL").alias("source_class"))


def _findings(spark, sf_dir):
    role = F.when(F.col("page_id") % 5 == 0, "NEWS_ARCHIVE").when(F.col("page_id") % 4 == 0, "OFFICIAL_EVENT").otherwise("PRICE_HISTORY")
    at = F.lit("2024-01-10").cast("timestamp")
    return table(spark, sf_dir, "pages").selectExpr(*FINDINGS).withColumns({
        "evidence_roles": F.array(role), "strength": F.when(F.col("page_id") % 23 == 0, 1.5).otherwise(0.5), "materiality": F.lit(0.5),
        "decision_at": at, "available_at": at - F.expr("make_interval(0, 0, 0, 0, CAST(n * 10 - 5 AS INT))"),
        "published_at": at - F.expr("make_interval(0, 0, 0, 0, 30)"), "direction": F.lit("POSITIVE")})


def finding_contract(spark, sf_dir):
    c = network.check_findings(_findings(spark, sf_dir), _sources(spark, sf_dir), 36)
    return c.groupBy(F.concat_ws("|", "issue_codes").alias("issues"), "stale").agg(F.count("*").alias("rows"), F.sum("page_id").alias("ids"))


SQL["find"] = "SELECT " + ", ".join(FINDINGS) + """, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host,
    CASE WHEN page_id % 5 = 0 THEN 'NEWS_ARCHIVE' WHEN page_id % 4 = 0 THEN 'OFFICIAL_EVENT' ELSE 'PRICE_HISTORY' END AS role,
    CASE WHEN page_id % 2 = 0 THEN 'example.com' ELSE 'example.org' END AS allowed, page_id % 12 <> 11 AS known FROM pages"""
FINDING_SQL = with_views(["find"], "SELECT * FROM (" + tally_sql({
    "SOURCE_UNKNOWN": "NOT known", "SOURCE_DOMAIN_MISMATCH": "known AND NOT (host = allowed OR host LIKE '%.' || allowed)",
    "TIMING_GRADE_ABOVE_CEILING": "known AND timing_grade < 'B'", "SIGNAL_KIND_UNKNOWN": "signal_kind = 'GOSSIP'",
    "ROLE_NOT_HELD_BY_SOURCE": "known AND role = 'NEWS_ARCHIVE'",
    "ROLE_SIGNAL_MISMATCH": "NOT ((role = 'NEWS_ARCHIVE' AND signal_kind = 'CATALYST') OR (role = 'OFFICIAL_EVENT' AND signal_kind = 'CATALYST')"
                            " OR (role = 'PRICE_HISTORY' AND signal_kind = 'PRICE_ACTIVITY'))",
    "STRENGTH_OUT_OF_RANGE": "page_id % 23 = 0", "FINDING_FROM_FUTURE": "n * 10 - 5 < 0", "PUBLISHED_AFTER_AVAILABLE": "n * 10 - 5 > 30"},
    "page_id", "find").replace("SELECT concat_ws", "SELECT n * 10 - 5 > 36 AS stale, concat_ws", 1).replace("GROUP BY 1", "GROUP BY 1, 2") + ")")

OBSERVATIONS = [
    "event_id", "concat('s', CAST(user_id % 20 AS STRING)) AS source_id",
    "CASE WHEN event_id % 29 = 0 THEN 'same' ELSE concat('q', CAST(event_id AS STRING)) END AS query_id",
    "CASE event_id % 8 WHEN 0 THEN 'AVAILABLE' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'BLOCKED' WHEN 3 THEN 'SOMEHOW' ELSE 'AVAILABLE' END AS access_state",
    "CASE event_id % 3 WHEN 0 THEN 'QUALIFIED' WHEN 1 THEN 'ZERO_RESULT' ELSE 'FAILED' END AS query_status", "ts AS observed_at",
    "CAST(event_id % 4 AS INT) AS result_count"]


def observations(spark, sf_dir):
    """Events as source observations before 20 January; the manifest lacks the hash of every seventh."""
    o = table(spark, sf_dir, "events").selectExpr(*OBSERVATIONS).withColumns(
        {"raw_sha256": F.sha2(F.col("event_id").cast("string"), 256), "decision_at": F.lit("2024-01-20").cast("timestamp")})
    manifest = o.where("event_id % 7 <> 0").select(F.col("raw_sha256").alias("sha256"))
    c = ct.check_source_observations(o, manifest)
    return c.groupBy(F.concat_ws("|", "issue_codes").alias("issues"), "contributes").agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


OBSERVATION_SQL = "WITH o AS (SELECT *, count(*) OVER (PARTITION BY source_id, query_id) AS n FROM (SELECT " + ", ".join(OBSERVATIONS) + """ FROM events)),
    c AS (SELECT *, query_status IN ('QUALIFIED', 'ZERO_RESULT') AS q FROM o),
    t AS (SELECT event_id, q, concat_ws('|', CASE WHEN n > 1 THEN 'OBSERVATION_DUPLICATE' END, CASE WHEN access_state = 'SOMEHOW' THEN 'ACCESS_STATE_UNKNOWN' END,
      CASE WHEN observed_at > TIMESTAMP '2024-01-20' THEN 'OBSERVED_AFTER_DECISION' END, CASE WHEN q AND access_state NOT IN ('AVAILABLE', 'PARTIAL') THEN 'QUALIFIED_WITHOUT_ACCESS' END,
      CASE WHEN q AND event_id % 7 = 0 THEN 'QUALIFIED_WITHOUT_ARTIFACT' END, CASE WHEN query_status = 'ZERO_RESULT' AND result_count > 0 THEN 'ZERO_RESULT_WITH_ROWS' END) AS issues FROM c)
    SELECT issues, q AND issues = '' AS contributes, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM t GROUP BY 1, 2"""


def parsed_inputs(spark, sf_dir):
    """Pages as parsed inputs; every sixth hash was captured by another source."""
    f = _findings(spark, sf_dir).withColumns({
        "raw_sha256": F.sha2(F.col("page_id").cast("string"), 256), "source_class": F.when(F.col("page_id") % 10 == 0, "COMMUNITY").otherwise("EDITORIAL")})
    attempts = f.select(F.when(F.col("page_id") % 6 == 0, "other").otherwise(F.col("source_id")).alias("source_id"), "raw_sha256")
    return tally(fd.check_parsed_inputs(f, _sources(spark, sf_dir).select("source_id", "roles", F.col("source_class")), attempts), "page_id")


PARSED_SQL = with_views(["find"], tally_sql({
    "SOURCE_UNKNOWN": "NOT known", "CONTEXT_CLASS_MISMATCH": "known AND page_id % 10 = 0", "ROLE_NOT_HELD_BY_SOURCE": "known AND role = 'NEWS_ARCHIVE'",
    "EVIDENCE_NOT_OWNED_BY_SOURCE": "page_id % 6 = 0"}, "page_id", "find"))


def run_manifest(spark, sf_dir):
    """Pages as run artifacts, one an hour, decided after the hundredth; their addresses are the stored bytes."""
    page, root = F.col("page_id"), _folder(spark)
    f = _findings(spark, sf_dir).withColumns({
        "sha256": F.when(page % 14 == 0, "none").otherwise(F.sha2("source_url", 256)),
        "observed_at": F.expr("TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, CAST(page_id AS INT))"),
        "path": F.when(page % 16 == 0, "raw/same.html").otherwise(F.format_string("%s/%d.html", F.when(page % 9 == 0, "other").otherwise("raw"), page)),
        "size_bytes": F.octet_length("source_url") + (page % 22 == 0).cast("int"), "capture_kind": F.when(page % 26 == 0, "MEMORY").otherwise("RAW_PAGE")})
    files.store_artifacts(f.where("page_id % 5 <> 0 AND page_id % 16 <> 0").select("path", F.col("source_url").alias("content")), root)
    checked = fd.check_run_manifest(f, _sources(spark, sf_dir), F.expr("TIMESTAMP '2024-01-05 04:00:00'"), files.scan_artifacts(spark, root))
    return tally(checked, "page_id")


MANIFEST_SQL = with_views(["find"], tally_sql({
    "URL_NOT_ABSOLUTE_HTTPS": "source_url NOT LIKE 'https://%'", "URL_HAS_FRAGMENT": "regexp_matches(source_url, '#.')", "SOURCE_UNKNOWN": "NOT known",
    "SOURCE_DOMAIN_MISMATCH": "known AND NOT (host = allowed OR host LIKE '%.' || allowed)", "OBSERVED_AFTER_DECISION": "page_id > 100",
    "SHA256_FORM": "page_id % 14 = 0", "PATH_OUTSIDE_RAW": "page_id % 9 = 0 AND page_id % 16 <> 0", "PATH_DUPLICATE": "page_id % 16 = 0",
    "ARTIFACT_MISSING": "page_id % 5 = 0 OR page_id % 16 = 0", "ARTIFACT_HASH_MISMATCH": "page_id % 5 <> 0 AND page_id % 16 <> 0 AND page_id % 14 = 0",
    "ARTIFACT_SIZE_MISMATCH": "page_id % 5 <> 0 AND page_id % 16 <> 0 AND page_id % 22 = 0", "CAPTURE_KIND_INVALID": "page_id % 26 = 0"}, "page_id", "find"))

# --- replay rows ---------------------------------------------------------------------
REPLAY = [
    "l_orderkey", "l_linenumber", "l_extendedprice / l_quantity AS entry_price", "l_extendedprice / l_quantity * (1 + l_tax) AS exit_price",
    "CAST(CASE WHEN l_partkey % 31 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS market_entry", "CAST(1.01 AS DOUBLE) AS market_exit", "CAST(1 AS DOUBLE) AS sector_entry",
    "CAST(1.02 AS DOUBLE) AS sector_exit", "CAST(CASE WHEN l_partkey % 37 = 0 THEN -1 ELSE 0.001 END AS DOUBLE) AS cost_return",
    "CAST(1 AS DOUBLE) AS adjustment_factor", "CAST(l_discount AS DOUBLE) AS cash_return", "l_linenumber = 1 AS selected", "l_partkey % 41 = 0 AS abstained",
    "l_shipdate AS decision_at"]


def replay_rows(spark, sf_dir):
    """Line items as replay rows; some inputs are known late, some outcomes early."""
    r = table(spark, sf_dir, "lineitem").selectExpr(*REPLAY, "l_partkey")
    at = F.col("decision_at")
    day = F.expr("INTERVAL 1 DAY")
    r = r.withColumns({
        "identity_available_at": F.when(F.col("l_partkey") % 43 == 0, at + day).otherwise(at), "sector_available_at": at, "feature_available_at": at - day,
        "score_computed_at": F.when(F.col("l_partkey") % 47 == 0, at - day - day).otherwise(at), "outcome_available_at": F.when(F.col("l_partkey") % 53 == 0, at).otherwise(at + day)})
    c = fd.replay_returns(fd.check_replay_rows(r))
    return c.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(
        F.count("*").alias("rows"), *[F.round(F.avg(F.round(x, 6)), 6).alias(x) for x in ("gross", "net", "market_excess", "sector_excess")])


REPLAY_SQL = "WITH r AS (SELECT " + ", ".join(REPLAY) + """, l_partkey AS p FROM lineitem), g AS (SELECT *, exit_price * adjustment_factor / entry_price - 1 + cash_return AS gross FROM r)
    SELECT concat_ws('|', CASE WHEN p % 43 = 0 THEN 'LOOK_AHEAD:identity_available_at' END, CASE WHEN p % 47 = 0 THEN 'SCORE_BEFORE_FEATURES' END,
      CASE WHEN p % 53 = 0 THEN 'OUTCOME_NOT_AFTER_DECISION' END, CASE WHEN p % 31 = 0 THEN 'PRICE_NOT_POSITIVE' END, CASE WHEN p % 37 = 0 THEN 'COST_INVALID' END,
      CASE WHEN selected AND abstained THEN 'SELECTED_WHILE_ABSTAINED' END) AS issues, count(*) AS rows, round(avg(round(gross, 6)), 6) AS gross,
      round(avg(round(gross - cost_return, 6)), 6) AS net,
      round(avg(round(CASE WHEN market_entry <> 0 THEN gross - cost_return - (market_exit / market_entry - 1) END, 6)), 6) AS market_excess,
      round(avg(round(gross - cost_return - (sector_exit / sector_entry - 1), 6)), 6) AS sector_excess FROM g GROUP BY 1"""

# --- notices, tables, benchmarks ------------------------------------------------------
NOTICES = [
    "o_orderkey", "o_custkey AS code", "CASE WHEN o_orderkey % 61 = 0 THEN 'same' ELSE CAST(o_orderkey AS STRING) END AS notice_id",
    "CASE WHEN o_custkey % 11 = 0 THEN 'x' ELSE concat('t', CAST(o_custkey AS STRING)) END AS ticker",
    "CASE o_orderstatus WHEN 'O' THEN 'SUSPEND' WHEN 'F' THEN 'RESUME' ELSE 'MERGE' END AS event_type", "CAST(o_orderdate AS DATE) AS effective_date",
    "CAST(o_orderdate AS DATE) AS published_date", "CASE WHEN o_orderkey % 9 = 0 THEN 'http://a.b/' ELSE 'https://a.b/' END AS source_url",
    "CASE WHEN o_orderkey % 21 = 0 THEN '' ELSE 'trading suspended' END AS classification_phrase"]


def notice_contract(spark, sf_dir):
    """Orders as status notices inside 1996 to 1998."""
    h = F.sha2(F.col("o_orderkey").cast("string"), 256)
    n = table(spark, sf_dir, "orders").selectExpr(*NOTICES).withColumns({"raw_sha256": h, "text_sha256": F.when(F.col("o_orderkey") % 25 == 0, "0").otherwise(h)})
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"))
    return tally(ct.check_notices(n, known, F.lit("1996-01-01").cast("date"), F.lit("1998-06-30").cast("date")), "o_orderkey")


NOTICE_SQL = "WITH n AS (SELECT *, count(*) OVER (PARTITION BY notice_id) AS n FROM (SELECT " + ", ".join(NOTICES) + " FROM orders)) " + tally_sql({
    "NOTICE_ID_DUPLICATE": "n > 1", "NOTICE_IDENTITY_MISMATCH": "ticker = 'x'", "NOTICE_TYPE_UNKNOWN": "event_type = 'MERGE'",
    "NOTICE_OUTSIDE_WINDOW": "NOT effective_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'",
    "NOTICE_PUBLISHED_AFTER_WINDOW": "published_date > DATE '1998-06-30'", "NOTICE_URL_NOT_HTTPS": "source_url LIKE 'http:%'",
    "NOTICE_EVIDENCE_FORM": "o_orderkey % 25 = 0", "NOTICE_PHRASE_REQUIRED": "classification_phrase = ''"}, "o_orderkey", "n")

EVENT_TABLE = [
    "l_orderkey", "l_suppkey AS code", "CASE WHEN l_partkey % 71 = 0 THEN NULL ELSE concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS item_id",
    "l_returnflag", "l_partkey", "l_shipdate AS published_at",
    "CASE l_returnflag WHEN 'A' THEN 'official' WHEN 'R' THEN 'pending' ELSE CASE WHEN l_partkey % 3 = 0 THEN 'guess' ELSE 'not_applicable' END END AS factor_status",
    "CASE WHEN l_partkey % 5 = 0 THEN 0.0 ELSE 0.9 END AS adjustment_factor"]


def event_tables(spark, sf_dir):
    """Line items as a disclosure table and as a corporate-action table."""
    li = table(spark, sf_dir, "lineitem").selectExpr(*EVENT_TABLE).withColumns({
        "raw_sha256": F.when(F.col("l_partkey") % 29 == 0, "x").otherwise(F.sha2(F.col("l_orderkey").cast("string"), 256)),
        "fetched_at": F.col("published_at") + F.when(F.col("l_partkey") % 17 == 0, F.expr("INTERVAL -1 DAY")).otherwise(F.expr("INTERVAL 1 DAY"))})
    parts = [tally(ct.check_event_table(li, d, "item_id"), "l_orderkey").withColumn("dataset", F.lit(d)) for d in ("disclosures", "corporate_actions")]
    return parts[0].unionByName(parts[1])


EVENT_TABLE_SQL = "WITH t0 AS (SELECT " + ", ".join(EVENT_TABLE) + " FROM lineitem), t AS (SELECT *, count(*) OVER (PARTITION BY code, item_id) AS n FROM t0) " + " UNION ALL ".join(
    f"SELECT *, '{d}' AS dataset FROM (" + tally_sql({
        "EVENT_IDENTITY_DUPLICATE": "n > 1", "EVENT_IDENTITY_MISSING": "item_id IS NULL", "RAW_SHA256_FORM": "l_partkey % 29 = 0", **c}, "l_orderkey", "t") + ")"
    for d, c in (("disclosures", {"FETCHED_BEFORE_PUBLISHED": "l_partkey % 17 = 0"}),
                 ("corporate_actions", {"FACTOR_STATUS_INVALID": "factor_status = 'guess'", "OFFICIAL_FACTOR_INVALID": "factor_status = 'official' AND l_partkey % 5 = 0"})))


def delistings(spark, sf_dir):
    """Orders as delistings of customers as of mid-1998, one customer in three more than once."""
    d = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).otherwise(-F.col("o_orderkey")).alias("code"),
        F.to_date("o_orderdate").alias("delisting_date"), F.when(F.col("o_orderkey") % 9 == 0, "http://a.b").otherwise("https://a.b").alias("source_url"))
    return tally(ct.check_delistings(d, F.lit("1998-06-30").cast("date")), "o_orderkey")


DELISTING_SQL = """WITH d AS (SELECT *, count(*) OVER (PARTITION BY CASE WHEN o_custkey % 3 = 0 THEN o_custkey ELSE -o_orderkey END) AS n FROM orders) """ + tally_sql({
    "DELISTED_IDENTITY_DUPLICATE": "n > 1", "DELISTING_AFTER_SNAPSHOT": "CAST(o_orderdate AS DATE) > DATE '1998-06-30'",
    "SOURCE_URL_NOT_HTTPS": "o_orderkey % 9 = 0"}, "o_orderkey", "d")


def benchmark_rows(spark, sf_dir):
    """Orders as benchmark values of their customer's nation; a registry of nations freezes currency and unit."""
    nations = table(spark, sf_dir, "nation")
    reg = nations.where("n_nationkey % 7 <> 0").select(
        F.col("n_nationkey").alias("benchmark_code"), F.lit("KWD").alias("currency"), F.when(F.col("n_nationkey") % 2 == 0, "points").alias("unit"))
    bound = nations.select(F.col("n_nationkey").alias("benchmark_code"), F.col("n_name").alias("raw_sha256"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("benchmark_code"), F.to_date("o_orderdate").alias("trade_date"),
        F.when(F.col("o_orderkey") % 13 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("benchmark_value"),
        F.when(F.col("o_orderkey") % 10 == 0, "USD").otherwise("KWD").alias("currency"), F.when(F.col("c_nationkey") % 2 == 0, "points").alias("unit"))
    rows = rows.join(nations.select(F.col("n_nationkey").alias("benchmark_code"), "n_name"), "benchmark_code").withColumn(
        "raw_sha256", F.when(F.col("o_orderkey") % 8 == 0, "other").otherwise(F.col("n_name"))).drop("n_name")
    return tally(ct.check_benchmark_rows(rows, reg, bound, ["currency", "unit"]), "o_orderkey")


BENCHMARK_SQL = """WITH r AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, CAST(o_orderdate AS DATE)) AS n FROM orders JOIN customer ON o_custkey = c_custkey) """ + tally_sql({
    "BENCHMARK_KEY_DUPLICATE": "n > 1", "BENCHMARK_NOT_REGISTERED": "c_nationkey % 7 = 0", "BENCHMARK_VALUE_INVALID": "o_orderkey % 13 = 0",
    "EVIDENCE_BINDING_MISMATCH": "o_orderkey % 8 = 0", "REGISTRY_FIELD:currency": "c_nationkey % 7 <> 0 AND o_orderkey % 10 = 0"}, "o_orderkey", "r")


def republished(spark, sf_dir):
    """Orders published with some totals changed, some rows gone and some added, against the table as it is and its saved tree."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total"))
    p = o.where("o_orderkey % 500 <> 1").withColumn("total", F.when(F.col("o_orderkey") % 4000 == 0, -1).otherwise(F.col("total"))).unionByName(
        o.where("o_orderkey % 600 = 2").withColumn("o_orderkey", -F.col("o_orderkey")))
    found = fd.recheck_published(p, o, ["o_orderkey"], "0" * 64, 1, merkle_tree(o))
    return found.groupBy("code").agg(F.count("*").alias("rows"), F.min("row_key").alias("first_key"), F.max("row_key").alias("last_key"))


def _order_tree(name: str, source: str) -> str:
    return ", ".join(tree_sql("1", """'{"o_custkey":' || o_custkey || ',"o_orderkey":' || k0 || ',"total":' || t || '}'""", source, name))


REPUBLISHED_SQL = f"""WITH o0 AS (SELECT o_custkey, o_orderkey AS k0, CAST(round(o_totalprice * 100) AS BIGINT) AS t FROM orders),
    p0 AS (SELECT o_custkey, k0, CASE WHEN k0 % 4000 = 0 THEN -1 ELSE t END AS t FROM o0 WHERE k0 % 500 <> 1 UNION ALL SELECT o_custkey, -k0, t FROM o0 WHERE k0 % 600 = 2),
    {_order_tree("saved", "o0")}, {_order_tree("now", "p0")},
    diff AS (SELECT coalesce(a.level, b.level) AS level, coalesce(a.prefix, b.prefix) AS prefix FROM saved_all a FULL JOIN now_all b ON a.level = b.level AND a.prefix = b.prefix
             WHERE a.h IS DISTINCT FROM b.h)
    SELECT code, count(*) AS rows, min(k) AS first_key, max(k) AS last_key FROM (
    SELECT 'PUBLISHED_ROW_MISSING' AS code, CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_orderkey % 500 = 1
    UNION ALL SELECT 'PUBLISHED_ROW_UNEXPECTED', CAST(-o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 600 = 2
    UNION ALL SELECT 'RECOMPUTED:total', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 4000 = 0
    UNION ALL SELECT 'SAVED_LEAF_MISMATCH', 'leaf ' || prefix FROM diff d WHERE NOT EXISTS (SELECT 1 FROM diff c WHERE c.level = d.level + 1 AND left(c.prefix, d.level) = d.prefix)
    UNION ALL SELECT unnest(['SAVED_DIGEST_MISMATCH', 'SAVED_ROW_COUNT_MISMATCH']), '*') GROUP BY 1"""


# --- series, samples, seals, gates ----------------------------------------------------
def duplicate_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("trade_date"))
    d = prices.duplicate_bars(li)
    return d.select("code", F.col("trade_date").cast("string").alias("trade_date"), "rows")


def date_order(spark, sf_dir):
    """First order of each customer and day, read in order of the order number."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("day")).agg(F.min("o_orderkey").alias("seq"))
    found = prices.increasing_dates(o, "code", "day", "seq")
    return found.groupBy("code").agg(F.count("*").alias("rows"), F.sum("seq").alias("seqs"))


DATE_ORDER_SQL = """SELECT code, count(*) AS rows, CAST(sum(seq) AS BIGINT) AS seqs FROM (SELECT *, lag(day) OVER (PARTITION BY code ORDER BY seq) AS p FROM (
    SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS day, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2)) WHERE day <= p GROUP BY 1"""


def causal_split(spark, sf_dir):
    """Orders with labels of thirty days: the part kept before 1997 passes the assertion, the whole does not."""
    day = F.col("o_orderdate").cast("timestamp")
    samples = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("feature_cutoff"), day.alias("label_start"), (day + F.expr("INTERVAL 30 DAYS")).alias("label_end"))
    test, train = samples.where("feature_cutoff >= TIMESTAMP '1997-01-01'"), samples.where("feature_cutoff < TIMESTAMP '1997-01-01'")
    purged = lab.purge_training(train, test, 0)
    lab.assert_causal(purged.where("kept").select(*train.columns), test)
    refused = False
    try:
        lab.assert_causal(train, test)
    except ValueError:
        refused = True
    return purged.groupBy("kept").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("ids")).withColumn("whole_refused", F.lit(refused))


CAUSAL_SQL = """SELECT d + INTERVAL 30 DAY < (SELECT min(o_orderdate) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01') AS kept, count(*) AS rows,
    CAST(sum(o_orderkey) AS BIGINT) AS ids, TRUE AS whole_refused FROM (SELECT o_orderkey, o_orderdate AS d FROM orders) WHERE d < TIMESTAMP '1997-01-01' GROUP BY 1"""


def seal_check(spark, sf_dir):
    """Seals of yesterday's log against today's: one ledger's count is off, one ledger has no seal."""
    rows = log(spark, sf_dir)
    saved = ledger.seal(rows).where("ledger_id <> 'signup'").withColumn("event_count", F.when(F.col("ledger_id") == "error", 0).otherwise(F.col("event_count")))
    c = ledger.verify_seals(rows, saved)
    return c.select("ledger_id", F.concat_ws("|", "issue_codes").alias("issues"))


SEAL_SQL = """SELECT DISTINCT event_type AS ledger_id, CASE event_type WHEN 'signup' THEN 'MISSING_SEAL' WHEN 'error' THEN 'SEAL_EVENT_COUNT' ELSE '' END AS issues FROM events"""


def scan_gate(spark, sf_dir):
    """Every event as a scan at its own time; sessions run from seven to thirteen on weekdays, first of the month excepted."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("scan_at"))
    days = e.select(F.to_date("scan_at").alias("trade_date")).distinct().where("day(trade_date) <> 1")
    start = F.col("trade_date").cast("timestamp")
    sessions = days.select("trade_date", F.dayofweek("trade_date").between(2, 6).alias("is_trading_day"),
                           (start + F.expr("INTERVAL 7 HOURS")).alias("open_at"), (start + F.expr("INTERVAL 13 HOURS")).alias("close_at"))
    g = scan.scan_gate(e, sessions)
    return g.groupBy(F.coalesce("abstain_reason", F.lit("RUN")).alias("reason")).agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


SCAN_SQL = """SELECT CASE WHEN day(ts) = 1 OR dayofweek(ts) IN (0, 6) THEN 'MARKET_CLOSED' WHEN CAST(ts AS TIME) < TIME '07:30:00' THEN 'SCAN_BEFORE_OPEN_PLUS_30_MINUTES'
    WHEN CAST(ts AS TIME) > TIME '13:00:00' THEN 'SCAN_AFTER_TRADING_SESSION' ELSE 'RUN' END AS reason, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1"""


def claim_verdict(spark, sf_dir):
    """Orders as claims; those of even customers are complete."""
    ok = F.col("o_custkey") % 2 == 0
    c = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 3).alias("evidence_count"), ok.alias("denominator_complete"), F.lit(True).alias("point_in_time"),
        F.lit(True).alias("corporate_actions_reconciled"), F.lit(True).alias("authority_verified"))
    return ct.audit_verdict(ct.audit_claims(c))


VERDICT_SQL = """SELECT count(*) AS claims, count(*) FILTER (WHERE o_custkey % 3 = 0 OR o_custkey % 2 <> 0) AS failed_claims, 'STOP_BACKTEST' AS status FROM orders"""

# --- JSON lines and HTML ---------------------------------------------------------------


def json_lines(spark, sf_dir):
    """Events written as observation lines and read back strictly: some lack a key, carry one too many or a time without offset."""
    n = F.col("event_id") % 10
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    factor = F.struct(F.lit("momentum").alias("factor_id"), F.col("value"), F.concat(time, F.lit("Z")).alias("known_at"), F.lit("s").alias("source_id"),
                      F.when(n == 5, None).otherwise("OPEN").alias("rights_status"), F.when(n == 6, "x").alias("note"))
    e = table(spark, sf_dir, "events").select("event_id", F.struct(
        F.lpad((F.col("user_id") % 10000).cast("string"), 4, "0").alias("official_code"), F.concat(time, F.when(n == 1, "").otherwise("Z")).alias("observed_at"),
        F.lit("s1").alias("source_id"), F.lit("PRIMARY").alias("source_role"), F.when(n == 2, None).otherwise("OPEN").alias("rights_status"),
        F.lit("REAL_TIME").alias("latency_class"), F.col("value").alias("last_price_sar"), F.col("value").alias("average_daily_turnover_sar"),
        F.lit(True).alias("identity_verified"), F.array(factor).alias("factors"), F.when(n == 3, 1).alias("extra")).alias("r"))
    lines = e.select("event_id", F.when(n == 4, "{not json").otherwise(F.to_json("r")).alias("value"))
    c = files.parse_json_lines(lines, files.OBSERVATION_SCHEMA)
    return c.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("rows"))


JSON_SQL = """SELECT CASE event_id % 10 WHEN 1 THEN 'TIMESTAMP_WITHOUT_OFFSET:observed_at' WHEN 2 THEN 'MISSING_KEYS' WHEN 3 THEN 'UNKNOWN_KEYS' WHEN 4 THEN 'JSON_UNREADABLE'
    WHEN 5 THEN 'MISSING_KEYS:factors' WHEN 6 THEN 'UNKNOWN_KEYS:factors' ELSE '' END AS issues, count(*) AS rows FROM events GROUP BY 1"""


def html_tables(spark, sf_dir):
    """Customers as pages with an identity table; some lack a column, some end in a short row."""
    k, cell = F.col("c_custkey"), lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    head = F.when(k % 7 == 0, "<tr><th>Sec Code</th><th>Name</th></tr>").otherwise("<tr><th>Sec. Code</th><th>Company Name</th><th>ISIN</th></tr>")
    short = F.when(k % 11 == 0, F.concat(F.lit("<tr>"), cell(k), F.lit("</tr>"))).otherwise("")
    pages = table(spark, sf_dir, "customer").select(k.alias("page_id"), F.concat(
        F.lit("<html><table>"), head, F.lit("<tr>"), cell(k), cell(F.col("c_name")), cell(F.concat(F.lit("KW"), k.cast("string"))), F.lit("</tr>"), short,
        F.lit("</table></html>")).alias("html"))
    rows, issues = html.read_tables(pages, html.LAYOUTS["identity"])
    a = rows.agg(F.lit("ROWS").alias("code"), F.count("*").alias("rows"), F.sum(F.col("security_code").cast("bigint")).alias("ids"))
    return a.unionByName(issues.groupBy("code").agg(F.count("*").alias("rows"), F.sum(F.col("row_key").cast("bigint")).alias("ids")))


HTML_SQL = """SELECT 'ROWS' AS code, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer WHERE c_custkey % 7 <> 0
    UNION ALL SELECT 'REQUIRED_TABLE_HEADERS_NOT_FOUND', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer WHERE c_custkey % 7 = 0
    UNION ALL SELECT 'SHORT_TABLE_ROW', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 = 0"""


# --- status history, action ids, query counts, bindings, provider rows -------------------
HISTORY = [
    "o_orderkey", "o_custkey AS code", "CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'cash' END AS board",
    "CASE o_orderstatus WHEN 'O' THEN 'trading' WHEN 'F' THEN 'SUSPENDED' ELSE 'ASLEEP' END AS status", "CAST(o_orderdate AS DATE) AS effective_from"]


def status_history(spark, sf_dir):
    """Orders as status intervals of two months; every ninth ends before it starts, every fourth customer is unknown."""
    rows = table(spark, sf_dir, "orders").selectExpr(*HISTORY).withColumns({
        "effective_to": F.date_add("effective_from", F.when(F.col("o_orderkey") % 9 == 0, -1).otherwise(60).cast("int")),
        "raw_sha256": F.sha2(F.col("o_orderkey").cast("string"), 256)})
    manifest = rows.where("o_orderkey % 7 <> 0").select(F.col("raw_sha256").alias("sha256"))
    codes = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("code"))
    c = ct.check_status_history(rows.where("o_orderkey % 9 <> 0"), manifest, codes)
    bad = ct.check_status_history(rows.where("o_orderkey % 9 = 0").withColumn("board", F.col("o_orderkey").cast("string")), manifest, codes)
    return tally(c.unionByName(bad), "o_orderkey")


HISTORY_SQL = "WITH h AS (SELECT *, effective_from + CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE 60 END AS effective_to FROM (SELECT " + ", ".join(HISTORY) + """ FROM orders)),
    w AS (SELECT o_orderkey, code, board, effective_from, effective_to FROM h WHERE o_orderkey % 9 <> 0),
    o AS (SELECT DISTINCT a.code, a.board FROM w a JOIN w b ON a.code = b.code AND a.board = b.board AND a.o_orderkey < b.o_orderkey
          AND a.effective_from <= b.effective_to AND b.effective_from <= a.effective_to),
    j AS (SELECT h.*, o.code IS NOT NULL AND o_orderkey % 9 <> 0 AS over FROM h LEFT JOIN o ON o.code = h.code AND o.board = h.board) """ + tally_sql({
    "STATUS_CODE_UNKNOWN": "code % 4 = 0", "STATUS_OR_BOARD_INVALID": "status = 'ASLEEP' OR (board = '' AND o_orderkey % 9 <> 0)",
    "EFFECTIVE_TO_PRECEDES_FROM": "o_orderkey % 9 = 0", "RAW_SHA256_UNRESOLVED": "o_orderkey % 7 = 0", "STATUS_OVERLAP": "over"}, "o_orderkey", "j")


def action_ids(spark, sf_dir):
    """Stable ids of line items as scheduled actions: repeated captures of one row have one id."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("code"), F.concat(F.lit("KW"), F.col("l_partkey").cast("string")).alias("isin"), F.to_date("l_shipdate").alias("ex_date"),
        F.date_sub(F.to_date("l_shipdate"), 1).alias("cum_date"), F.date_add(F.to_date("l_shipdate"), 1).alias("record_date"),
        F.when(F.col("l_linenumber") % 2 == 0, F.date_add(F.to_date("l_shipdate"), 9)).alias("payment_date"), F.sha2(F.col("l_orderkey").cast("string"), 256).alias("raw_sha256"))
    ids = li.select("code", ct.stable_action_id().alias("action_id"))
    return ids.groupBy("code").agg(F.count("*").alias("rows"), F.count_distinct("action_id").alias("actions"), F.min("action_id").alias("first_id"))


ACTION_SQL = """SELECT l_suppkey AS code, count(*) AS rows, count(DISTINCT id) AS actions, min(id) AS first_id FROM (SELECT l_suppkey, 'ca-schedule-' || substr(sha256(concat_ws(chr(0),
    l_suppkey, 'KW' || l_partkey, CAST(l_shipdate AS DATE) - 1, CAST(l_shipdate AS DATE), CAST(l_shipdate AS DATE) + 1,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_shipdate AS DATE) + 9 AS VARCHAR) ELSE '' END, sha256(CAST(l_orderkey AS VARCHAR)))), 1, 24) AS id FROM lineitem) GROUP BY 1"""


def notice_counts(spark, sf_dir):
    """Line items as notices of the query that is their order; every tenth order declares one row too many, some are not declared."""
    notices = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"))
    sizes = notices.groupBy("query_id").agg(F.count("*").alias("n"))
    declared = table(spark, sf_dir, "orders").where("o_orderkey % 23 <> 0").select(F.col("o_orderkey").alias("query_id")).join(sizes, "query_id", "left").select(
        "query_id", (F.coalesce("n", F.lit(0)) + F.when(F.col("query_id") % 10 == 0, 1).otherwise(0)).alias("rows_normalized"))
    return tally(ct.reconcile_notice_counts(declared, notices), "query_id")


COUNT_SQL = """WITH n AS (SELECT l_orderkey AS q FROM lineitem GROUP BY 1), j AS (SELECT coalesce(o_orderkey, q) AS id, o_orderkey IS NULL AS unknown
    FROM (SELECT * FROM orders WHERE o_orderkey % 23 <> 0) FULL JOIN n ON q = o_orderkey) """ + tally_sql({
    "QUERY_UNKNOWN": "unknown", "QUERY_NOTICE_RECONCILIATION": "NOT unknown AND id % 10 = 0"}, "id", "j")


def universe_bindings(spark, sf_dir):
    """Last orders as identity bindings of three months, decided on 1 June 1998; customers but each seventh are covered."""
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.to_date(F.max("o_orderdate")).alias("valid_from"))
    b = b.withColumn("valid_to", F.date_add("valid_from", F.when(F.col("code") % 11 == 0, -5).otherwise(90).cast("int")))
    b = b.unionByName(b.where("code % 13 = 0"))
    covered = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("code"))
    return tally(rec.binding_checks(b, covered, F.lit("1998-06-01").cast("date")), "code")


BINDING_SQL = """WITH b AS (SELECT o_custkey AS code, CAST(max(o_orderdate) AS DATE) AS f FROM orders GROUP BY 1),
    d AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE code % 13 = 0),
    j AS (SELECT coalesce(c_custkey, code) AS id, code, c_custkey, f, f + CASE WHEN code % 11 = 0 THEN -5 ELSE 90 END AS t
          FROM d FULL JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) c ON c_custkey = code) """ + tally_sql({
    "BINDING_MISSING": "code IS NULL", "BINDING_OUTSIDE_COVERED": "c_custkey IS NULL", "BINDING_CODE_NOT_UNIQUE_NUMERIC": "code % 13 = 0",
    "BINDING_INTERVAL_REVERSED": "t < f", "BINDING_NOT_EFFECTIVE": "f > DATE '1998-06-01' OR t < DATE '1998-06-01'"}, "id", "j")

PROVIDER = [
    "l_orderkey", "l_partkey", "l_suppkey % 50 AS code", "CAST(l_shipdate AS DATE) AS trade_date",
    "CASE WHEN l_partkey % 19 = 0 THEN 'other' ELSE concat('T', CAST(l_suppkey % 50 AS STRING)) END AS ticker",
    "CASE l_linenumber WHEN 1 THEN 'NO_TRADE' WHEN 2 THEN 'SUSPENDED' WHEN 3 THEN 'NOT_LISTED_OR_NOT_ELIGIBLE' ELSE 'TRADED' END AS trading_state",
    "CASE WHEN l_linenumber IN (1, 2, 3) AND l_partkey % 5 <> 0 THEN '' WHEN l_partkey % 23 = 0 THEN '{{open}}' ELSE '10' END AS open_fils",
    "CASE WHEN l_linenumber IN (1, 2, 3) THEN '' ELSE '12' END AS high_fils", "CASE WHEN l_linenumber IN (1, 2, 3) THEN '' ELSE '9' END AS low_fils",
    "CASE WHEN l_linenumber IN (1, 2, 3) THEN '' ELSE '11' END AS close_fils", "CASE WHEN l_partkey % 7 = 0 THEN '0' ELSE '500' END AS volume",
    "CASE WHEN l_partkey % 29 = 0 THEN '1.5' ELSE '' END AS value_traded_kwd", "CASE WHEN l_linenumber IN (1, 2, 3) THEN '0' ELSE '3' END AS trade_count",
    "CASE WHEN l_partkey % 31 = 0 THEN '-1' ELSE '' END AS reference_price_fils"]


def provider_rows(spark, sf_dir):
    """Line items as provider rows that do not supply traded values; fifty codes with one identity and one status each."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*PROVIDER, "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS row_id")
    days = rows.select("trade_date").distinct().withColumn("is_trading_day", F.dayofmonth("trade_date") != 13)
    codes = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).alias("code")).distinct()
    ticker, first, code = F.concat(F.lit("T"), F.col("code").cast("string")), F.lit("1990-01-01").cast("date"), F.col("code")
    identity = codes.where("code % 10 <> 9").select(
        "code", ticker.alias("ticker"), first.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.when(code % 10 == 8, "DELISTED").otherwise("ACTIVE").alias("listing_status"))
    status = codes.select("code", ticker.alias("ticker"), first.alias("effective_from"), F.lit(None).cast("date").alias("effective_to"),
                          F.when(code % 10 == 7, "SUSPENDED").when(code % 10 == 8, "DELISTED").otherwise("TRADING").alias("status"))
    return tally(ct.check_provider_rows(rows, days, identity, status, ["OHLC", "VOLUME", "TRADE_COUNT", "REFERENCE_PRICE"]), "l_orderkey")


PROVIDER_SQL = "WITH p AS (SELECT " + ", ".join(PROVIDER) + """ FROM lineitem), j AS (SELECT *, trading_state = 'TRADED' AS traded,
      CASE code % 10 WHEN 7 THEN 'SUSPENDED' WHEN 8 THEN 'DELISTED' ELSE 'TRADING' END AS s FROM p) """ + tally_sql({
    "PLACEHOLDER": "open_fils LIKE '{{%'", "NOT_AN_OFFICIAL_SESSION": "day(trade_date) = 13", "IDENTITY_NOT_UNIQUE_ON_DATE": "code % 10 = 9",
    "TICKER_MISMATCH": "ticker = 'other'",
    "STATE_CONFLICTS_WITH_STATUS": "NOT ((s = 'TRADING' AND trading_state IN ('TRADED', 'NO_TRADE')) OR (s = 'SUSPENDED' AND trading_state = 'SUSPENDED')"
                                   " OR (s = 'DELISTED' AND trading_state = 'NOT_LISTED_OR_NOT_ELIGIBLE'))",
    "DELISTED_IDENTITY_TRADES": "code % 10 = 8 AND trading_state <> 'NOT_LISTED_OR_NOT_ELIGIBLE'",
    "NOT_LISTED_WITHOUT_EVIDENCE": "trading_state = 'NOT_LISTED_OR_NOT_ELIGIBLE' AND code % 10 <> 8",
    "FIELD_INVALID:OHLC": "traded AND l_partkey % 23 = 0", "FIELD_ON_NON_TRADED_ROW:OHLC": "NOT traded AND l_partkey % 5 = 0",
    "FIELD_INVALID:VOLUME": "traded AND volume = '0'", "FIELD_ON_NON_TRADED_ROW:VOLUME": "NOT traded AND volume = '500'",
    "GROUP_NOT_SUPPLIED:VALUE_TRADED_KWD": "value_traded_kwd <> ''", "FIELD_INVALID:REFERENCE_PRICE": "reference_price_fils <> ''"}, "l_orderkey", "j")

# --- files written and read back -------------------------------------------------------


def _folder(spark):
    return f"{shared_dir(spark)}/tidegauge/{uuid.uuid4().hex}"


def _text_file(key: str, name: str):
    return F.repeat(F.concat(name, F.lit("\n")), (1 + F.col(key) % 50).cast("int"))


def artifacts_audit(spark, sf_dir):
    """Suppliers as raw files, hashed in pieces of a kilobyte, against a manifest with lost, unknown and changed files."""
    root, key = _folder(spark), F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.format_string("raw/%d/%d.txt", key % 10, key).alias("path"), _text_file("s_suppkey", "s_name").cast("binary").alias("content"))
    files.store_artifacts(s.where("s_suppkey % 7 <> 0"), root)
    manifest = s.where("s_suppkey % 13 <> 0").select(
        "path", F.when(key % 11 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"),
        (F.length("content") + (key % 10 == 0).cast("int")).alias("size_bytes"), F.when(key % 17 == 0, "nobody").otherwise("known").alias("source_id"),
        F.when(key % 19 == 0, "2025-01-01").otherwise("2024-01-01").cast("timestamp").alias("observed_at"), F.lit(None).cast("timestamp").alias("provider_as_of"))
    audit = files.audit_manifest(
        files.scan_artifacts(spark, root, 1024), manifest, spark.createDataFrame([("known",)], "source_id string"), F.lit("2024-06-01").cast("timestamp"))
    return tally(audit.withColumn("s_suppkey", F.regexp_extract("path", "([0-9]+)[.]txt$", 1)), "s_suppkey")


ARTIFACTS_SQL = tally_sql({
    "ARTIFACT_MISSING": "d AND NOT st", "ARTIFACT_NOT_IN_MANIFEST": "NOT d", "SOURCE_UNKNOWN": "d AND s_suppkey % 17 = 0", "ARTIFACT_SIZE_MISMATCH": "d AND st AND s_suppkey % 10 = 0",
    "ARTIFACT_HASH_MISMATCH": "d AND st AND s_suppkey % 11 = 0", "OBSERVED_AFTER_CUTOFF": "d AND s_suppkey % 19 = 0"}, "s_suppkey",
    "(SELECT s_suppkey, s_suppkey % 13 <> 0 AS d, s_suppkey % 7 <> 0 AS st FROM supplier) WHERE d OR st")


def packet_audit(spark, sf_dir):
    """Suppliers as artifacts of outcome packets of three; some packets have lost, unreferenced, changed or untimely files."""
    root, key = _folder(spark), F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.format_string("p%d", F.floor(key / 3)).alias("packet_id"), F.format_string("raw/%d.txt", key).alias("path"),
        _text_file("s_suppkey", "s_name").cast("binary").alias("content"))
    files.store_artifacts(s.where("s_suppkey % 23 <> 0").select(F.concat_ws("/", "packet_id", "path").alias("path"), "content"), root)
    manifest = s.where("s_suppkey % 29 <> 0").select(
        "packet_id", "path", F.when(key % 31 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"),
        F.length("content").cast("bigint").alias("size_bytes"), F.when(key % 37 == 0, "2023-01-01").otherwise("2024-01-01").cast("timestamp").alias("observed_at"))
    packets = s.select("packet_id").distinct().select(
        "packet_id", F.sha2("packet_id", 256).alias("manifest_sha256"), F.lit("2023-06-01").cast("timestamp").alias("decision_at"),
        F.when(F.substring("packet_id", 2, 9).cast("int") % 11 == 5, "2023-05-01").otherwise("2024-06-01").cast("timestamp").alias("observed_at"))
    _, found = files.audit_packets(files.scan_artifacts(spark, root), manifest, packets)
    return found.select("packet_id", "status", "artifact_count", "total_bytes", "packet_sha256", F.concat_ws("|", "issue_codes").alias("issues"))


PACKET_SQL = """WITH s AS (SELECT s_suppkey AS k, s_suppkey // 3 AS p, 'raw/' || s_suppkey || '.txt' AS path, repeat(s_name || chr(10), 1 + s_suppkey % 50) AS c,
        s_suppkey % 23 <> 0 AS st, s_suppkey % 29 <> 0 AS d FROM supplier),
    r AS (SELECT *, NOT (d AND st) OR k % 31 = 0 OR (k % 37 = 0 OR p % 11 = 5) AS bad FROM s WHERE d OR st),
    g AS (SELECT p, count(*) AS n, CAST(sum(CASE WHEN d THEN strlen(c) END) AS BIGINT) AS b, bool_or(bad) AS bad,
        string_agg('{"path":"' || path || '","sha256":"' || sha256(c) || '","size_bytes":' || strlen(c) || '}', ',' ORDER BY path) AS e FROM r GROUP BY 1)
    SELECT 'p' || p AS packet_id, CASE WHEN p % 11 <> 5 AND n IS NOT NULL AND NOT bad THEN 'PASS' ELSE 'BLOCKED' END AS status, n AS artifact_count, b AS total_bytes,
        CASE WHEN p % 11 <> 5 AND n IS NOT NULL AND NOT bad THEN sha256('[{"path":"manifest.json","sha256":"' || sha256('p' || p) || '"},' || e || ']') END AS packet_sha256,
        concat_ws('|', CASE WHEN p % 11 = 5 THEN 'PACKET_TIMES_REVERSED' END, CASE WHEN n IS NULL THEN 'PACKET_EMPTY' END, CASE WHEN bad THEN 'PACKET_INVENTORY_DIFFERS' END) AS issues
    FROM (SELECT DISTINCT p FROM s) LEFT JOIN g USING (p)"""


def vendor_exports(spark, sf_dir):
    """Line items as one price export per supplier; some files run oldest first, are changed, or are not declared."""
    root, key, day = _folder(spark), F.col("l_suppkey"), F.col("day")
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    price = 100 + key % 50
    date = F.when(key % 2 == 0, F.concat(F.lit('"'), F.date_format(day, "MMM d, yyyy"), F.lit('"'))).otherwise(day.cast("string"))
    line = F.concat_ws(
        ",", date, price.cast("string"), price.cast("string"), (price + F.when(F.dayofmonth(day) == 13, -5).otherwise(2)).cast("string"), (price - 1).cast("string"),
        F.concat(F.col("q").cast("string"), F.when(F.dayofmonth(day) == 17, ".0005K").otherwise("K")), F.lit("+1.00%"))
    place = F.when(key % 9 == 0, F.datediff(day, F.lit("1970-01-01"))).otherwise(-F.datediff(day, F.lit("1970-01-01")))
    # One export has a row per date: bounded by the calendar.
    exports = li.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), line.alias("line")))).alias("rows")).select(
        "l_suppkey", F.format_string("%d.csv", key).alias("path"),
        F.concat_ws("\n", F.lit(",".join(files.VENDOR_HEADER)), F.transform("rows", lambda r: r["line"])).alias("content"))
    files.store_artifacts(exports, root)
    stored = materialise(files.scan_artifacts(spark, root))  # read by the manifest and by the check
    number = F.regexp_extract("path", "^([0-9]+)[.]", 1).cast("bigint")
    manifest = stored.where(number % 12 != 0).select(
        F.col("path").alias("file_name"), number.cast("string").alias("code"), F.lit("vendor").alias("source_id"),
        F.when(number % 15 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    rows = files.read_vendor_exports(spark, root, manifest, stored)
    return tally(rows.withColumn("l_suppkey", F.regexp_extract("file_name", "^([0-9]+)[.]", 1)), "l_suppkey")


VENDOR_SQL = tally_sql({
    "FILE_SHA256_MISMATCH": "l_suppkey % 12 <> 0 AND l_suppkey % 15 = 0", "ROWS_NOT_NEWEST_FIRST": "l_suppkey % 9 = 0 AND day > first", "FILE_NOT_IN_MANIFEST": "l_suppkey % 12 = 0",
    "OHLC_IMPOSSIBLE": "day(day) = 13", "VOLUME_NOT_WHOLE": "day(day) = 17"}, "l_suppkey",
    "(SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS day, min(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_suppkey) AS first FROM lineitem)")


def sorted_sink(spark, sf_dir):
    """Orders through the sorted sink: rows, and those that stand before a smaller key in the files read in their order."""
    path, columns = _folder(spark), ["o_orderdate", "o_orderkey", "o_orderstatus"]
    files.write_sorted(table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate")), columns, ["o_orderdate", "o_orderkey"], path, "parquet")
    back = spark.read.parquet(path).withColumns({"_file": F.col("_metadata.file_name"), "_place": F.col("_metadata.row_index")})
    here = Window.partitionBy("_file").orderBy("_place")  # a file is one sorted partition
    at = F.struct("o_orderdate", "o_orderkey")
    placed = back.withColumns({"_broken": F.lag(at).over(here) > at})
    ends = placed.groupBy("_file").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count_if("_broken").alias("broken"))
    across = ends.select((F.lag("high").over(Window.orderBy("_file")) > F.col("low")).cast("int").alias("b"), "broken")  # a row per file
    broken = across.agg((F.coalesce(F.sum("b"), F.lit(0)) + F.sum("broken")).cast("bigint").alias("broken_order"))
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("ids")).crossJoin(F.broadcast(broken))


SORTED_SQL = "SELECT o_orderstatus, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS ids, CAST(0 AS BIGINT) AS broken_order FROM orders GROUP BY 1"


def csv_scan(spark, sf_dir):
    """Orders through the sorted sink and the CSV scan, all fields as text."""
    path, columns = _folder(spark), ["o_orderkey", "o_custkey", "o_orderstatus"]
    files.write_sorted(table(spark, sf_dir, "orders"), columns, ["o_orderkey"], path)
    back = files.read_csv(spark, path, columns)
    return back.groupBy("o_orderstatus", F.col("_corrupt").isNotNull().alias("corrupt")).agg(
        F.count("*").alias("rows"), F.sum(F.col("o_orderkey").cast("bigint")).alias("ids"), F.sum(F.col("o_custkey").cast("bigint")).alias("customers"))


def identity_scan(spark, sf_dir):
    """Customers as JSON arrays of identity records, a file per hundred; every third time lacks its offset."""
    c, path = table(spark, sf_dir, "customer"), _folder(spark)
    at = F.concat(F.lit("2024-01-01T00:00:00"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("+03:00"))
    record = F.struct(F.col("c_custkey").cast("string").alias("security_id"), F.col("c_name").alias("symbol_en"), F.lit("2020-01-01").alias("valid_from"),
                      at.alias("known_from"), (F.col("c_custkey") % 2 == 0).alias("tradable"))
    arrays = c.groupBy(F.floor(F.col("c_custkey") / 100).alias("part")).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.write.partitionBy("part").text(path)
    back = files.read_identity(spark, path)
    return back.groupBy("tradable", F.col("known_from").isNotNull().alias("timed")).agg(F.count("*").alias("rows"), F.sum(F.col("security_id").cast("bigint")).alias("ids"))


def report_sink(spark, sf_dir):
    """Two artifacts of a run through the report sink, read back."""
    path = _folder(spark)
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n_nationkey"), F.col("o_custkey").alias("n_regionkey"))
    files.write_report({"model": n, "predictions": o}, path)
    parts = [spark.read.schema("n_nationkey bigint, n_regionkey bigint").json(f"{path}/{a}").withColumn("artifact", F.lit(a)) for a in ("model", "predictions")]
    return parts[0].unionByName(parts[1]).groupBy("artifact").agg(F.count("*").alias("rows"), F.sum("n_nationkey").alias("ids"), F.sum("n_regionkey").alias("others"))


QUERIES = {
    "csv_scan": csv_scan, "identity_json_scan": identity_scan, "report_sink": report_sink,
    "status_history_contract": status_history, "actions_stable_ids": action_ids, "notice_count_reconcile": notice_counts,
    "universe_bindings": universe_bindings, "provider_row_contract": provider_rows,
    "exposure_binding": exposures, "finding_contract": finding_contract, "source_observations": observations, "parsed_inputs": parsed_inputs,
    "run_manifest": run_manifest, "replay_rows": replay_rows, "notice_contract": notice_contract, "event_table_contract": event_tables,
    "delisting_contract": delistings, "benchmark_row_contract": benchmark_rows, "published_recheck": republished, "bars_duplicate_keys": duplicate_keys,
    "series_date_order": date_order, "samples_causal_split": causal_split, "ledger_seal_check": seal_check, "scan_gate": scan_gate, "claims_verdict": claim_verdict,
    "json_lines_strict": json_lines, "html_tables": html_tables,
    "artifacts_audit": artifacts_audit, "packet_audit": packet_audit, "vendor_exports": vendor_exports, "sorted_sink": sorted_sink,
}
ORACLE = {
    "csv_scan": """SELECT o_orderstatus, FALSE AS corrupt, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS ids, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders GROUP BY 1""",
    "identity_json_scan": """SELECT c_custkey % 2 = 0 AS tradable, c_custkey % 3 <> 0 AS timed, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer GROUP BY 1, 2""",
    "report_sink": """SELECT 'model' AS artifact, count(*) AS rows, CAST(sum(n_nationkey) AS BIGINT) AS ids, CAST(sum(n_regionkey) AS BIGINT) AS others FROM nation
        UNION ALL SELECT 'predictions', count(*), CAST(sum(o_orderkey) AS BIGINT), CAST(sum(o_custkey) AS BIGINT) FROM orders""",
    "status_history_contract": HISTORY_SQL, "actions_stable_ids": ACTION_SQL, "notice_count_reconcile": COUNT_SQL, "universe_bindings": BINDING_SQL,
    "provider_row_contract": PROVIDER_SQL,
    "exposure_binding": EXPOSURE_SQL, "finding_contract": FINDING_SQL, "source_observations": OBSERVATION_SQL, "parsed_inputs": PARSED_SQL,
    "run_manifest": MANIFEST_SQL, "replay_rows": REPLAY_SQL, "notice_contract": NOTICE_SQL, "event_table_contract": EVENT_TABLE_SQL,
    "delisting_contract": DELISTING_SQL, "benchmark_row_contract": BENCHMARK_SQL, "published_recheck": REPUBLISHED_SQL,
    "bars_duplicate_keys": "SELECT l_suppkey AS code, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS trade_date, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "series_date_order": DATE_ORDER_SQL, "samples_causal_split": CAUSAL_SQL, "ledger_seal_check": SEAL_SQL, "scan_gate": SCAN_SQL, "claims_verdict": VERDICT_SQL,
    "json_lines_strict": JSON_SQL, "html_tables": HTML_SQL,
    "artifacts_audit": ARTIFACTS_SQL, "packet_audit": PACKET_SQL, "vendor_exports": VENDOR_SQL, "sorted_sink": SORTED_SQL,
}
