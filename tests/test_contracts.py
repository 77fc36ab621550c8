"""Contracts of the remaining tables: one good and one broken row each."""

from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from tidegauge.operators import contracts as ct
from tidegauge.operators import foundation, network

H, G = "a" * 64, "b" * 64
D = date.fromisoformat
T = datetime(2024, 1, 1, tzinfo=timezone.utc)
LATE = datetime(2024, 1, 2, tzinfo=timezone.utc)


def codes(df, *order):
    return [r["issue_codes"] for r in df.orderBy(*order).collect()]


def test_notices_and_delistings(spark):
    identity = spark.createDataFrame([("1", "AAA")], "code string, ticker string")
    cols = ("notice_id string, code string, ticker string, event_type string, effective_date date, published_date date, source_url string, raw_sha256 string, "
            "text_sha256 string, classification_phrase string")
    rows = [("n1", "1", "aaa", "SUSPEND", D("2024-01-05"), D("2024-01-04"), "https://x", H, G, "halt"), ("n2", "2", "B", "STOP", D("2025-01-05"), D("2025-01-04"), "http://x", "z", G, " ")]
    got = codes(ct.check_notices(spark.createDataFrame(rows, cols), identity, F.lit("2024-01-01").cast("date"), F.lit("2024-12-31").cast("date")), "notice_id")
    assert got == [[], ["NOTICE_IDENTITY_MISMATCH", "NOTICE_TYPE_UNKNOWN", "NOTICE_OUTSIDE_WINDOW", "NOTICE_PUBLISHED_AFTER_WINDOW", "NOTICE_URL_NOT_HTTPS",
                        "NOTICE_EVIDENCE_FORM", "NOTICE_PHRASE_REQUIRED"]]
    gone = spark.createDataFrame([("1", D("2023-01-01"), "https://x"), ("2", D("2025-01-01"), "ftp://x")], "code string, delisting_date date, source_url string")
    assert codes(ct.check_delistings(gone, F.lit("2024-01-01").cast("date")), "code") == [[], ["DELISTING_AFTER_SNAPSHOT", "SOURCE_URL_NOT_HTTPS"]]


def test_event_tables_and_benchmark_rows(spark):
    d = spark.createDataFrame([("1", "n1", H, T, LATE), ("1", "n2", "x", LATE, T)], "code string, news_id string, raw_sha256 string, published_at timestamp, fetched_at timestamp")
    assert codes(ct.check_event_table(d, "disclosures", "news_id"), "news_id") == [[], ["RAW_SHA256_FORM", "FETCHED_BEFORE_PUBLISHED"]]
    a = spark.createDataFrame([("1", "a1", H, "official", None), ("1", "a2", H, "pending", None)], "code string, action_id string, raw_sha256 string, factor_status string, adjustment_factor string")
    assert codes(ct.check_event_table(a, "corporate_actions", "action_id"), "action_id") == [["OFFICIAL_FACTOR_INVALID"], []]
    rows = spark.createDataFrame([("I", D("2024-01-01"), 5.0, H, "SAR"), ("I", D("2024-01-02"), -1.0, G, "USD"), ("J", D("2024-01-01"), 1.0, H, "SAR")],
                                 "benchmark_code string, trade_date date, benchmark_value double, raw_sha256 string, currency string")
    reg = spark.createDataFrame([("I", "SAR")], "benchmark_code string, currency string")
    bind = spark.createDataFrame([("I", H)], "benchmark_code string, raw_sha256 string")
    assert codes(ct.check_benchmark_rows(rows, reg, bind, ["currency"]), "benchmark_code", "trade_date") == [
        [], ["BENCHMARK_VALUE_INVALID", "EVIDENCE_BINDING_MISMATCH", "REGISTRY_FIELD:currency"], ["BENCHMARK_NOT_REGISTERED", "EVIDENCE_BINDING_MISMATCH"]]


def test_source_side_contracts(spark):
    manifest = spark.createDataFrame([(H,)], "sha256 string")
    obs = spark.createDataFrame([("s", "q1", "AVAILABLE", "QUALIFIED", T, T, H, 3), ("s", "q2", "BLOCKED", "ZERO_RESULT", LATE, T, G, 1)],
                                "source_id string, query_id string, access_state string, query_status string, observed_at timestamp, decision_at timestamp, raw_sha256 string, result_count int")
    checked = ct.check_source_observations(obs, manifest)
    assert codes(checked, "query_id") == [[], ["OBSERVED_AFTER_DECISION", "QUALIFIED_WITHOUT_ACCESS", "QUALIFIED_WITHOUT_ARTIFACT", "ZERO_RESULT_WITH_ROWS"]]
    assert [r["contributes"] for r in checked.orderBy("query_id").collect()] == [True, False]
    sources = spark.createDataFrame([("s", "EDITORIAL", ["NEWS_ARCHIVE"], "example.com", "C")],
                                    "source_id string, source_class string, roles array<string>, allowed_domain string, timing_ceiling string")
    inputs = spark.createDataFrame([(1, "s", "EDITORIAL", ["NEWS_ARCHIVE"], H), (2, "s", "COMMUNITY", ["PRICE_HISTORY"], G)],
                                   "id int, source_id string, source_class string, evidence_roles array<string>, raw_sha256 string")
    log = spark.createDataFrame([("s", H)], "source_id string, raw_sha256 string")
    assert codes(foundation.check_parsed_inputs(inputs, sources, log), "id") == [[], ["CONTEXT_CLASS_MISMATCH", "ROLE_NOT_HELD_BY_SOURCE", "EVIDENCE_NOT_OWNED_BY_SOURCE"]]
    art = spark.createDataFrame([(1, "s", "https://a.example.com/x", T, H), (2, "t", "http://b.org/#x", LATE, "q")], "id int, source_id string, source_url string, observed_at timestamp, sha256 string")
    assert codes(foundation.check_run_manifest(art, sources, F.lit(T).cast("timestamp")), "id") == [
        [], ["URL_NOT_ABSOLUTE_HTTPS", "URL_HAS_FRAGMENT", "SOURCE_UNKNOWN", "OBSERVED_AFTER_DECISION", "SHA256_FORM"]]
    f = spark.createDataFrame(
        [(1, "s", "https://a.example.com/", "C", "CATALYST", ["NEWS_ARCHIVE"], 0.5, 0.5, T, T, T), (2, "s", "https://evil.org/", "A", "LIQUIDITY", ["NEWS_ARCHIVE"], 2.0, 0.5, LATE, T, datetime(2024, 1, 5, tzinfo=timezone.utc))],
        "id int, source_id string, source_url string, timing_grade string, signal_kind string, evidence_roles array<string>, strength double, materiality double, published_at timestamp, "
        "available_at timestamp, decision_at timestamp")
    checked = network.check_findings(f, sources, 36)
    assert codes(checked, "id") == [[], ["SOURCE_DOMAIN_MISMATCH", "TIMING_GRADE_ABOVE_CEILING", "ROLE_SIGNAL_MISMATCH", "STRENGTH_OUT_OF_RANGE", "PUBLISHED_AFTER_AVAILABLE"]]
    assert [r["stale"] for r in checked.orderBy("id").collect()] == [False, True]
