"""Row contracts of the remaining tables; each returns the rows with ``issue_codes``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.operators.pit import LISTED_STATUSES, SESSION_STATUSES, interval_join, overlapping_keys
from tidegauge.operators.prices import check_ohlc

# Fixed values.
NOTICE_TYPES = ("SUSPEND", "RESUME", "DELIST", "RELIST")
COMPANY_FACTS = ("COMPANY_REGISTRATION", "FOUNDER_IDENTITY", "COMPANY_STATUS")
LEGAL_FACTS = ("LEGAL_ALLEGATION", "COURT_OUTCOME", "REGULATORY_ACTION")
LEGAL_STATUSES = ("ALLEGED", "REFERRED", "CHARGED", "DECIDED", "APPEALED", "FINAL")
FORBIDDEN_OUTCOME_KEYS = (
    "outcome", "realized_positive", "gross_return", "benchmark_return", "net_return", "net_excess_return", "target_hit", "exit_price",
    "exit_price_fils", "future_return", "max_favorable_excursion", "max_adverse_excursion",
)
FORBIDDEN_OUTCOME_SHAPES = ("realized_[^\"]*", "future_[^\"]*", "exit_price[^\"]*", "[^\"]*_target_hit")
FORBIDDEN_OUTCOME_PATTERN = '"(' + "|".join(FORBIDDEN_OUTCOME_KEYS + FORBIDDEN_OUTCOME_SHAPES) + r')"\s*:'
FORECAST_REQUIRED = ("decision_id", "security_code", "product_id", "target_rule", "decision_at", "outcome_due_at", "horizon_sessions",
                     "model_version", "entry_rule", "eligible", "selected", "abstained", "thesis_episode_id")
FIELD_GROUPS = {
    "OHLC": ("open_fils", "high_fils", "low_fils", "close_fils"), "VOLUME": ("volume",), "VALUE_TRADED_KWD": ("value_traded_kwd",),
    "TRADE_COUNT": ("trade_count",), "REFERENCE_PRICE": ("reference_price_fils",),
}
STATES_BY_STATUS = {"TRADING": ("TRADED", "NO_TRADE", "HALTED"), "SUSPENDED": ("SUSPENDED", "TRADED_THEN_SUSPENDED"),
                    "DELISTED": ("NOT_LISTED_OR_NOT_ELIGIBLE",)}


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """The frame with ``_n``, the number of rows sharing its key; NULL keys are kept and counted as equal."""
    counts = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(F.count("*").alias("_n"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(counts, same).drop(*[f"_k_{k}" for k in key])


def resolves(rows: DataFrame, manifest: DataFrame, column: str = "raw_sha256") -> DataFrame:
    """The frame with ``_resolves``: whether its hash is in the manifest."""
    known = manifest.select(F.col("sha256").alias(column), F.lit(True).alias("_resolves")).distinct()
    return rows.join(known, column, "left")


def check_positions(positions: DataFrame, code_pattern: str = r"^[0-9]{4}$") -> DataFrame:
    return R.check(
        positions,
        R.must("OFFICIAL_CODE_REQUIRED", F.col("official_code").rlike(code_pattern)),
        R.must("CURRENCY_MUST_BE_SAR", F.col("currency") == "SAR"),
        R.never("NEGATIVE_POSITION_VALUE", (F.col("quantity") < 0) | (F.col("average_cost") < 0)),
    )


def audit_claims(claims: DataFrame) -> DataFrame:
    return R.check(
        claims,
        R.must("NO_EVIDENCE", F.col("evidence_count") > 0),
        R.must("INCOMPLETE_DENOMINATOR", F.col("denominator_complete")),
        R.must("POINT_IN_TIME_FAILURE", F.col("point_in_time")),
        R.must("CORPORATE_ACTIONS_UNRECONCILED", F.col("corporate_actions_reconciled")),
        R.must("AUTHORITY_UNVERIFIED", F.col("authority_verified")),
    )


def audit_verdict(audited: DataFrame) -> DataFrame:
    failed = F.count_if(F.size("issue_codes") > 0)
    return audited.agg(
        F.count("*").alias("claims"), failed.alias("failed_claims"),
        F.when((F.count("*") > 0) & (failed == 0), "PASS_BACKTEST").otherwise("STOP_BACKTEST").alias("status"),
    )


def check_claim_support(claims: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Fact type against the roles and tiers of the cited sources.

    ``citations(claim_id, source_id)``, ``sources(source_id, roles, tier)``.
    Roles and tiers reduce to flags, never to collected sets.
    """
    def any_role(*names):
        return F.bool_or(F.arrays_overlap("roles", F.lit(list(names))))

    cited = citations.join(sources.withColumn("_known", F.lit(True)), "source_id", "left").groupBy("claim_id").agg(
        F.bool_or(F.col("_known").isNull()).alias("_unknown"),
        any_role("COMMERCIAL_REGISTRY", "OFFICIAL_GAZETTE", "COMPANY_DISCLOSURE").alias("_company"),
        any_role("COURT_RECORD", "REGULATORY_ACTION", "OFFICIAL_GAZETTE").alias("_legal"),
        F.bool_or(F.col("tier").isin("PRIMARY_OFFICIAL", "PRIMARY_ARCHIVE")).alias("_primary"),
        F.bool_and(F.col("tier").isin("COMMUNITY", "ROUTING_ONLY")).alias("_community"),
    )
    fact = F.upper(F.trim("fact_type"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return R.check(
        claims.join(cited, "claim_id", "left"),
        R.never("CLAIM_WITHOUT_SOURCE", F.col("_unknown").isNull()),
        R.never("CLAIM_SOURCE_UNKNOWN", F.col("_unknown")),
        R.never("COMPANY_FACT_NEEDS_REGISTRY", fact.isin(*COMPANY_FACTS) & ~flag("_company")),
        R.never("COMPANY_FACT_NEEDS_PRIMARY", fact.isin(*COMPANY_FACTS) & ~flag("_primary")),
        R.never("LEGAL_FACT_NEEDS_RECORD", fact.isin(*LEGAL_FACTS) & ~flag("_legal")),
        R.never("LEGAL_FACT_NEEDS_STATUS", fact.isin(*LEGAL_FACTS) & ~F.coalesce(F.col("legal_status").isin(*LEGAL_STATUSES), F.lit(False))),
        R.never("COMMUNITY_CANNOT_ESTABLISH_FACT", (fact != "SOCIAL_SENTIMENT") & flag("_community")),
    ).drop("_unknown", "_company", "_legal", "_primary", "_community")


def check_no_event(records: DataFrame, declared: DataFrame, receipts: DataFrame) -> DataFrame:
    """"No event found" needs one complete receipt per declared source and no other source.

    ``declared(record_id, source_id)``, ``receipts(record_id, source_id, access_status,
    query_complete, pagination_complete)``.
    """
    r = receipts.groupBy("record_id", "source_id").agg(
        F.bool_and((F.col("access_status") == "COMPLETED") & F.col("query_complete") & F.col("pagination_complete")).alias("done")
    )
    d = declared.select("record_id", "source_id").distinct().withColumn("_d", F.lit(True))
    j = d.join(r, ["record_id", "source_id"], "full_outer").groupBy("record_id").agg(
        F.count("_d").alias("_declared"), F.count("done").alias("_receipts"),
        F.bool_or(F.col("_d").isNull() | F.col("done").isNull()).alias("_differs"), F.bool_and("done").alias("_done"),
    )
    claims_none = F.col("coverage_status") == "NO_VERIFIED_EVENT_FOUND"
    return R.check(
        records.join(j, "record_id", "left"),
        R.never("NO_DECLARED_SOURCES", claims_none & (F.coalesce("_declared", F.lit(0)) == 0)),
        R.never("NO_SEARCH_RECEIPTS", claims_none & (F.coalesce("_receipts", F.lit(0)) == 0)),
        R.never("SOURCE_CHECK_INCOMPLETE", claims_none & ~F.coalesce("_done", F.lit(True))),
        R.never("RECEIPTS_DO_NOT_COVER_DECLARED", claims_none & F.col("_differs")),
    ).drop("_declared", "_receipts", "_differs", "_done")


def check_forecast_payload(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Forecast JSON: required fields, flags, numbers, and no outcome key at any depth."""
    get = lambda k: F.get_json_object(payload, f"$.{k}")
    decision, due = R.aware_timestamp(get("decision_at")), R.aware_timestamp(get("outcome_due_at"))
    flags = [R.strict_bool(get(k)) for k in ("eligible", "selected", "abstained")]
    missing = F.lit(False)
    for k in FORECAST_REQUIRED:
        missing = missing | ~R.present(get(k))
    return R.check(
        rows,
        R.never("FORBIDDEN_OUTCOME_FIELD", F.lower(payload).rlike(FORBIDDEN_OUTCOME_PATTERN)),
        R.never("MISSING_FIELDS", missing),
        R.must("OUTCOME_DUE_NOT_AFTER_DECISION", due > decision),
        R.must("HORIZON_NOT_POSITIVE", get("horizon_sessions").try_cast("int") > 0),
        R.must("FLAGS_NOT_BOOLEAN", flags[0].isNotNull() & flags[1].isNotNull() & flags[2].isNotNull()),
        R.never("INVALID_SELECTION_FLAGS", flags[1] & (flags[2] | ~flags[0])),
        R.never("SCORE_OR_PROBABILITY_REQUIRED", ~R.present(get("score")) & ~R.present(get("probability"))),
        R.never("PROBABILITY_OUT_OF_RANGE", R.present(get("probability")) & ~R.finite(get("probability"), 0, 1)),
        R.never("RANK_NOT_POSITIVE", R.present(get("rank")) & ~F.coalesce(get("rank").try_cast("int") > 0, F.lit(False))),
    )


def check_notices(notices: DataFrame, identity: DataFrame, window_from: Column, window_to: Column) -> DataFrame:
    """Status notices: identity and ticker, type, dates inside the window, HTTPS source, evidence form, phrase."""
    known = identity.select("code", F.col("ticker").alias("_ticker")).distinct()
    return R.check(
        duplicates(notices, "notice_id").join(known, "code", "left"),
        R.must("NOTICE_ID_REQUIRED", R.present("notice_id")),
        R.never("NOTICE_ID_DUPLICATE", F.col("_n") > 1),
        R.must("NOTICE_IDENTITY_MISMATCH", F.upper("ticker") == F.col("_ticker")),
        R.must("NOTICE_TYPE_UNKNOWN", R.in_set("event_type", NOTICE_TYPES)),
        R.must("NOTICE_OUTSIDE_WINDOW", F.col("effective_date").between(window_from, window_to)),
        R.must("NOTICE_PUBLISHED_AFTER_WINDOW", F.col("published_date") <= window_to),
        R.must("NOTICE_URL_NOT_HTTPS", F.col("source_url").startswith("https://")),
        R.must("NOTICE_EVIDENCE_FORM", R.is_sha256("raw_sha256") & R.is_sha256("text_sha256")),
        R.must("NOTICE_PHRASE_REQUIRED", R.present("classification_phrase")),
    ).drop("_n", "_ticker")


def check_schedule(actions: DataFrame, identity: DataFrame, window_from: Column, window_to: Column) -> DataFrame:
    """Corporate-action schedule: identity, date order, window, and no factor before disclosure."""
    known = identity.select("code", F.col("ticker").alias("_ticker"), F.col("isin").alias("_isin"))
    first = F.least("cum_date", "ex_date", "record_date", "payment_date")
    last = F.greatest("cum_date", "ex_date", "record_date", "payment_date")
    return R.check(
        duplicates(actions, "action_id").join(known, "code", "left"),
        R.never("ACTION_ID_DUPLICATE", F.col("_n") > 1),
        R.must("ACTION_IDENTITY_MISMATCH", (F.col("ticker") == F.col("_ticker")) & (F.col("isin") == F.col("_isin"))),
        R.must("ACTION_DATES_OUT_OF_ORDER", (F.col("cum_date") < F.col("ex_date")) & (F.col("ex_date") <= F.col("record_date"))),
        R.never("PAYMENT_PRECEDES_RECORD", F.col("payment_date") < F.col("record_date")),
        R.never("ACTION_OUTSIDE_WINDOW", (last < window_from) | (first > window_to)),
        R.must("FACTOR_MUST_BE_PENDING", F.col("adjustment_factor").isNull() & (F.col("factor_status") == "pending")),
    ).drop("_n", "_ticker", "_isin")


def check_master(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Security-master row: identifiers, ISIN shape, status, interval order, evidence."""
    return R.check(
        resolves(rows, manifest),
        R.must("MASTER_KEYS_REQUIRED", R.present("code") & R.present("ticker") & R.present("board")),
        R.never("ISIN_FORM", R.present("isin") & ~F.upper("isin").rlike(r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$")),
        R.must("LISTING_STATUS_INVALID", F.upper("listing_status").isin(*LISTED_STATUSES, "DELISTED")),
        R.never("VALID_TO_PRECEDES_VALID_FROM", F.col("valid_to") < F.col("valid_from")),
        R.must("RAW_SHA256_FORM", R.is_sha256("raw_sha256")),
        R.must("RAW_SHA256_UNRESOLVED", F.col("_resolves")),
    ).drop("_resolves")


def check_status_history(rows: DataFrame, manifest: DataFrame, codes: DataFrame) -> DataFrame:
    """Status-history row: known code, board, status, interval order, evidence; overlapping intervals of one code and board."""
    known = codes.select("code", F.lit(True).alias("_known")).distinct()
    overlaps = overlapping_keys(rows, ["code", "board"], "effective_from", "effective_to").select("code", "board", F.lit(True).alias("_overlap"))
    return R.check(
        resolves(rows, manifest).join(known, "code", "left").join(overlaps, ["code", "board"], "left"),
        R.must("STATUS_CODE_UNKNOWN", F.col("_known")),
        R.must("STATUS_OR_BOARD_INVALID", R.present("board") & F.upper("status").isin(*SESSION_STATUSES, "DELISTED", "LISTED_NOT_YET_TRADING")),
        R.never("EFFECTIVE_TO_PRECEDES_FROM", F.col("effective_to") < F.col("effective_from")),
        R.must("RAW_SHA256_UNRESOLVED", F.col("_resolves")),
        R.never("STATUS_OVERLAP", F.col("_overlap")),
    ).drop("_known", "_overlap", "_resolves")


def stable_action_id(raw_sha256: str = "raw_sha256") -> Column:
    """Id of a scheduled corporate action from what identifies it, so that a later capture of it finds the same row."""
    parts = [F.col("code").cast("string"), F.col("isin")] + [
        F.coalesce(F.col(d).cast("string"), F.lit("")) for d in ("cum_date", "ex_date", "record_date", "payment_date")] + [F.col(raw_sha256)]
    return F.concat(F.lit("ca-schedule-"), F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 24))


def reconcile_notice_counts(queries: DataFrame, notices: DataFrame) -> DataFrame:
    """Declared rows of each query against the notices that came from it, both ways round."""
    actual = notices.groupBy("query_id").agg(F.count("*").alias("actual"))
    joined = queries.select("query_id", "rows_normalized").join(actual, "query_id", "full_outer")
    return R.check(
        joined.withColumn("actual", F.coalesce("actual", F.lit(0))),
        R.never("QUERY_UNKNOWN", F.col("rows_normalized").isNull()),
        R.never("QUERY_NOTICE_RECONCILIATION", F.col("rows_normalized") != F.col("actual")),
    )


def check_provider_rows(rows: DataFrame, calendar: DataFrame, identity: DataFrame, status: DataFrame, supplied: Sequence[str]) -> DataFrame:
    """Provider end-of-day rows as text against calendar, identity, status and the field groups the provider supplies.

    ``rows`` carries a unique ``row_id``; ``identity`` and ``status`` carry the ticker. A field of a group that is not
    supplied must be blank; traded rows need positive figures, others none or zero.
    """
    columns = [c for group in FIELD_GROUPS.values() for c in group]
    probes = rows.select("row_id", "code", "trade_date")
    who = interval_join(probes, identity.select("code", "valid_from", "valid_to", F.col("ticker").alias("_ti"), "listing_status"), ["code"],
                        "trade_date", "valid_from", "valid_to").groupBy("row_id").agg(
        F.count("*").alias("_ni"), F.min("_ti").alias("_ti"), F.min("listing_status").alias("_listing"))
    what = interval_join(probes, status.select("code", "effective_from", "effective_to", F.col("ticker").alias("_ts"), F.col("status").alias("_s")), ["code"],
                         "trade_date", "effective_from", "effective_to").groupBy("row_id").agg(
        F.count("*").alias("_ns"), F.min("_ts").alias("_ts"), F.min("_s").alias("_s"))
    days = calendar.where("is_trading_day").select("trade_date", F.lit(True).alias("_session"))
    joined = rows.join(days, "trade_date", "left").join(who, "row_id", "left").join(what, "row_id", "left")
    state, traded = F.col("trading_state"), F.col("trading_state").isin("TRADED", "TRADED_THEN_SUSPENDED")
    fits = F.lit(False)
    for held, states in STATES_BY_STATUS.items():
        fits = fits | ((F.col("_s") == held) & state.isin(*states))
    blank = lambda c: ~R.present(c)
    none = lambda cs: F.forall(F.array(*[blank(c) for c in cs]), lambda b: b)
    positive = lambda cs: F.forall(F.array(*[R.finite(c, 1e-12) for c in cs]), lambda b: F.coalesce(b, F.lit(False)))
    zero = lambda cs: F.forall(F.array(*[blank(c) | (F.col(c).try_cast("double") == 0) for c in cs]), lambda b: F.coalesce(b, F.lit(False)))
    rules = [
        R.never("PLACEHOLDER", R.has_placeholder(*columns, "ticker", "trading_state")),
        R.must("NOT_AN_OFFICIAL_SESSION", F.col("_session")),
        R.must("IDENTITY_NOT_UNIQUE_ON_DATE", F.col("_ni") == 1), R.must("STATUS_NOT_UNIQUE_ON_DATE", F.col("_ns") == 1),
        R.never("TICKER_MISMATCH", ((F.col("_ni") == 1) & ~F.col("ticker").eqNullSafe(F.col("_ti"))) | ((F.col("_ns") == 1) & ~F.col("ticker").eqNullSafe(F.col("_ts")))),
        R.never("STATE_CONFLICTS_WITH_STATUS", (F.col("_ns") == 1) & ~F.coalesce(fits, F.lit(False))),
        R.never("DELISTED_IDENTITY_TRADES", (F.col("_listing") == "DELISTED") & (state != "NOT_LISTED_OR_NOT_ELIGIBLE")),
        R.never("NOT_LISTED_WITHOUT_EVIDENCE", (state == "NOT_LISTED_OR_NOT_ELIGIBLE")
                & ~F.coalesce((F.col("_s") == "DELISTED") | (F.col("_listing") == "DELISTED"), F.lit(False))),
    ]
    for group, cs in FIELD_GROUPS.items():
        if group not in supplied:
            rules.append(R.never(f"GROUP_NOT_SUPPLIED:{group}", ~none(cs)))
        elif group == "REFERENCE_PRICE":
            rules.append(R.never(f"FIELD_INVALID:{group}", ~none(cs) & ~positive(cs)))
        else:
            rules.append(R.never(f"FIELD_INVALID:{group}", traded & ~positive(cs)))
            rules.append(R.never(f"FIELD_ON_NON_TRADED_ROW:{group}", ~traded & ~(none(cs) if group == "OHLC" else zero(cs))))
    return R.check(joined, *rules).drop("_session", "_ni", "_ti", "_listing", "_ns", "_ts", "_s")


def check_event_table(rows: DataFrame, dataset: str, item_id: str) -> DataFrame:
    """Disclosure or corporate-action table rows."""
    base = [
        R.never("EVENT_IDENTITY_DUPLICATE", F.col("_n") > 1),
        R.must("EVENT_IDENTITY_MISSING", R.present("code") & R.present(item_id)),
        R.must("RAW_SHA256_FORM", R.is_sha256("raw_sha256")),
    ]
    if dataset == "disclosures":
        base.append(R.must("FETCHED_BEFORE_PUBLISHED", F.col("fetched_at") >= F.col("published_at")))
    else:
        base += [
            R.must("FACTOR_STATUS_INVALID", F.lower("factor_status").isin("official", "pending", "not_applicable")),
            R.never("OFFICIAL_FACTOR_INVALID", (F.lower("factor_status") == "official") & ~R.finite("adjustment_factor", 1e-7)),
        ]
    return R.check(duplicates(rows, "code", item_id), *base).drop("_n")


def check_delistings(rows: DataFrame, snapshot: Column) -> DataFrame:
    return R.check(
        duplicates(rows, "code"),
        R.never("DELISTED_IDENTITY_DUPLICATE", F.col("_n") > 1),
        R.must("DELISTING_AFTER_SNAPSHOT", F.col("delisting_date") <= snapshot),
        R.must("SOURCE_URL_NOT_HTTPS", F.col("source_url").startswith("https://")),
    ).drop("_n")


def check_benchmark_rows(rows: DataFrame, registry: DataFrame, bindings: DataFrame, frozen: Sequence[str]) -> DataFrame:
    """Benchmark rows against registry-frozen fields and the series' evidence binding."""
    reg = registry.select("benchmark_code", F.lit(True).alias("_reg"), *[F.col(c).alias(f"_{c}") for c in frozen])
    bound = bindings.select("benchmark_code", F.col("raw_sha256").alias("_bound"))
    same = [R.never(f"REGISTRY_FIELD:{c}", F.col("_reg") & ~F.col(c).eqNullSafe(F.col(f"_{c}"))) for c in frozen]
    return R.check(
        duplicates(rows, "benchmark_code", "trade_date").join(reg, "benchmark_code", "left").join(bound, "benchmark_code", "left"),
        R.never("BENCHMARK_KEY_DUPLICATE", F.col("_n") > 1),
        R.must("BENCHMARK_NOT_REGISTERED", F.col("_reg")),
        R.must("BENCHMARK_VALUE_INVALID", R.finite("benchmark_value") & (F.col("benchmark_value") > 0)),
        R.must("EVIDENCE_BINDING_MISMATCH", F.col("raw_sha256") == F.col("_bound")),
        *same,
    ).drop("_n", "_reg", "_bound", *[f"_{c}" for c in frozen])


def check_eod_rows(rows: DataFrame, identity: DataFrame, status: DataFrame, state: str = "trading_state") -> DataFrame:
    """End-of-day rows: OHLC rules plus exactly one identity and one matching status on the day.

    ``rows`` carries a unique ``row_id``.
    """
    probes = rows.select("row_id", "code", "trade_date")
    ids = interval_join(probes, identity.select("code", "valid_from", "valid_to"), ["code"], "trade_date", "valid_from", "valid_to")
    sts = interval_join(probes, status.select("code", "effective_from", "effective_to", F.col("status").alias("_s")), ["code"],
                        "trade_date", "effective_from", "effective_to")
    ni = ids.groupBy("row_id").agg(F.count("*").alias("_ni"))
    ns = sts.groupBy("row_id").agg(F.count("*").alias("_ns"), F.min("_s").alias("_s"))
    checked = check_ohlc(rows, state).withColumnRenamed("issue_codes", "_ohlc").join(ni, "row_id", "left").join(ns, "row_id", "left")
    fits = F.lit(False)
    for held, states in STATES_BY_STATUS.items():
        fits = fits | ((F.col("_s") == held) & F.col(state).isin(*states))
    codes = R.code_array(
        R.must("IDENTITY_NOT_UNIQUE_ON_DATE", F.col("_ni") == 1),
        R.must("STATUS_NOT_UNIQUE_ON_DATE", F.col("_ns") == 1),
        R.never("STATE_CONFLICTS_WITH_STATUS", (F.col("_ns") == 1) & ~F.coalesce(fits, F.lit(False))),
    )
    return checked.withColumn("issue_codes", F.concat("_ohlc", codes)).drop("_ohlc", "_ni", "_ns", "_s")


def check_source_observations(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Source observations and whether each contributes evidence."""
    qualified = F.col("query_status").isin("QUALIFIED", "ZERO_RESULT")
    checked = R.check(
        resolves(duplicates(rows, "source_id", "query_id"), manifest),
        R.never("OBSERVATION_DUPLICATE", F.col("_n") > 1),
        R.must("ACCESS_STATE_UNKNOWN", F.col("access_state").isin("AVAILABLE", "PARTIAL", "BLOCKED", "ERROR", "AUTH_REQUIRED", "UNTESTED")),
        R.must("OBSERVED_AFTER_DECISION", F.col("observed_at") <= F.col("decision_at")),
        R.never("QUALIFIED_WITHOUT_ACCESS", qualified & ~F.col("access_state").isin("AVAILABLE", "PARTIAL")),
        R.never("QUALIFIED_WITHOUT_ARTIFACT", qualified & F.col("_resolves").isNull()),
        R.never("ZERO_RESULT_WITH_ROWS", (F.col("query_status") == "ZERO_RESULT") & (F.col("result_count") > 0)),
    ).drop("_n", "_resolves")
    return checked.withColumn("contributes", qualified & (F.size("issue_codes") == 0))
