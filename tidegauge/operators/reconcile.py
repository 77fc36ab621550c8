"""Reconciliation: denominators, totals, providers, evidence hashes and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rules as R

# Fixed precedence orders, worst first. The three differ on purpose.
PROVIDER_CLASSES = ("BLOCKED", "SYNTHETIC_ONLY", "LICENSED_FEED_DEPENDENT", "LIVE_DEPENDENT", "PARTIAL",
                    "RECORDED_AUTHORIZED_FIXTURE", "PROVEN_REAL_EVIDENCE")
COMPONENT_CLASSES = ("BLOCKED", "SYNTHETIC_ONLY", "RECORDED_AUTHORIZED_FIXTURE", "LICENSED_FEED_DEPENDENT",
                     "LIVE_DEPENDENT", "PARTIAL")
RIGHTS_ORDER = ("RESTRICTED", "UNKNOWN", "FIXTURE_ONLY", "RESEARCH_USE_AUTHORIZED")
CAPTURE_ORDER = ("AUTH_REQUIRED", "BLOCKED", "ERROR", "UNTESTED", "PARTIAL")


def key_difference(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, in one full outer join of distinct keys."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    a = actual.select(*keys).distinct().withColumn("_a", F.lit(True))
    return e.join(a, list(keys), "full_outer").where("_e IS NULL OR _a IS NULL").select(
        *keys, F.when(F.col("_a").isNull(), "MISSING").otherwise("EXTRA").alias("side")
    )


def totals_reconcile(
    rows: DataFrame, totals: DataFrame, day: str, exact: dict[str, Column], tolerant: dict[str, tuple[Column, float]]
) -> DataFrame:
    """Declared totals per day against aggregated rows: exact counts, tolerant values.

    ``exact`` and ``tolerant`` map a column of ``totals`` to the aggregate of
    ``rows`` it declares. Both missing sides are reported.
    """
    aggs = [v.alias(f"_x_{k}") for k, v in exact.items()] + [v.alias(f"_x_{k}") for k, (v, _) in tolerant.items()]
    summed = rows.groupBy(day).agg(*aggs).withColumn("_rows", F.lit(True))
    joined = totals.withColumn("_declared", F.lit(True)).join(summed, day, "full_outer")
    rules = [
        R.never("MISSING_DAILY_TOTALS", F.col("_declared").isNull()),
        R.never("TOTALS_WITHOUT_ROWS", F.col("_rows").isNull()),
    ]
    both = F.col("_declared").isNotNull() & F.col("_rows").isNotNull()
    for k in exact:
        rules.append(R.never(f"{k.upper()}_DOES_NOT_RECONCILE", both & ~F.col(k).eqNullSafe(F.col(f"_x_{k}"))))
    for k, (_, tolerance) in tolerant.items():
        off = F.abs(F.col(k) - F.col(f"_x_{k}")) > tolerance
        rules.append(R.never(f"{k.upper()}_DOES_NOT_RECONCILE", both & F.coalesce(off, F.lit(True))))
    return R.check(joined, *rules)


def check_query_ledger(ledger: DataFrame, window_from: Column, window_to: Column) -> DataFrame:
    """Pagination complete, zero results declared as such, windows inside the collection window."""
    repeated = ledger.groupBy("query_id").agg(F.count("*").alias("_n"))
    zero = (F.col("result_count_declared") == 0) & (F.col("rows_normalized") == 0)
    return R.check(
        ledger.join(repeated, "query_id", "left"),
        R.must("QUERY_ID_MISSING", R.present("query_id")),
        R.never("QUERY_ID_DUPLICATE", F.col("_n") > 1),
        R.must("QUERY_WINDOW_OUTSIDE_COLLECTION",
               (F.col("window_from") <= F.col("window_to")) & (F.col("window_from") >= window_from)
               & (F.col("window_to") <= window_to)),
        R.must("QUERY_COUNTS_NEGATIVE",
               F.least("pages_declared", "pages_received", "result_count_declared", "rows_normalized") >= 0),
        R.must("PAGINATION_INCOMPLETE", F.col("pages_declared") == F.col("pages_received")),
        R.must("ZERO_RESULT_DOES_NOT_MATCH_COUNTS", F.col("zero_result") == zero),
    ).drop("_n")


def query_rows_reconcile(ledger: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Per dataset: the ledger's normalised rows against the rows that exist.

    ``row_counts(dataset, rows)``. An empty dataset needs an explicit zero query.
    """
    declared = ledger.groupBy("dataset").agg(
        F.sum("rows_normalized").alias("declared_rows"), F.bool_and("zero_result").alias("all_zero")
    )
    joined = declared.join(row_counts, "dataset", "full_outer")
    rows = F.coalesce("rows", F.lit(0))
    return R.check(
        joined,
        R.never("EMPTY_WITHOUT_EXPLICIT_ZERO_QUERY", (rows == 0) & ~F.coalesce("all_zero", F.lit(False))),
        R.never("QUERY_ROW_RECONCILIATION", (rows > 0) & ~F.col("declared_rows").eqNullSafe(rows)),
    )


def worst_of(value: str | Column, order: Sequence[str], fallback: str) -> Column:
    """Aggregate: the first value of ``order`` that occurs in the group."""
    col = F.col(value) if isinstance(value, str) else value
    ladder = F.lit(fallback)
    for name in reversed(order):
        ladder = F.when(F.coalesce(F.bool_or(col == name), F.lit(False)), name).otherwise(ladder)
    return ladder


def provider_consensus(
    rows: DataFrame, keys: Sequence[str], signature: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Agreeing providers keep the smallest provider's row; disagreement is quarantined.

    One pass: the smallest and largest signature of a key are equal exactly when
    all agree, so no per-key set is collected. Supporting hashes stay a long
    table ``(keys, raw_sha256)``, whatever the number of providers.
    """
    sig = F.to_json(F.struct(*signature), {"ignoreNullFields": "false"})
    rest = [c for c in rows.columns if c not in keys]
    grouped = rows.withColumn("_sig", F.sha2(sig, 256)).groupBy(*keys).agg(
        F.min("_sig").alias("_lo"), F.max("_sig").alias("_hi"), F.count("*").alias("provider_rows"),
        F.min_by(F.struct(*rest), "provider_id").alias("_row"),
        worst_of("evidence_classification", PROVIDER_CLASSES, "PARTIAL").alias("_class"),
        worst_of("rights_status", RIGHTS_ORDER, "UNKNOWN").alias("_rights"),
    )
    agreed = grouped.where("_lo = _hi").select(
        *keys, "provider_rows",
        *[F.col(f"_row.{c}").alias(c) for c in rest if c not in ("evidence_classification", "rights_status")],
        F.col("_class").alias("evidence_classification"), F.col("_rights").alias("rights_status"),
    )
    quarantine = grouped.where("_lo <> _hi").select(*keys, "provider_rows", F.lit("PROVIDER_DISAGREEMENT").alias("reason"))
    support = (
        rows.select(*keys, "raw_sha256").distinct()
        .join(agreed.select(*keys, F.col("raw_sha256").alias("_primary")), list(keys))
        .where(F.col("raw_sha256") != F.col("_primary")).drop("_primary")
    )
    return agreed, quarantine, support


NAME_ALIASES = {"CO": "COMPANY", "CORP": "COMPANY", "CORPORATION": "COMPANY", "TELECOM": "TELECOMMUNICATIONS"}
NAME_IGNORED = ("THE", "KSC", "KSCP", "KPSC", "PUBLIC", "SHAREHOLDING", "CLOSED")


def name_tokens(name: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.upper(name), r"[^A-Z0-9]+", " ")), " ")
    alias = F.create_map(*[F.lit(x) for kv in NAME_ALIASES.items() for x in kv])
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*NAME_IGNORED))
    return F.transform(kept, lambda w: F.coalesce(F.element_at(alias, w), w))


def names_compatible(left: Column, right: Column) -> Column:
    a, b = name_tokens(left), name_tokens(right)
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    smaller = F.least(F.size(sa), F.size(sb))
    return F.coalesce(a == b, F.lit(False)) | (
        (smaller > 0) & (F.size(F.array_intersect(sa, sb)) >= smaller * 0.8)
    )


def two_source_identity(first: DataFrame, second: DataFrame, snapshot: Column) -> DataFrame:
    """Two official lists by code: (code, isin, name) against (code, isin, ticker, name, listing_date)."""
    a = first.select("code", F.col("isin").alias("isin"), F.col("name").alias("first_name"),
                     F.col("ticker").alias("first_ticker")).withColumn("_a", F.lit(True))
    b = second.select("code", F.col("isin").alias("second_isin"), F.col("name").alias("second_name"),
                      F.col("ticker").alias("second_ticker"), "listing_date").withColumn("_b", F.lit(True))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return R.check(
        a.join(b, "code", "full_outer"),
        R.never("MISSING_IN_FIRST_SOURCE", F.col("_a").isNull()),
        R.never("MISSING_IN_SECOND_SOURCE", F.col("_b").isNull()),
        R.never("OFFICIAL_ISIN_CONFLICT", both & (F.col("isin") != F.col("second_isin"))),
        R.never("OFFICIAL_TICKER_CONFLICT", both & (F.col("first_ticker") != F.col("second_ticker"))),
        R.never("LISTING_DATE_AFTER_IDENTITY_SNAPSHOT", both & (F.col("listing_date") > snapshot)),
        R.never("OFFICIAL_NAME_CONFLICT", both & ~names_compatible(F.col("first_name"), F.col("second_name"))),
    ).drop("_a", "_b")


def unresolved_hashes(rows: DataFrame, manifest: DataFrame, hash_column: str, key: str, by_source: bool = False) -> DataFrame:
    """Pipe-separated evidence hashes that no manifest row carries (of the same source if asked)."""
    extra = ["source_id"] if by_source else []
    cited = rows.select(key, *extra, F.explode(F.split(F.lower(F.col(hash_column)), r"\|")).alias("sha256")).where(
        "sha256 <> ''"
    )
    known = manifest.select("sha256", *extra).distinct()
    return cited.join(known, ["sha256", *extra], "left_anti")


def two_source_binding(official: DataFrame, secondary: DataFrame) -> DataFrame:
    """Official (code, isin) bound to secondary (ticker, isin); exactly one partner each way."""
    o = official.groupBy("isin").agg(F.count("*").alias("_o"), F.min("code").alias("code"))
    s = secondary.groupBy("isin").agg(F.count("*").alias("_s"), F.min("ticker").alias("ticker"))
    return R.check(
        o.join(s, "isin", "full_outer"),
        R.never("SECONDARY_NOT_FOUND", F.col("_s").isNull()),
        R.never("OFFICIAL_NOT_FOUND", F.col("_o").isNull()),
        R.never("OFFICIAL_ISIN_SHARED", F.col("_o") > 1),
        R.never("SECONDARY_ISIN_SHARED", F.col("_s") > 1),
    ).drop("_o", "_s")


def universe_checks(expected: DataFrame, covered: DataFrame, findings: DataFrame, key: str = "code") -> DataFrame:
    """One row: covered within expected, findings within covered, exact coverage."""
    e, c, f = [d.select(key).distinct() for d in (expected, covered, findings)]
    outside = c.join(e, key, "left_anti").agg(F.count("*").alias("covered_outside_expected"))
    missing = e.join(c, key, "left_anti").agg(F.count("*").alias("expected_not_covered"))
    stray = f.join(c, key, "left_anti").agg(F.count("*").alias("findings_outside_covered"))
    # Three one-row aggregates side by side.
    one = F.lit(1)
    joined = (
        outside.withColumn("_k", one).join(missing.withColumn("_k", one), "_k")
        .join(stray.withColumn("_k", one), "_k").drop("_k")
    )
    return joined.withColumn(
        "full_market", (F.col("covered_outside_expected") == 0) & (F.col("expected_not_covered") == 0)
        & (F.col("findings_outside_covered") == 0)
    )


def binding_checks(bindings: DataFrame, covered: DataFrame, decision_day: Column) -> DataFrame:
    """Identity bindings against the covered codes: one per code, numeric, effective on the decision day, the same set."""
    n = bindings.groupBy("code").agg(F.count("*").alias("_n"))
    c = covered.select("code", F.lit(True).alias("_covered")).distinct()
    joined = bindings.withColumn("_bound", F.lit(True)).join(n, "code").join(c, "code", "full_outer")
    bound = F.col("_bound")
    return R.check(
        joined,
        R.never("BINDING_MISSING", bound.isNull()),
        R.never("BINDING_OUTSIDE_COVERED", bound & F.col("_covered").isNull()),
        R.never("BINDING_CODE_NOT_UNIQUE_NUMERIC", bound & ((F.col("_n") > 1) | ~F.col("code").cast("string").rlike("^[0-9]+$"))),
        R.never("BINDING_INTERVAL_REVERSED", bound & (F.col("valid_to") < F.col("valid_from"))),
        R.never("BINDING_NOT_EFFECTIVE", bound & ((F.col("valid_from") > decision_day) | (F.col("valid_to") < decision_day))),
    ).drop("_bound", "_n", "_covered")


def stop_gates(gates: DataFrame, required: Sequence[str]) -> DataFrame:
    """Verdict per run over ``(run_id, gate_id, status, severity, failure_reason, recovery_action, dates, events)``.

    ``minimum_dates`` and ``minimum_events`` come with the run rows.
    """
    failed = F.col("status") == "FAIL"
    per_gate = gates.groupBy("run_id", "gate_id").agg(
        F.count("*").alias("n"),
        F.bool_or(failed & (F.col("severity") == "CRITICAL")).alias("critical"),
        F.bool_or(~F.col("status").isin("PASS", "FAIL") | ~F.col("severity").isin("CRITICAL", "INFERENCE")).alias("invalid"),
        F.bool_or(failed & (~R.present("failure_reason") | ~R.present("recovery_action"))).alias("no_recovery"),
        F.max("dates").alias("dates"), F.max("minimum_dates").alias("minimum_dates"),
        F.max("events").alias("events"), F.max("minimum_events").alias("minimum_events"),
    )
    per_run = per_gate.groupBy("run_id").agg(
        F.count_if(F.col("gate_id").isin(*required)).alias("required_present"),
        F.count_if(F.col("n") > 1).alias("duplicates"),
        F.count_if("critical").alias("critical_failures"),
        F.count_if("invalid").alias("invalid_gates"),
        F.count_if("no_recovery").alias("gates_without_recovery"),
        F.max("dates").alias("dates"), F.max("minimum_dates").alias("minimum_dates"),
        F.max("events").alias("events"), F.max("minimum_events").alias("minimum_events"),
    )
    errors = R.code_array(
        R.never("DUPLICATE_GATE", F.col("duplicates") > 0),
        R.never("INVALID_GATE", F.col("invalid_gates") > 0),
        R.never("FAILED_GATE_LACKS_RECOVERY", F.col("gates_without_recovery") > 0),
        R.never("MISSING_REQUIRED_GATES", F.col("required_present") < len(required)),
    )
    return per_run.withColumn("errors", errors).withColumn(
        "verdict",
        F.when((F.size("errors") > 0) | (F.col("critical_failures") > 0), "STOP_BACKTEST")
        .when((F.col("dates") < F.col("minimum_dates")) | (F.col("events") < F.col("minimum_events")), "STOP_INFERENCE")
        .otherwise("READY_TO_SCORE"),
    )


def gate_rollup(components: DataFrame) -> DataFrame:
    """Gate status from ``(gate, component, status, classification, rights_compatible, errors, limitations)``."""
    g = components.groupBy("gate").agg(
        F.bool_or((F.col("status") == "BLOCKED") | (F.col("errors") > 0)).alias("blocked"),
        F.bool_or((F.col("status") == "PARTIAL") | (F.col("limitations") > 0)).alias("partial"),
        worst_of("classification", COMPONENT_CLASSES, "PROVEN_REAL_EVIDENCE").alias("classification"),
        F.bool_and("rights_compatible").alias("rights_compatible"),
        F.count("*").alias("components"),
    )
    blocked = F.col("blocked") | (F.col("classification") == "BLOCKED")
    partial = F.col("partial") | (F.col("classification") != "PROVEN_REAL_EVIDENCE") | ~F.col("rights_compatible")
    status = F.when(blocked, "BLOCKED").when(partial, "PARTIAL").otherwise("PASS")
    return g.select(
        "gate", "components", status.alias("status"),
        F.when(blocked, "BLOCKED").otherwise(F.col("classification")).alias("classification"),
        (F.col("rights_compatible") & ~blocked).alias("rights_compatible"),
    )


def foundation_status(gates: DataFrame, policy_frozen: bool = True) -> DataFrame:
    """Overall readiness over the gate table, one row."""
    agg = gates.agg(
        F.count("*").alias("gates"), F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "BLOCKED").alias("blocked"),
        worst_of("classification", COMPONENT_CLASSES, "PROVEN_REAL_EVIDENCE").alias("classification"),
    )
    ready = (F.col("passed") == F.col("gates")) & (F.col("classification") == "PROVEN_REAL_EVIDENCE") & F.lit(policy_frozen)
    return agg.withColumn(
        "status",
        F.when(F.col("blocked") > 0, "DATA_FOUNDATION_BLOCKED").when(ready, "DATA_FOUNDATION_READY_FOR_BASELINE_BACKTEST")
        .otherwise("DATA_FOUNDATION_PARTIAL"),
    )


def capture_states(attempts: DataFrame) -> DataFrame:
    """State per source from ``(source_id, state, captured)`` attempts."""
    return attempts.groupBy("source_id").agg(
        F.when(F.bool_and((F.col("state") == "AVAILABLE") & F.col("captured")), "AVAILABLE")
        .when(F.bool_or("captured"), "PARTIAL")
        .otherwise(worst_of("state", CAPTURE_ORDER, "ERROR")).alias("source_state"),
        F.count("*").alias("attempts"), F.bool_or("captured").alias("any_captured"),
    )


def capture_batch(states: DataFrame) -> DataFrame:
    return states.agg(
        F.count("*").alias("sources"), F.count_if(F.col("source_state") != "AVAILABLE").alias("degraded"),
        F.when(~F.coalesce(F.bool_or("any_captured"), F.lit(False)), "FAILED")
        .when(F.count_if(F.col("source_state") != "AVAILABLE") > 0, "DEGRADED").otherwise("COMPLETE").alias("status"),
    )


def attempt_rollup(attempts: DataFrame, reported: DataFrame) -> DataFrame:
    """Attempts per (source, wave): numbered 1..n without a hole, and equal to the report's counts.

    Contiguity needs no window: unique numbers with minimum 1 and maximum n are contiguous.
    """
    a = attempts.groupBy("source_id", "wave").agg(
        F.count("*").alias("attempts"), F.count_distinct("attempt_no").alias("_d"),
        F.min("attempt_no").alias("_lo"), F.max("attempt_no").alias("_hi"),
        F.count_if(F.col("outcome") == "SUCCESS").alias("successes"),
    )
    return R.check(
        a.join(reported, ["source_id", "wave"], "full_outer"),
        R.never("ATTEMPTS_NOT_CONTIGUOUS",
                (F.col("_lo") != 1) | (F.col("_hi") != F.col("attempts")) | (F.col("_d") != F.col("attempts"))),
        R.never("ATTEMPTS_WITHOUT_REPORT", F.col("reported_attempts").isNull()),
        R.never("REPORT_WITHOUT_ATTEMPTS", F.col("attempts").isNull()),
        R.never("ATTEMPT_COUNT_MISMATCH", F.col("attempts") != F.col("reported_attempts")),
    ).drop("_d", "_lo", "_hi")


def comparison_readiness(series: DataFrame, roles: DataFrame, rules: DataFrame) -> DataFrame:
    """Product readiness: every role a product needs has a complete series.

    ``series(benchmark_code, complete)``, ``roles(role, benchmark_code)``,
    ``rules(product_id, role)``.
    """
    ready = roles.join(series, "benchmark_code", "left").groupBy("role").agg(
        F.bool_or(F.coalesce("complete", F.lit(False))).alias("ready")
    )
    return rules.join(ready, "role", "left").groupBy("product_id").agg(
        F.count("*").alias("roles_required"), F.count_if(F.coalesce("ready", F.lit(False))).alias("roles_ready"),
        F.bool_and(F.coalesce("ready", F.lit(False))).alias("comparison_ready"),
    )


def cutoff_scan(df: DataFrame, dataset: str, key: str, columns: Sequence[str], cutoff: Column) -> DataFrame:
    """Rows in which any availability-type column lies after the collection cutoff."""
    late = [R.never(f"AFTER_CUTOFF:{c}", F.col(c) > cutoff) for c in columns]
    return R.issues(R.check(df, *late), dataset, key)


def binding_consistency(series: DataFrame, registry: DataFrame) -> DataFrame:
    """One evidence binding per series, from the registered source, shared with no other series."""
    per_code = series.groupBy("benchmark_code").agg(
        F.min(F.struct("source_id", "raw_sha256")).alias("_lo"), F.max(F.struct("source_id", "raw_sha256")).alias("_hi"),
        F.min("source_id").alias("source_id"), F.min("raw_sha256").alias("raw_sha256"), F.count("*").alias("rows"),
    )
    shared = per_code.groupBy("raw_sha256").agg(F.count("*").alias("_shared"))
    return R.check(
        per_code.join(registry.select("benchmark_code", F.col("source_id").alias("_registered")), "benchmark_code", "left")
        .join(shared, "raw_sha256"),
        R.never("SERIES_HAS_SEVERAL_BINDINGS", F.col("_lo") != F.col("_hi")),
        R.must("BINDING_SOURCE_NOT_REGISTERED", F.col("_registered") == F.col("source_id")),
        R.never("BINDING_SHARED_ACROSS_SERIES", F.col("_shared") > 1),
    ).drop("_lo", "_hi", "_registered", "_shared")
