"""Source observations of a network run against the source catalogue, the run's artifacts and the trust registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.operators.pit import interval_join
from tidegauge.session import broadcast_if_small, materialise

# Fixed values.
ACCESS_STATES = ("AVAILABLE", "PARTIAL", "BLOCKED", "ERROR", "AUTH_REQUIRED", "UNTESTED")
OPEN_STATES = ("AVAILABLE", "PARTIAL")
QUERY_STATUSES = ("QUALIFIED", "ZERO_RESULT", "BLOCKED", "ERROR", "AUTH_REQUIRED", "PARSER_DRIFT", "DATA_QUALITY_REJECTED")
CONTRIBUTING_STATUSES = ("QUALIFIED", "ZERO_RESULT")

_KEY = ["run_id", "row_index"]


def check_run_observations(
    rows: DataFrame, catalogue: DataFrame, artifacts: DataFrame, trust: DataFrame | None = None, max_age_hours: float = 36.0
) -> DataFrame:
    """Every observation with its ``issue_codes``, ``stale``, the ``effective_status`` and whether it ``contributes``.

    ``rows(run_id, row_index, source_id, state, access_mode, decision_at, attempted_at, query_status, roles_observed,
    qualified_items, zero_result, raw_sha256s, data_quality_flags, enabled_for_run, activation_id,
    activation_evidence_sha256, entitlement_id, entitlement_evidence_sha256)``; ``catalogue(source_id, source_class, roles,
    access_modes, enabled_by_default, requires_entitlement)``; ``artifacts(run_id, source_id, sha256, capture_kind)``;
    ``trust(source_id, binding, binding_id, entry_id, valid_from, valid_to)`` with ACTIVATION and ENTITLEMENT bindings.

    ``(run_id, row_index)`` names a row. The first row of a source in a run counts, later ones are repeated. A stale row is
    a warning: its status becomes DATA_QUALITY_REJECTED and is then held against items and zero result like any other.
    Evidence counts only under the run and source it was stored for, and an access receipt alone establishes nothing.
    Sources that are disabled, licensed or need an entitlement contribute only by one trust entry, the same at the attempt and at
    the decision; without ``trust`` they never do. NULL arrays are empty, NULL flags and numbers break their rule; rules that
    need a source's contract are not judged for an unknown source.

    Evidence is met hash by hash, so no array of artifacts is built for a source, whatever its share of them. Rules that need
    the row and its source alone are judged first, so arrays of hashes and what else only they need are not shuffled.
    """
    empty = F.array().cast("array<string>")
    given = rows.withColumns({
        "roles_observed": F.coalesce("roles_observed", empty), "raw_sha256s": F.coalesce("raw_sha256s", empty),
        "data_quality_flags": F.coalesce("data_quality_flags", empty)})
    # Read for the sources, the first rows and the bindings: written once, without what is large.
    heads = materialise(given.select(*_KEY, "source_id", "attempted_at", "decision_at", "activation_id", "entitlement_id"))
    first = heads.groupBy("run_id", "source_id").agg(F.min("row_index").alias("_first"))
    later = heads.select(*_KEY, "source_id").join(first, ["run_id", "source_id"]).where(F.col("row_index") > F.col("_first"))
    # One row a key, with the sources it repeats: a key names one row.
    repeats = later.groupBy(*_KEY).agg(F.collect_set("source_id").alias("_repeats"))
    # Few sources reach the rows where these lie: only those that a row names.
    named = heads.select("source_id").distinct()
    sources = broadcast_if_small(materialise(catalogue.join(named, "source_id", "left_semi").select(
        "source_id", "source_class", F.col("roles").alias("_roles"), F.col("access_modes").alias("_modes"), "enabled_by_default", "requires_entitlement")))
    judged = given.join(sources, "source_id", "left")

    age_hours = (F.unix_micros("decision_at") - F.unix_micros("attempted_at")) / 3.6e9
    judged = judged.withColumn("stale", F.coalesce(age_hours > max_age_hours, F.lit(False))).withColumn(
        "effective_status", F.when(F.col("stale"), "DATA_QUALITY_REJECTED").otherwise(F.col("query_status")))
    status, items = F.col("effective_status"), F.col("qualified_items")
    offered = F.coalesce(status.isin(*CONTRIBUTING_STATUSES), F.lit(False))
    contributing = offered & F.coalesce(F.col("state").isin(*OPEN_STATES), F.lit(False)) & (F.size("data_quality_flags") == 0)
    disabled = contributing & ~F.col("enabled_by_default")
    entitled = contributing & F.col("requires_entitlement")
    trusted = contributing & (~F.col("enabled_by_default") | F.col("requires_entitlement") | (F.col("source_class") == "LICENSED"))
    wanted = (~F.col("enabled_by_default")).cast("int") + F.col("requires_entitlement").cast("int")

    def found(flag):
        return F.coalesce(flag, F.lit(False))

    # One text of codes each, empty for a clean row.
    own = R.joined(
        R.must("ACCESS_STATE_UNKNOWN", R.in_set("state", ACCESS_STATES)),
        R.must("QUERY_STATUS_UNKNOWN", R.in_set("query_status", QUERY_STATUSES)),
        R.never("ACCESS_MODE_OUTSIDE_CONTRACT", F.col("_modes").isNotNull() & ~found(F.array_contains("_modes", F.col("access_mode")))),
        R.must("ATTEMPT_TIME_MISSING", F.col("attempted_at").isNotNull()),
        R.never("ATTEMPTED_AFTER_DECISION", F.col("attempted_at") > F.col("decision_at")),
        R.never("ROLES_MISSING", F.size("roles_observed") == 0),
        R.never("ROLES_OUTSIDE_CONTRACT", F.size(F.array_except("roles_observed", "_roles")) > 0),
        R.must("QUALIFIED_ITEMS_INVALID", items >= 0),
        R.must("ZERO_RESULT_CONTRADICTS_STATUS", F.col("zero_result") == (status == "ZERO_RESULT")),
        R.never("QUALIFIED_WITHOUT_ITEMS", (status == "QUALIFIED") & (items <= 0)),
        R.never("ZERO_RESULT_WITH_ITEMS", (status == "ZERO_RESULT") & (items != 0)),
        R.never("ITEMS_WITHOUT_QUALIFICATION", ~offered & (items != 0)),
        R.never("EVIDENCE_HASH_MALFORMED", F.exists("raw_sha256s", lambda h: ~found(R.is_sha256(h)))),
        R.never("EVIDENCE_HASH_REPEATED", F.size(F.array_distinct("raw_sha256s")) < F.size("raw_sha256s")))
    tape = (contributing & F.array_contains("roles_observed", "EXECUTION_TAPE")
            & ~((F.col("source_class") == "LICENSED") & F.col("requires_entitlement")))
    judged = judged.select(
        *rows.columns, *[c for c in ("stale", "effective_status") if c not in rows.columns], F.col("_roles").isNotNull().alias("_known"), own.alias("_own"), offered.alias("_offered"),
        contributing.alias("_contributing"), disabled.alias("_disabled"), entitled.alias("_entitled"), trusted.alias("_trusted"), wanted.alias("_wanted"),
        (found(F.col("enabled_for_run")) & R.present("activation_id")).alias("_activated"), R.present("entitlement_id").alias("_entitlement"), tape.alias("_tape"))
    judged = judged.join(_evidence(given, artifacts), _KEY, "left").join(_bindings(heads, sources, trust), _KEY, "left").join(repeats, _KEY, "left")
    offered, disabled, entitled, trusted = [F.col(c) for c in ("_offered", "_disabled", "_entitled", "_trusted")]
    checked = R.check(
        judged,
        R.must("SOURCE_UNKNOWN", F.col("_known")),
        R.never("SOURCE_REPEATED", F.array_contains("_repeats", F.col("source_id"))),
        F.col("_own"),
        R.never("EVIDENCE_NOT_OF_SOURCE", offered & ~found(F.col("_all_resolved"))),
        R.never("ONLY_ACCESS_RECEIPTS", offered & found(F.col("_all_resolved")) & ~found(F.col("_usable"))),
        R.never("ACTIVATION_MISSING", disabled & ~F.col("_activated")),
        R.never("ACTIVATION_EVIDENCE_UNRESOLVED", disabled & ~found(F.col("_activation_held"))),
        R.never("ENTITLEMENT_UNRESOLVED", entitled & ~(F.col("_entitlement") & found(F.col("_receipt_held")))),
        R.never("TRUST_NOT_UNIQUE", trusted & ~found(F.lit(trust is not None) & (F.coalesce("_unique", F.lit(0)) >= F.col("_wanted")))),
        R.never("TRUST_BINDING_CHANGED", trusted & found(F.col("_changed"))),
        R.never("TRUST_ENTRIES_DIFFER", trusted & (F.col("_entries") > 1)),
        R.never("EXECUTION_TAPE_WITHOUT_LICENCE", F.col("_tape")),
    )
    return checked.withColumn("contributes", F.col("_contributing") & (F.size("issue_codes") == 0)).select(
        *rows.columns, "stale", "effective_status", "issue_codes", "contributes")


def _place(sha256: str) -> Column:
    """A hash under its run and source in 16 bytes; NULL where one of them is NULL."""
    run, source = F.col("run_id").cast("string"), F.col("source_id").cast("string")
    named = F.concat(F.length(run).cast("string"), F.lit(":"), F.length(source).cast("string"), F.lit(":"), run, source, F.col(sha256))
    return F.unhex(F.substring(F.sha2(named, 256), 1, 32))


def _evidence(given: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per row: all hashes stored for its source, one of them more than a receipt, its activation and receipt among them.

    Run, source and hash meet as one digest, so of either side no text is shuffled.
    """
    stored = artifacts.select(_place("sha256").alias("_place"), "capture_kind").where("_place IS NOT NULL").groupBy("_place").agg(
        F.bool_or(F.col("capture_kind") == "ACCESS_RECEIPT").alias("_receipt"),
        F.bool_or(F.col("capture_kind").isNull() | (F.col("capture_kind") != "ACCESS_RECEIPT")).alias("_other"))
    hashes = given.select(
        *_KEY, "source_id", "activation_evidence_sha256", "entitlement_evidence_sha256", F.explode("raw_sha256s").alias("sha256")).select(
        *_KEY, _place("sha256").alias("_place"), (F.col("sha256") == F.col("activation_evidence_sha256")).alias("_activation"),
        (F.col("sha256") == F.col("entitlement_evidence_sha256")).alias("_entitlement"))
    met = hashes.join(stored, "_place", "left")
    held = F.col("_other").isNotNull()
    return met.groupBy(*_KEY).agg(
        F.bool_and(held).alias("_all_resolved"), F.bool_or(F.coalesce("_other", F.lit(False))).alias("_usable"),
        F.bool_or(held & F.col("_activation")).alias("_activation_held"),
        F.bool_or(F.coalesce("_receipt", F.lit(False)) & F.col("_entitlement")).alias("_receipt_held"))


def _bindings(given: DataFrame, sources: DataFrame, trust: DataFrame | None) -> DataFrame:
    """Per row: how many of the bindings its source needs have exactly one entry at both instants, and whether these agree."""
    if trust is None:
        return given.select(*_KEY, F.lit(0).alias("_unique"), F.lit(False).alias("_changed"), F.lit(0).alias("_entries")).limit(0)
    needs = sources.where(~F.col("enabled_by_default") | F.col("requires_entitlement")).select("source_id", "enabled_by_default", "requires_entitlement")
    asked = given.join(needs, "source_id").select(
        *_KEY, "source_id", "attempted_at", "decision_at", "enabled_by_default", "requires_entitlement",
        F.explode(F.array(F.struct(F.lit("ACTIVATION").alias("binding"), F.col("activation_id").alias("binding_id")),
                          F.struct(F.lit("ENTITLEMENT").alias("binding"), F.col("entitlement_id").alias("binding_id")))).alias("_b"),
    ).where(F.when(F.col("_b.binding") == "ACTIVATION", ~F.col("enabled_by_default")).otherwise(F.col("requires_entitlement"))).select(
        *_KEY, "source_id", "attempted_at", "decision_at", "_b.*")

    name = ["source_id", "binding", "binding_id"]
    # Entries that someone asks for, written: their size is known before a join decides to send them everywhere.
    held = materialise(trust.select(*name, "entry_id", "valid_from", "valid_to").join(asked.select(*name).distinct(), name, "left_semi"))
    instants = F.explode(F.array(F.struct(F.lit(False).alias("now"), F.col("attempted_at").alias("at")), F.struct(F.lit(True).alias("now"), F.col("decision_at").alias("at"))))
    probes = asked.select(*_KEY, *name, instants.alias("_i")).select(*_KEY, *name, "_i.*")
    # Only entries of the instant's own part of the calendar meet, whatever the number of entries of a binding.
    inside = interval_join(probes, held, name, "at", "valid_from", "valid_to").where("valid_to IS NULL OR at < valid_to")
    per_binding = inside.groupBy(*_KEY, "binding").agg(
        F.count_if(~F.col("now")).alias("_then"), F.count_if("now").alias("_now"),
        F.min(F.when(~F.col("now"), F.col("entry_id"))).alias("_then_id"), F.min(F.when(F.col("now"), F.col("entry_id"))).alias("_now_id"))
    unique = (F.col("_then") == 1) & (F.col("_now") == 1)
    return per_binding.groupBy(*_KEY).agg(
        F.count_if(unique).alias("_unique"), F.bool_or(unique & (F.col("_then_id") != F.col("_now_id"))).alias("_changed"),
        F.count_distinct(F.when(unique, F.col("_now_id"))).alias("_entries"))
