"""Data-foundation checks: corporate-action integration, gate tables, republish and replay contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.functions.digest import differing_nodes, merkle_tree, table_digest
from tidegauge.functions.text import check_url
from tidegauge.operators.pit import interval_join
from tidegauge.session import broadcast_if_small, materialise

AXES = ("identity", "calendar", "status", "eod", "benchmark", "policy")


# Fixed values.
CAPTURE_KINDS = ("RAW_PAGE", "RAW_DOWNLOAD", "USER_EXPORT", "ACCESS_RECEIPT", "ARCHIVE_CAPTURE")


def integrate_actions(
    actions: DataFrame, identity: DataFrame, calendar: DataFrame, status: DataFrame, eod: DataFrame, benchmark: DataFrame, policy: DataFrame
) -> DataFrame:
    """Each action against six sides, a match count per side, PASS / PARTIAL / BLOCKED.

    Identity and status are bucketed interval joins of the distinct codes and days, the rest equi-joins; every side is
    reduced to one count per key before it meets the actions, so no side multiplies another. Rows that share an id are
    summed. Exactly one match passes; none on eod, benchmark or policy is partial; anything else blocks.
    """
    at = ["code", "ex_date"]
    days = actions.select(*at).distinct()

    def count(joined: DataFrame, name: str, *keys: str) -> DataFrame:
        return joined.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"))

    def inside(side: DataFrame, start: str, end: str, name: str) -> DataFrame:
        return count(interval_join(days, side.select("code", start, end), ["code"], "ex_date", start, end), name, *at)

    def few(side: DataFrame, name: str, key: str) -> tuple[DataFrame, list[str]]:
        return broadcast_if_small(materialise(count(side, name, key))), [key]

    sides = [
        few(calendar.where("is_trading_day").select(F.col("trade_date").alias("ex_date")), "calendar", "ex_date"),
        few(benchmark.select(F.col("trade_date").alias("ex_date")), "benchmark", "ex_date"), few(policy.select("action_type"), "policy", "action_type"),
        (count(eod.select("code", F.col("trade_date").alias("ex_date")), "eod", *at), at),
        (inside(identity, "valid_from", "valid_to", "identity"), at), (inside(status, "effective_from", "effective_to", "status"), at)]
    joined = actions
    for side, keys in sides:
        joined = joined.join(side, keys, "left")
    counts = [f"n_{n}" for n in AXES]
    joined = joined.select(*actions.columns, *[F.when(F.col("action_id").isNotNull(), F.coalesce(c, F.lit(0))).alias(c) for c in counts])
    # An id that stands on several rows has the matches of all of them.
    repeated = materialise(actions.where("action_id IS NOT NULL").groupBy("action_id").agg(F.count("*").alias("n")).where("n > 1").select("action_id"))
    if repeated.limit(1).count():
        several = broadcast_if_small(repeated)
        sums = joined.join(several, "action_id", "left_semi").groupBy("action_id").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
        joined = joined.join(sums, "action_id", "left").select(*actions.columns, *[F.coalesce(f"_{c}", c).alias(c) for c in counts])
    soft = ("eod", "benchmark", "policy")

    def axis(name: str) -> Column:
        n = F.coalesce(F.col(f"n_{name}"), F.lit(0))
        missing = "PARTIAL" if name in soft else "BLOCKED"
        return F.when(n == 1, "PASS").when(n == 0, missing).otherwise("BLOCKED").alias(f"axis_{name}")

    judged = joined.select(*actions.columns, *[axis(n) for n in AXES])
    states = F.array(*[F.col(f"axis_{n}") for n in AXES])
    return judged.withColumn(
        "status", F.when(F.array_contains(states, "BLOCKED"), "BLOCKED").when(F.array_contains(states, "PARTIAL"), "PARTIAL").otherwise("PASS")
    )


def gate_component(gate: str, component: str, checked: DataFrame, classification: str = "PROVEN_REAL_EVIDENCE", rights: bool = True) -> DataFrame:
    """One gate-component row from any checked table: its size, its defects, its status."""
    bad = F.count_if(F.size("issue_codes") > 0)
    return checked.agg(F.count("*").alias("rows"), bad.alias("errors")).select(
        F.lit(gate).alias("gate"), F.lit(component).alias("component"), "rows", "errors",
        F.when((F.col("errors") > 0) | (F.col("rows") == 0), "BLOCKED").otherwise("PASS").alias("status"),
        F.lit(classification).alias("classification"), F.lit(rights).alias("rights_compatible"), F.lit(0).alias("limitations"),
    )


def gate_table(components: Sequence[DataFrame]) -> DataFrame:
    """The union of gate components; feed it to ``reconcile.gate_rollup``."""
    table = components[0]
    for c in components[1:]:
        table = table.unionByName(c)
    return table


def recheck_published(
    published: DataFrame, recomputed: DataFrame, keys: Sequence[str], saved_sha256: str, saved_rows: int, saved_tree: DataFrame | None = None
) -> DataFrame:
    """A published table against its recomputation, its saved digest and, if given, its saved tree; issue rows only.

    With a tree each leaf that has changed is named by its prefix.
    """
    fields = [c for c in recomputed.columns if c not in keys]
    a = published.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields]).withColumn("_p", F.lit(True))
    b = recomputed.withColumn("_r", F.lit(True))
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(f"RECOMPUTED:{c}")) for c in fields]))
    codes = (
        F.when(F.col("_r").isNull(), F.array(F.lit("PUBLISHED_ROW_UNEXPECTED"))).when(F.col("_p").isNull(), F.array(F.lit("PUBLISHED_ROW_MISSING")))
        .otherwise(differs)
    )
    rows = R.issues(a.join(b, list(keys), "full_outer").withColumn("issue_codes", codes), "published_table", *keys)
    whole = table_digest(published).select(
        F.lit("published_table").alias("operator"), F.lit("*").alias("row_key"),
        F.explode(R.code_array(
            R.never("SAVED_DIGEST_MISMATCH", F.col("table_sha256") != saved_sha256), R.never("SAVED_ROW_COUNT_MISMATCH", F.col("row_count") != saved_rows)
        )).alias("code"), F.lit("ERROR").alias("severity"))
    if saved_tree is not None:
        changed = differing_nodes(merkle_tree(published), saved_tree)
        whole = whole.unionByName(changed.select(
            F.lit("published_table").alias("operator"), F.concat(F.lit("leaf "), "prefix").alias("row_key"), F.lit("SAVED_LEAF_MISMATCH").alias("code"),
            F.lit("ERROR").alias("severity")))
    return rows.unionByName(whole)


def check_run_manifest(artifacts: DataFrame, sources: DataFrame, decision_at: Column, stored: DataFrame | None = None) -> DataFrame:
    """Run-manifest rows: URL contract, source domain, observed no later than the decision.

    With ``stored(path, size_bytes, sha256)``, a scan of the run's folder, ``artifacts`` also has ``path, size_bytes,
    capture_kind``: each row must name one file below ``raw/``, no other row's, that holds the declared bytes.
    """
    side = sources.select("source_id", F.lit(True).alias("_known"), F.col("allowed_domain").alias("_domain"))
    urls = check_url(artifacts, "source_url").withColumnRenamed("issue_codes", "_url")
    host = F.lower(F.try_parse_url("source_url", F.lit("HOST")))
    codes = R.code_array(
        R.must("SOURCE_UNKNOWN", F.col("_known")),
        R.never("SOURCE_DOMAIN_MISMATCH", F.col("_known")
                & ~F.coalesce((host == F.col("_domain")) | host.endswith(F.concat(F.lit("."), F.col("_domain"))), F.lit(False))),
        R.must("OBSERVED_AFTER_DECISION", F.col("observed_at") <= decision_at),
        R.must("SHA256_FORM", R.is_sha256("sha256")),
    )
    rows = urls.join(side, "source_id", "left").withColumn("issue_codes", F.concat("_url", codes)).drop("_url", "_known", "_domain")
    if stored is None:
        return rows
    found = stored.select("path", F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha"))
    shared = artifacts.groupBy("path").agg(F.count("*").alias("_paths")).where("_paths > 1")
    kept = R.code_array(
        R.must("PATH_OUTSIDE_RAW", F.col("path").rlike("^raw/[^/]") & ~F.col("path").rlike(r"(^|/)\.{1,2}(/|$)|//|/$")),
        R.never("PATH_DUPLICATE", F.col("_paths").isNotNull()),
        R.must("ARTIFACT_MISSING", F.col("_sha").isNotNull()),
        R.never("ARTIFACT_HASH_MISMATCH", F.col("_sha").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("_sha"))),
        R.never("ARTIFACT_SIZE_MISMATCH", F.col("_sha").isNotNull() & ~F.col("size_bytes").eqNullSafe(F.col("_size"))),
        R.must("CAPTURE_KIND_INVALID", R.in_set("capture_kind", CAPTURE_KINDS)))
    return rows.join(found, "path", "left").join(shared, "path", "left").withColumn("issue_codes", F.concat("issue_codes", kept)).drop("_size", "_sha", "_paths")


def check_replay_rows(rows: DataFrame) -> DataFrame:
    """Replay row: everything known at the decision, the outcome only after it, prices and costs valid."""
    at = F.col("decision_at")
    before = ("identity_available_at", "sector_available_at", "feature_available_at", "score_computed_at")
    prices = ("entry_price", "exit_price", "market_entry", "market_exit", "sector_entry", "sector_exit")
    positive = F.lit(True)
    for p in prices:
        positive = positive & R.finite(p) & (F.col(p) > 0)
    return R.check(
        rows,
        *[R.must(f"LOOK_AHEAD:{c}", F.col(c) <= at) for c in before],
        R.must("SCORE_BEFORE_FEATURES", F.col("feature_available_at") <= F.col("score_computed_at")),
        R.must("OUTCOME_NOT_AFTER_DECISION", F.col("outcome_available_at") > at),
        R.must("PRICE_NOT_POSITIVE", positive),
        R.must("COST_INVALID", R.finite("cost_return", 0)),
        R.never("SELECTED_WHILE_ABSTAINED", F.col("selected") & F.col("abstained")),
    )


def replay_returns(rows: DataFrame) -> DataFrame:
    """Gross, net and excess returns of replay rows."""
    gross = F.try_divide(F.col("exit_price") * F.col("adjustment_factor"), F.col("entry_price")) - 1.0 + F.col("cash_return")
    return rows.withColumns({
        "gross": gross, "net": gross - F.col("cost_return"),
        "market_excess": gross - F.col("cost_return") - (F.try_divide("market_exit", "market_entry") - 1.0),
        "sector_excess": gross - F.col("cost_return") - (F.try_divide("sector_exit", "sector_entry") - 1.0),
    })


def check_parsed_inputs(inputs: DataFrame, sources: DataFrame, attempts: DataFrame) -> DataFrame:
    """Parsed inputs: known source and class, roles it holds, evidence captured by that same source.

    ``attempts(source_id, raw_sha256)`` is the capture log.
    """
    side = sources.select("source_id", F.lit(True).alias("_known"), F.col("roles").alias("_roles"), F.col("source_class").alias("_class"))
    owned = attempts.select("source_id", "raw_sha256", F.lit(True).alias("_owned")).distinct()
    return R.check(
        inputs.join(side, "source_id", "left").join(owned, ["source_id", "raw_sha256"], "left"),
        R.must("SOURCE_UNKNOWN", F.col("_known")),
        R.never("CONTEXT_CLASS_MISMATCH", F.col("_class") != F.col("source_class")),
        R.never("ROLE_NOT_HELD_BY_SOURCE", F.col("_known") & ~F.arrays_overlap("evidence_roles", "_roles")),
        R.must("EVIDENCE_NOT_OWNED_BY_SOURCE", F.col("_owned")),
    ).drop("_known", "_roles", "_class", "_owned")
