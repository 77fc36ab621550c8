"""Events: contracts, canonical groups, windowed features, components, status folds.

A canonical group may hold any number of copies, so groups are described by
flags, minima and counts; their members stay a long table and no list of
copies is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.operators.graph import components
from tidegauge.session import materialise
from tidegauge.operators.pit import interval_join
from tidegauge.session import materialise

# Fixed values.
FACT_ROLES = ("OFFICIAL_FILING", "REGULATOR_OR_EXCHANGE", "ISSUER_PRIMARY")
CONTEXT_ROLES = ("NEWS_CONTEXT", "FINANCIAL_CONTEXT")
SOCIAL_ROLES = ("FORUM", "TELEGRAM", "SOCIAL")
SOURCE_ROLES = FACT_ROLES + CONTEXT_ROLES + SOCIAL_ROLES
RELATION_TYPES = ("STANDALONE", "ORIGINAL", "SUPPLEMENTARY", "CORRECTIVE", "REPUBLISHED")
DEPENDENT_RELATIONS = ("SUPPLEMENTARY", "CORRECTIVE", "REPUBLISHED")
POSITIVE_WORDS = ("POSITIVE", "UP", "BULLISH")
NEGATIVE_WORDS = ("NEGATIVE", "DOWN", "BEARISH")
STATUS_VALUES = ("TRADING", "SUSPENDED", "DELISTED")
TRANSITIONS = {
    ("TRADING", "SUSPEND"): "SUSPENDED", ("SUSPENDED", "RESUME"): "TRADING", ("TRADING", "DELIST"): "DELISTED",
    ("SUSPENDED", "DELIST"): "DELISTED", ("DELISTED", "RELIST"): "TRADING",
}


def check_events(events: DataFrame) -> DataFrame:
    """Source-event contract: roles, relation, novelty and the order of its four times."""
    return R.check(
        events,
        R.must("EVENT_IDENTITY_REQUIRED", R.present("event_id") & R.present("code") & R.present("source_id")),
        R.must("SOURCE_ROLE_INVALID", R.in_set("source_role", SOURCE_ROLES)),
        R.must("RELATION_TYPE_INVALID", R.in_set("relation_type", RELATION_TYPES)),
        R.never("DEPENDENT_WITHOUT_ORIGINAL",
                R.in_set("relation_type", DEPENDENT_RELATIONS) & F.col("original_event_id").isNull()),
        R.must("NOVELTY_OUT_OF_RANGE", R.finite("novelty", 0, 1)),
        R.must("PUBLISHED_AFTER_AVAILABLE", F.col("published_at") <= F.col("first_available_at")),
        R.must("AVAILABLE_AFTER_CAPTURED", F.col("first_available_at") <= F.col("captured_at")),
        R.must("CONTENT_HASH_FORM", R.is_sha256("content_hash")),
    )


def direction_value(direction: Column) -> Column:
    text = F.upper(direction)
    return F.when(text.isin(*POSITIVE_WORDS), 1.0).when(text.isin(*NEGATIVE_WORDS), -1.0).otherwise(0.0)


def relation_issues(events: DataFrame) -> DataFrame:
    """Dependent events whose original is absent or belongs to another security."""
    parents = events.select(F.col("event_id").alias("original_event_id"), F.col("code").alias("_parent_code"))
    joined = events.where("original_event_id IS NOT NULL").join(parents, "original_event_id", "left")
    return R.issues(
        R.check(
            joined,
            R.never("MISSING_ORIGINAL_EVENT", F.col("_parent_code").isNull()),
            R.never("RELATION_CROSSES_SECURITIES", F.col("_parent_code") != F.col("code")),
        ),
        "event_relations", "event_id",
    )


def with_canonical_key(events: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """The original's id, else the own id when others refer to it, else the content hash.

    ``within`` limits references to one window, e.g. one decision.
    """
    within = list(within)
    referenced = (
        events.where("original_event_id IS NOT NULL")
        .select(*within, F.col("original_event_id").alias("event_id")).distinct().withColumn("_ref", F.lit(True))
    )
    return events.join(referenced, [*within, "event_id"], "left").withColumn(
        "canonical_id",
        F.coalesce(
            F.col("original_event_id").cast("string"),
            F.when(F.col("_ref"), F.col("event_id").cast("string")),
            F.col("content_hash"),
        ),
    ).drop("_ref")


def _role_flag(roles: Sequence[str]) -> Column:
    return F.bool_or(F.col("source_role").isin(*roles))


def canonical_groups(keyed: DataFrame, group: Sequence[str] = ("code",)) -> DataFrame:
    """One row per canonical event; the earliest available member speaks for the group."""
    first = F.struct("first_available_at", "event_id")
    return keyed.groupBy(*group, "canonical_id").agg(
        F.min_by("event_type", first).alias("event_type"),
        F.min_by("direction", first).alias("direction"),
        F.min_by("novelty", first).alias("novelty"),
        F.min("event_at").alias("event_at"),
        F.min("published_at").alias("first_published_at"),
        F.min("first_available_at").alias("first_available_at"),
        F.max("captured_at").alias("last_captured_at"),
        F.count("*").alias("diffusion_count"),
        F.count_distinct("source_id").alias("source_diversity"),
        _role_flag(FACT_ROLES).alias("official_fact_seen"),
        _role_flag(CONTEXT_ROLES).alias("context_seen"),
        _role_flag(SOCIAL_ROLES).alias("social_seen"),
    )


def canonicalise(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical events and the member table ``(code, canonical_id, event_id, evidence_hash)``."""
    keyed = with_canonical_key(events)
    members = keyed.select("code", "canonical_id", "event_id", "source_id", "evidence_hash")
    return canonical_groups(keyed), members


def event_features(decisions: DataFrame, events: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Windowed event features per decision, one wide row.

    ``decisions(decision_id, code, decision_at)``. An event meets only the
    decisions whose 30 days contain it, so the join grows with events x
    decisions per month and code. Values are NULL without any 30-day event,
    unless ``coverage(decision_id, evidence_hash)`` proves that the window was
    searched: then nothing found is an observed zero. ``evidence_count`` unites
    the hashes of the events and of the coverage.
    """
    cols = ["event_id", "source_id", "source_role", "event_type", "direction", "novelty", "event_at", "published_at",
            "first_available_at", "captured_at", "content_hash", "original_event_id", "evidence_hash"]
    proof = decisions.select("decision_id", F.lit(None).cast("string").alias("evidence_hash")).limit(0) if coverage is None else coverage
    span = decisions.select(
        "decision_id", "code", "decision_at", (F.col("decision_at") - F.expr("INTERVAL 30 DAYS")).alias("_from"),
        F.col("decision_at").alias("_to"),
    )
    # Read for both windows, the diversity and the evidence: written once.
    pairs = materialise(interval_join(
        events.select("code", *cols), span, ["code"], "first_available_at", "_from", "_to", bucket_days=16
    ).drop("_from", "_to"))
    month = with_canonical_key(pairs, ["decision_id"])
    g30 = canonical_groups(month, ["decision_id"])
    week = pairs.where(F.col("first_available_at") >= F.col("decision_at") - F.expr("INTERVAL 7 DAYS"))
    g7 = canonical_groups(with_canonical_key(week, ["decision_id"]), ["decision_id"])
    signed = direction_value(F.col("direction")) * F.col("novelty")
    official = F.col("official_fact_seen")
    context = ~official & F.col("context_seen")
    f30 = g30.groupBy("decision_id").agg(
        F.coalesce(F.sum(F.when(official, signed)), F.lit(0.0)).alias("official_event_net_30d"),
        F.count_if(official).alias("official_event_count_30d"),
        F.coalesce(F.sum(F.when(context, signed)), F.lit(0.0)).alias("context_event_net_30d"),
    )
    diversity = pairs.groupBy("decision_id").agg(F.count_distinct("source_id").alias("source_diversity_30d"))
    social = F.col("social_seen")
    f7 = g7.groupBy("decision_id").agg(
        F.sum(F.when(social, signed)).alias("_net"), F.sum(F.when(social, F.col("diffusion_count"))).alias("_spread")
    )
    hashes = pairs.select("decision_id", "evidence_hash").unionByName(proof.select("decision_id", "evidence_hash")).where("evidence_hash IS NOT NULL")
    evidence = hashes.distinct().groupBy("decision_id").agg(F.count("*").alias("evidence_count"))
    searched = proof.select("decision_id", F.lit(True).alias("_searched")).distinct()
    observed = F.col("official_event_count_30d").isNotNull() | F.coalesce("_searched", F.lit(False))

    def value(name):
        return F.when(observed, F.coalesce(name, F.lit(0))).alias(name)

    return (
        decisions.join(f30, "decision_id", "left").join(diversity, "decision_id", "left").join(f7, "decision_id", "left")
        .join(evidence, "decision_id", "left").join(searched, "decision_id", "left")
        .select(
            *decisions.columns, value("official_event_net_30d"), value("official_event_count_30d"), value("context_event_net_30d"),
            F.when(observed, F.coalesce("_net", F.lit(0.0))).alias("social_event_net_7d"),
            F.when(observed, F.coalesce("_spread", F.lit(0))).alias("social_diffusion_7d"),
            value("source_diversity_30d"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
            F.when(observed, F.lit(1.0)).alias("event_window_observed_30d"),
            F.when(observed, "OBSERVED").otherwise("UNKNOWN_NOT_OBSERVED").alias("source_availability_state"),
        )
    )


FEATURE_NAMES = ("official_event_net_30d", "official_event_count_30d", "context_event_net_30d", "social_event_net_7d",
                 "social_diffusion_7d", "source_diversity_30d", "event_window_observed_30d")


def features_long(wide: DataFrame) -> DataFrame:
    return wide.select(
        "decision_id", "code", "source_availability_state", *[F.col(n).cast("double").alias(n) for n in FEATURE_NAMES]
    ).unpivot(["decision_id", "code", "source_availability_state"], list(FEATURE_NAMES), "feature_name", "feature_value")


def check_features(rows: DataFrame) -> DataFrame:
    """Feature-row contract: no label-like names, no look-ahead, unknown stays null."""
    key = ["decision_id", "code", "feature_name"]
    repeated = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    observed = F.col("source_availability_state") == "OBSERVED"
    return R.check(
        rows.join(repeated, key),
        R.never("FEATURE_KEY_DUPLICATE", F.col("_n") > 1),
        R.never("LABEL_LIKE_FEATURE_NAME",
                F.lower("feature_name").rlike("future_|forward_|outcome|target_hit|realized_|label_|t_plus_")),
        R.must("AVAILABILITY_STATE_INVALID", F.col("source_availability_state").isin("OBSERVED", "UNKNOWN_NOT_OBSERVED")),
        R.never("LOOK_AHEAD_AVAILABILITY", observed & (F.col("available_at") > F.col("decision_at"))),
        R.never("PUBLISHED_AFTER_AVAILABLE", observed & (F.col("published_at") > F.col("available_at"))),
        R.never("UNKNOWN_ENCODED_AS_VALUE", ~observed & F.col("feature_value").isNotNull()),
    ).drop("_n")


def sentiment(rows: DataFrame, key: str = "code") -> DataFrame:
    """Reliability-weighted tone per key; one row per origin, most reliable then earliest."""
    best = rows.groupBy(key, "origin_id").agg(
        F.max_by(F.struct("tone", "reliability", "author_id"), F.struct(F.col("reliability"), -F.col("seq"))).alias("b")
    ).select(key, "origin_id", "b.*")
    agg = best.groupBy(key).agg(
        F.count("*").alias("unique_origins"), F.count_distinct("author_id").alias("independent_authors"),
        F.sum(F.col("tone") * F.col("reliability")).alias("_num"), F.sum("reliability").alias("_den"),
    )
    tone = F.coalesce(F.try_divide(F.col("_num"), F.col("_den")), F.lit(0.0))
    enough = F.col("independent_authors") >= 2
    return agg.select(
        key, "unique_origins", "independent_authors", tone.alias("weighted_tone"),
        F.when(enough & (tone > 0.10), "POSITIVE").when(enough & (tone < -0.10), "NEGATIVE").otherwise("NEUTRAL").alias("direction"),
        F.when(enough, F.least(F.lit(1.0), F.abs(tone) / 0.75)).otherwise(0.0).alias("strength"),
        F.least(F.lit(0.5), F.col("independent_authors") / 10.0).alias("materiality"),
    )


def connected_components(links: DataFrame, node: str, link: str) -> DataFrame:
    """Smallest node id of the component of every node; nodes meet where they share a link.

    Links are hyper-edges ``(node, link)``: every node of a link gets one edge to the link's smallest node, so a link
    shared by a million nodes is a million rows, never pairs.
    """
    # Read four times: what the links are computed from is computed once.
    edges = materialise(links.select(node, link).distinct())
    least = edges.groupBy(link).agg(F.min(node).alias("_least"))
    stars = edges.join(least, link).where(F.col(node) != F.col("_least")).select(F.col(node).alias("a"), F.col("_least").alias("b"))
    labels = components(stars).withColumnRenamed("node", node)
    return edges.select(node).distinct().join(labels, node, "left").withColumn("label", F.coalesce("label", node))


def context_components(events: DataFrame) -> DataFrame:
    """Context events joined by repost, origin or content inside one scope."""
    scope = F.concat_ws("|", "scope", "scope_key")
    dedup = R.in_set("relation_type", ("STANDALONE", "ORIGINAL", "REPUBLISHED"))
    links = events.select(
        "event_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.concat(F.lit("e|"), F.col("event_id").cast("string")),
                    F.when(F.col("relation_type") == "REPUBLISHED", F.concat(F.lit("e|"), F.col("original_event_id").cast("string"))),
                    F.when(dedup, F.concat(F.lit("o|"), scope, F.lit("|"), F.col("origin_hash"))),
                    F.when(dedup, F.concat(F.lit("c|"), scope, F.lit("|"), F.col("content_hash"))),
                )
            )
        ).alias("link"),
    )
    return connected_components(links, "event_id", "link").withColumnRenamed("label", "component")


def context_groups(events: DataFrame, components: DataFrame) -> DataFrame:
    """Group status precedence, times and a stable id per component; conflicts become issue codes."""
    j = events.join(components, "event_id")
    first = F.struct("first_available_at", "event_id")
    semantics = F.struct("scope", "scope_key", "event_type", "direction")
    values = F.struct("materiality", "confidence", "novelty")

    def any_is(col, value):
        return F.bool_or(F.col(col) == value)

    g = j.groupBy("component").agg(
        F.min_by(F.struct("scope", "scope_key", "origin_hash", "content_hash", "event_type", "direction"), first).alias("f"),
        F.count("*").alias("diffusion_count"),
        F.count_distinct("source_group_id").alias("independent_source_groups"),
        F.min("first_available_at").alias("first_available_at"), F.max("captured_at").alias("last_captured_at"),
        any_is("factual_status", "CONTESTED").alias("fc"), any_is("factual_status", "OFFICIAL_CONFIRMED").alias("fo"),
        any_is("factual_status", "MULTISOURCE_CORROBORATED").alias("fm"),
        F.bool_and(F.col("factual_status") == "ROUTING_ONLY").alias("fr"),
        any_is("contradiction_status", "CONTESTED").alias("cc"), any_is("contradiction_status", "RESOLVED").alias("cr"),
        F.bool_and(F.col("contradiction_status") == "UNKNOWN").alias("cu"),
        any_is("correction_status", "SUPERSEDED").alias("ks"), any_is("correction_status", "CORRECTED").alias("kc"),
        (F.min(semantics) != F.max(semantics)).alias("semantic_conflict"),
        (F.min(values) != F.max(values)).alias("value_conflict"),
    )
    factual = (
        F.when(F.col("fc"), "CONTESTED").when(F.col("fo"), "OFFICIAL_CONFIRMED")
        .when((F.col("independent_source_groups") >= 2) & F.col("fm"), "MULTISOURCE_CORROBORATED")
        .when(F.col("fr"), "ROUTING_ONLY").otherwise("UNCONFIRMED")
    )
    return g.select(
        "component",
        F.concat(F.lit("ctx-"), F.substring(F.sha2(F.concat_ws("|", "f.scope", "f.scope_key", "f.origin_hash", "f.content_hash"), 256), 1, 24)).alias("canonical_event_id"),
        "f.scope", "f.scope_key", "f.event_type", "f.direction", "diffusion_count", "independent_source_groups",
        "first_available_at", "last_captured_at", factual.alias("factual_status"),
        F.when(F.col("fc") | F.col("cc"), "CONTESTED").when(F.col("cr"), "RESOLVED").when(F.col("cu"), "UNKNOWN")
        .otherwise("UNCONTESTED").alias("contradiction_status"),
        F.when(F.col("ks"), "SUPERSEDED").when(F.col("kc"), "CORRECTED").otherwise("CURRENT").alias("correction_status"),
        R.code_array(
            R.never("DUPLICATE_HAS_CONFLICTING_SEMANTICS", F.col("semantic_conflict")),
            R.never("DUPLICATE_HAS_CONFLICTING_VALUES", F.col("value_conflict")),
        ).alias("issue_codes"),
    )


def bind_exposures(exposures: DataFrame, events: DataFrame, universe: DataFrame) -> DataFrame:
    """Event-to-security edges checked against their event and the frozen universe.

    ``events`` has one row per canonical event with its bounded evidence array.
    """
    e = events.select(
        "canonical_event_id", F.lit(True).alias("_event"), F.col("scope").alias("_scope"), F.col("scope_key").alias("_key"),
        F.col("first_available_at").alias("_avail"), F.col("decision_at").alias("_decision"),
        F.col("evidence_hashes").alias("_evidence"), F.col("factual_status").alias("_factual"),
        F.col("correction_status").alias("_correction"),
    )
    u = universe.select("code").distinct().withColumn("_in", F.lit(True))
    joined = exposures.join(e, "canonical_event_id", "left").join(u, "code", "left")
    found = F.col("_event").isNotNull()
    return R.check(
        joined,
        R.must("EXPOSURE_OUTSIDE_DENOMINATOR", F.col("_in")),
        R.must("EXPOSURE_EVENT_UNRESOLVED", found),
        R.never("EXPOSURE_PREDATES_EVENT", F.col("available_at") < F.col("_avail")),
        R.never("EXPOSURE_CUTOFF_DIFFERS", found & ~F.col("decision_at").eqNullSafe(F.col("_decision"))),
        R.never("EXPOSURE_EVIDENCE_UNBOUND", found & ~F.arrays_overlap("evidence_hashes", "_evidence")),
        R.never("DIRECT_NAMED_SCOPE_CONFLICT", (F.col("exposure_type") == "DIRECT_NAMED") & (F.col("_scope") == "SECURITY")
                & (F.col("_key") != F.col("code"))),
        R.never("SECTOR_SCOPE_CONFLICT", (F.col("exposure_type") == "SECTOR_EXPOSURE") & (F.col("_scope") == "SECTOR")
                & (F.col("_key") != F.col("sector_code"))),
        R.never("SUPERSEDED_EVENT_NOT_ELIGIBLE", F.col("factor_eligible") & (F.col("_correction") == "SUPERSEDED")),
        R.never("UNCONFIRMED_EVENT_NOT_ELIGIBLE", F.col("factor_eligible") & F.col("_factual").isin("ROUTING_ONLY", "CONTESTED")),
    ).drop("_event", "_scope", "_key", "_avail", "_decision", "_evidence", "_factual", "_correction", "_in")


def status_intervals(opening: DataFrame, notices: DataFrame, window_from: Column, window_to: Column) -> tuple[DataFrame, DataFrame]:
    """Fold notices into status intervals per code; returns intervals and issues.

    A code with two notices on one date is refused first. What is left has at
    most one notice per civil day, so the folded array is bounded by the window.
    ``opening(code, status, current_status)``, ``notices(code, notice_id,
    effective_date, event_type)`` and optional ``raw_sha256`` on both, which is
    united per interval into ``evidence_hashes``. A code without a valid opening
    state has no intervals; a missing or invalid current state is an issue.
    """
    per_day = notices.groupBy("code", "effective_date").agg(F.count("*").alias("_n"))
    clashes = per_day.where("_n > 1").select("code").distinct()
    outside = notices.join(opening, "code", "left_anti").select("code").distinct()
    repeated = notices.groupBy("notice_id").agg(F.count("*").alias("_n"), F.min("code").alias("code")).where("_n > 1")
    unopened = opening.where(~F.coalesce(F.col("status").isin(*STATUS_VALUES), F.lit(False)))
    opening = opening.join(unopened.select("code"), "code", "left_anti")
    usable = notices.join(clashes, "code", "left_anti")
    text = F.lit(None).cast("string")
    hashed = F.col("raw_sha256") if "raw_sha256" in notices.columns else text
    opened = F.col("raw_sha256") if "raw_sha256" in opening.columns else text
    walked = usable.groupBy("code").agg(
        F.array_sort(F.collect_list(F.struct("effective_date", "notice_id", "event_type", hashed.alias("evidence")))).alias("walk")
    )
    table = F.create_map(*[x for (state, move), to in TRANSITIONS.items() for x in (F.lit(f"{state}:{move}"), F.lit(to))])
    base = opening.join(clashes, "code", "left_anti").join(walked, "code", "left").withColumn(
        "walk", F.coalesce("walk", F.array().cast("array<struct<effective_date:date,notice_id:string,event_type:string,evidence:string>>"))
    )
    seed = F.struct(
        F.col("status").alias("state"), window_from.alias("since"), F.lit("OPENING_STATE").alias("by"),
        F.array().cast("array<struct<status:string,effective_from:date,effective_to:date,start_notice_id:string,end_notice_id:string,evidence_hashes:array<string>>>")
        .alias("done"),
        F.array().cast("array<string>").alias("bad"), F.array_compact(F.array(opened)).alias("evidence"),
    )

    def step(acc, n):
        target = F.element_at(table, F.concat_ws(":", acc["state"], n["event_type"]))
        closed = F.struct(
            acc["state"].alias("status"), acc["since"].alias("effective_from"),
            F.date_sub(n["effective_date"], 1).alias("effective_to"), acc["by"].alias("start_notice_id"),
            n["notice_id"].alias("end_notice_id"),
            F.array_distinct(F.array_compact(F.array_append(acc["evidence"], n["evidence"]))).alias("evidence_hashes"),
        )
        valid = target.isNotNull()
        return F.struct(
            F.coalesce(target, acc["state"]).alias("state"),
            F.when(valid, n["effective_date"]).otherwise(acc["since"]).alias("since"),
            F.when(valid, n["notice_id"]).otherwise(acc["by"]).alias("by"),
            F.when(valid & (F.date_sub(n["effective_date"], 1) >= acc["since"]), F.array_append(acc["done"], closed))
            .otherwise(acc["done"]).alias("done"),
            F.when(valid, acc["bad"]).otherwise(
                F.array_append(acc["bad"], F.concat_ws(":", F.lit("INVALID_STATUS_TRANSITION"), acc["state"], n["event_type"], n["effective_date"].cast("string")))
            ).alias("bad"),
            F.when(valid, F.array_distinct(F.array_compact(F.array_append(acc["evidence"], n["evidence"])))).otherwise(acc["evidence"]).alias("evidence"),
        )

    folded = base.select("code", "current_status", F.aggregate("walk", seed, step).alias("a"))
    last = F.struct(
        F.col("a.state").alias("status"), F.col("a.since").alias("effective_from"), window_to.alias("effective_to"),
        F.col("a.by").alias("start_notice_id"), F.lit("CURRENT_SNAPSHOT").alias("end_notice_id"), F.col("a.evidence").alias("evidence_hashes"),
    )
    intervals = folded.select(
        "code",
        F.explode(F.when(F.col("a.since") <= window_to, F.array_append("a.done", last)).otherwise(F.col("a.done"))).alias("i"),
    ).select("code", "i.*")
    mismatch = F.when(
        ~F.coalesce(F.col("current_status").isin("TRADING", "SUSPENDED"), F.lit(False)), "MISSING_CURRENT_STATUS",
    ).when(
        F.col("a.state") != F.col("current_status"),
        F.concat_ws(":", F.lit("CURRENT_STATUS_RECONCILIATION"), F.col("a.state"), F.col("current_status")),
    )
    folded_issues = folded.select(
        "code", F.explode(F.array_compact(F.array_append("a.bad", mismatch))).alias("code_text")
    )

    def issue(df, text):
        return df.select(F.lit("status_intervals").alias("operator"), F.col("code").cast("string").alias("row_key"),
                         text.alias("code"), F.lit("ERROR").alias("severity"))

    problems = (
        issue(folded_issues, F.col("code_text"))
        .unionByName(issue(clashes, F.lit("MULTIPLE_STATUS_EVENTS_SAME_DATE")))
        .unionByName(issue(outside, F.lit("STATUS_NOTICE_OUTSIDE_IDENTITY")))
        .unionByName(issue(repeated, F.lit("DUPLICATE_STATUS_NOTICE_ID")))
        .unionByName(issue(unopened, F.when(F.col("status").isNull(), "MISSING_OPENING_STATE").otherwise("INVALID_OPENING_STATE")))
    )
    return intervals, problems
