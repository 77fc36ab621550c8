"""Hash-chained logs: chain checks, seals, decision/outcome pairs, checkpoints.

A row finds its predecessor by joining on ``sequence - 1``, one row to one row,
so a single ledger holding most of the log is checked by all tasks alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.functions.digest import table_digest, text_digest
from tidegauge.operators.ordering import last_before

EVENT_TYPES = ("CREATE", "AMEND", "WITHDRAW", "EXPIRE", "IMPORTED")
LATER_TYPES = ("AMEND", "WITHDRAW", "EXPIRE")
ORIGIN_TYPES = ("CREATE", "IMPORTED")
HASHED_FIELDS = ("ledger_id", "event_seq", "event_type", "claim_id", "revision", "payload_hash", "previous_event_hash")


def event_hash(fields: Sequence[str] = HASHED_FIELDS) -> Column:
    return text_digest(*fields)


def verify_chain(log: DataFrame, hashed_fields: Sequence[str] = HASHED_FIELDS) -> DataFrame:
    """Sequence, previous hash, recomputed hashes, time order, revisions and supersession."""
    key, claim = ["ledger_id", "event_seq"], ["ledger_id", "claim_id", "revision"]
    counts = log.groupBy(*key).agg(F.count("*").alias("_n"))
    revisions = log.groupBy(*claim).agg(F.count("*").alias("_nr"))
    before = log.groupBy("ledger_id", (F.col("event_seq") + 1).alias("event_seq")).agg(
        F.min("event_hash").alias("_prev_hash"), F.max("recorded_at").alias("_prev_recorded")
    )
    earlier = log.groupBy("ledger_id", "claim_id", (F.col("revision") + 1).alias("revision")).agg(
        F.min("event_hash").alias("_prior_hash"), F.min("event_seq").alias("_prior_seq")
    )
    joined = (
        log.join(counts, key).join(revisions, claim).join(before, key, "left").join(earlier, claim, "left")
    )
    first = F.col("event_seq") == 1
    kind = F.col("event_type")
    return R.check(
        joined,
        R.never("SEQUENCE", (F.col("_n") > 1) | (F.col("event_seq") < 1) | (~first & F.col("_prev_hash").isNull())),
        R.never("PREVIOUS_HASH", ~F.col("previous_event_hash").eqNullSafe(F.when(~first, F.col("_prev_hash")))),
        R.never("TIME_ORDER", (F.col("recorded_at") < F.col("issued_at")) | (F.col("effective_at") < F.col("issued_at"))
                | (F.col("recorded_at") < F.col("_prev_recorded"))),
        R.never("PAYLOAD_HASH", F.col("payload_hash") != F.sha2("payload", 256)),
        R.never("EVENT_HASH", F.col("event_hash") != event_hash(hashed_fields)),
        R.must("EVENT_TYPE", kind.isin(*EVENT_TYPES)),
        R.never("REVISION", (F.col("_nr") > 1) | (F.col("revision") < 1)
                | ((F.col("revision") > 1) & ~F.coalesce(F.col("_prior_seq") < F.col("event_seq"), F.lit(False)))),
        R.never("SUPERSEDES", kind.isin(*LATER_TYPES)
                & ~F.coalesce(F.col("supersedes_event_hash") == F.col("_prior_hash"), F.lit(False))),
        R.never("BACKDATED_LATER_EVENT", kind.isin(*LATER_TYPES) & (F.col("effective_at") < F.col("recorded_at"))),
        R.never("DUPLICATE_ORIGIN", kind.isin(*ORIGIN_TYPES) & (F.col("revision") > 1)),
    ).drop("_n", "_nr", "_prev_hash", "_prev_recorded", "_prior_hash", "_prior_seq")


def seal(log: DataFrame, content: Sequence[str] = ()) -> DataFrame:
    """Per ledger: count, first and last hash, last time, digest of the ``content`` columns (all of them by default)."""
    ends = log.groupBy("ledger_id").agg(
        F.count("*").alias("event_count"),
        F.min_by("event_hash", "event_seq").alias("first_event_hash"),
        F.max_by("event_hash", "event_seq").alias("last_event_hash"),
        F.max_by("recorded_at", "event_seq").alias("last_event_recorded_at"),
    )
    digest = table_digest(log, content or None, group=["ledger_id"]).select("ledger_id", F.col("table_sha256").alias("content_sha256"))
    return ends.join(digest, "ledger_id")


def verify_seals(log: DataFrame, seals: DataFrame) -> DataFrame:
    """Stored seals against the log as it is now, one code per differing field."""
    fields = ("event_count", "first_event_hash", "last_event_hash", "last_event_recorded_at", "content_sha256")
    now = seal(log).select("ledger_id", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = seals.withColumn("_sealed", F.lit(True)).join(now, "ledger_id", "full_outer")
    return R.check(
        joined,
        R.never("MISSING_SEAL", F.col("_sealed").isNull()),
        *[R.never(f"SEAL_{f.upper()}", F.col("_sealed") & ~F.col(f).eqNullSafe(F.col(f"_{f}"))) for f in fields],
    ).drop("_sealed", *[f"_{f}" for f in fields])


def pair_outcomes(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each outcome ties to exactly one decision and to times after its issue and record."""
    d = decisions.groupBy("decision_id").agg(
        F.count("*").alias("_d"), F.max("issued_at").alias("_issued"), F.max("recorded_at").alias("_recorded"),
        F.max("outcome_due_at").alias("_due"),
    )
    o = outcomes.groupBy("decision_id").agg(F.count("*").alias("_o"))
    return R.check(
        outcomes.join(d, "decision_id", "left").join(o, "decision_id"),
        R.never("OUTCOME_WITHOUT_DECISION", F.col("_d").isNull()),
        R.never("DECISION_NOT_UNIQUE", F.col("_d") > 1),
        R.never("OUTCOME_NOT_UNIQUE", F.col("_o") > 1),
        R.never("OUTCOME_BEFORE_DECISION", F.col("outcome_at") <= F.greatest("_issued", "_recorded")),
        R.never("OUTCOME_BEFORE_DUE", F.col("outcome_at") < F.col("_due")),
    ).drop("_d", "_issued", "_recorded", "_due", "_o")


def check_checkpoints(log: DataFrame) -> DataFrame:
    """Append-only run log: times never fall in append order, each (run, step) once."""
    repeated = log.groupBy("run_id", "step").agg(F.count("*").alias("_n"))
    seen = last_before(log.join(repeated, ["run_id", "step"]), ["seq"], [], "updated_at", "_before")
    return R.check(
        seen,
        R.never("CHECKPOINT_TIME_NOT_MONOTONIC", F.col("updated_at") < F.col("_before")),
        R.never("CHECKPOINT_STEP_EXISTS", F.col("_n") > 1),
    ).drop("_n", "_before")


def latest_checkpoint(log: DataFrame) -> DataFrame:
    rest = [c for c in log.columns if c != "run_id"]
    return log.groupBy("run_id").agg(F.max_by(F.struct(*rest), "seq").alias("c")).select("run_id", "c.*")
