"""Point-in-time joins: calendars, bitemporal membership, intervals, sessions.

Interval joins equi-join on the key plus a calendar bucket, so a hot key is
spread over its buckets and no key needs a nested loop. Windows here run only
over civil days, whose number the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.session import broadcast_if_small

# Fixed values.
LISTED_STATUSES = ("ACTIVE", "LISTED", "TRADING", "SUSPENDED", "HALTED")
SESSION_STATUSES = ("TRADING", "SUSPENDED", "HALTED")
WINDOW_TAGS = (("CONTEXT_120D", 120 * 24), ("ACTIVE_EVENT_30D", 30 * 24), ("COMMUNITY_SENTIMENT_7D", 7 * 24),
               ("FRESH_CATALYST_72H", 72))
NEXT_SESSION_LIMIT_DAYS = 370
_EPOCH = "DATE '1970-01-01'"


def active_on(day: Column, start: str | Column, end: str | Column) -> Column:
    """Closed interval; a NULL end is open."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return (start <= day) & (end.isNull() | (day <= end))


def _bucket(day: Column, days: int) -> Column:
    return F.floor(F.datediff(day, F.expr(_EPOCH)) / F.lit(days))


def interval_join(
    probes: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    how: str = "inner",
    bucket_days: int = 64,
) -> DataFrame:
    """Join each probe to the intervals of its key that contain ``at``.

    Intervals are clipped to the probes' own day range and repeated once per
    calendar bucket they touch; the residual test keeps the exact rows.
    """
    span = probes.agg(F.min(F.to_date(at)).alias("lo"), F.max(F.to_date(at)).alias("hi")).first()
    if span["lo"] is None:
        lo = hi = F.lit(date(1970, 1, 1))
    else:
        lo, hi = F.lit(span["lo"]), F.lit(span["hi"])
    first = F.greatest(F.to_date(start), lo)
    last = F.least(F.coalesce(F.to_date(end), hi), hi)
    return _bucketed(
        probes, intervals.where(first <= last), keys, at, start, end, how,
        _bucket(F.to_date(at), bucket_days), _bucket(first, bucket_days), _bucket(last, bucket_days),
    )


def range_join(
    probes: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str,
    how: str = "inner", bucket: int = 64,
) -> DataFrame:
    """``interval_join`` for whole numbers; both range ends must be known."""
    return _bucketed(
        probes, ranges.where(F.col(start) <= F.col(end)), keys, at, start, end, how,
        *[F.floor(F.col(c) / F.lit(bucket)) for c in (at, start, end)],
    )


def _bucketed(probes, intervals, keys, at, start, end, how, of_probe, from_bucket, to_bucket):
    spread = intervals.withColumn("_bucket", F.explode(F.sequence(from_bucket, to_bucket)))
    p, i = probes.withColumn("_bucket", of_probe).alias("p"), spread.alias("i")
    condition = F.col("p._bucket") == F.col("i._bucket")
    for k in keys:
        condition = condition & (F.col(f"p.{k}") == F.col(f"i.{k}"))
    condition = condition & active_on(F.col(f"p.{at}"), F.col(f"i.{start}"), F.col(f"i.{end}"))
    kept = [F.col(f"i.{c}") for c in intervals.columns if c not in keys]
    return p.join(i, condition, how).select(*[F.col(f"p.{c}") for c in probes.columns], *kept)


def steps(intervals: DataFrame, keys: Sequence[str], start: str, end: str, measures: dict[str, Column]) -> DataFrame:
    """Interval ends as signed steps ``(keys, day, measures)``; an open end takes no closing step."""
    names = list(measures)
    opened = [measures[n].cast("int").alias(n) for n in names]
    closed = [(-measures[n].cast("int")).alias(n) for n in names]
    moves = intervals.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(start).alias("day"), *opened),
                F.struct(F.date_add(end, 1).alias("day"), *closed),
            )
        ).alias("m"),
    )
    return moves.where("m.day IS NOT NULL").select(*keys, "m.day", *[f"m.{n}" for n in names])


def segments(moves: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Disjoint day ranges per key with the running level of every measure.

    Steps are summed per (key, day) before the window, so a window holds at most
    one row per civil day whatever the number of intervals.
    """
    by_day = moves.groupBy(*keys, "day").agg(*[F.sum(m).alias(m) for m in measures])
    ordered = Window.partitionBy(*keys).orderBy("day")
    run = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return by_day.select(
        *keys,
        F.col("day").alias("segment_from"),
        F.date_sub(F.lead("day").over(ordered), 1).alias("segment_to"),
        *[F.sum(m).over(run).alias(m) for m in measures],
    )


def members_on(
    identity: DataFrame, as_of: Column, known_at: Column, segment: str | None = "MAIN"
) -> DataFrame:
    """Tradable members valid on a day as it was known at an instant (pure filter)."""
    valid = active_on(as_of, "valid_from", "valid_to")
    known = (F.col("known_from") <= known_at) & (F.col("known_to").isNull() | (known_at <= F.col("known_to")))
    rows = identity.where(valid & known & F.col("tradable"))
    return rows if segment is None else rows.where(F.col("segment") == segment)


def members_by_day(days: DataFrame, identity: DataFrame, known_at: str = "known_at") -> DataFrame:
    """The same membership for a table of ``(as_of, known_at)`` probes."""
    joined = interval_join(days, identity.where("tradable"), [], "as_of", "valid_from", "valid_to")
    return joined.where(
        (F.col("known_from") <= F.col(known_at))
        & (F.col("known_to").isNull() | (F.col(known_at) <= F.col("known_to")))
    )


def count_members(
    probes: DataFrame, identity: DataFrame, measures: dict[str, Column] | None = None, known_at: str = "known_at"
) -> DataFrame:
    """Sums of ``measures`` (by default ``members``, a count) over the members of every distinct ``(as_of, known_at)`` probe.

    A sweep over valid and known time together, without a row per member and day: a membership is a rectangle, four
    signed corners, and a probe's sum is that of all corners below it on both axes. Corners are moved up to the next
    probe on each axis and summed there, so what is left is bounded by the probes; each is added to the even binary
    blocks of days it lies in, running sums go along known time inside a block, and a probe adds up the blocks its day
    is made of. Memberships without a start on either axis, or that end before they start, hold no probe; neither does a
    probe without a day or an instant.
    """
    measures = {"members": F.lit(1)} if measures is None else measures
    names = list(measures)
    points = probes.select("as_of", F.col(known_at).alias("_y")).where("as_of IS NOT NULL AND _y IS NOT NULL").distinct()
    span = points.agg(F.min("as_of"), F.max("as_of"), F.to_date(F.min("_y")), F.to_date(F.max("_y"))).first()
    lo, hi, first, last = span if span[0] is not None else [date(1970, 1, 1)] * 4
    size = (hi - lo).days + 1
    levels = F.sequence(F.lit(0), F.lit(size.bit_length()))

    # Per civil day of known time: its probe instants and the first one after it.
    ahead = Window.orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    instants = (
        probes.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("_day"))
        .join(points.groupBy(F.to_date("_y").alias("_day")).agg(F.sort_array(F.collect_set("_y")).alias("_within")), "_day", "left")
        .withColumn("_after", F.min(F.get("_within", F.lit(0))).over(ahead)))

    def corner(day: Column, instant: Column, sign: int) -> Column:
        return F.struct(
            F.when(day.isNotNull(), F.greatest(F.datediff(day, F.lit(lo)), F.lit(0))).alias("_x"), instant.alias("_at"),
            *[(sign * F.col(f"_m_{n}")).alias(n) for n in names])

    opened, closed = F.col("valid_from"), F.date_add("valid_to", 1)
    learned, dropped = F.col("known_from"), F.timestamp_micros(F.unix_micros("known_to") + 1)
    held = identity.where(
        F.col("tradable") & opened.isNotNull() & learned.isNotNull() & (F.col("valid_to").isNull() | (opened <= F.col("valid_to")))
        & (F.col("known_to").isNull() | (learned <= F.col("known_to"))))
    corners = held.select("valid_from", "valid_to", "known_from", "known_to", *[c.alias(f"_m_{n}") for n, c in measures.items()]).select(
        F.explode(F.array(corner(opened, learned, 1), corner(closed, learned, -1), corner(opened, dropped, -1), corner(closed, dropped, 1))).alias("_c")
    ).select("_c.*").where((F.col("_x") < size) & F.col("_at").isNotNull())
    later = F.get(F.filter("_within", lambda t: t >= F.col("_at")), F.lit(0))
    snapped = (
        corners.withColumn("_day", F.greatest(F.to_date("_at"), F.lit(first))).join(broadcast_if_small(instants), "_day")
        .withColumn("_y", F.coalesce(later, "_after")).where("_y IS NOT NULL")
        .groupBy("_x", "_y").agg(*[F.sum(n).alias(n) for n in names]))
    added = snapped.select("_y", *names, F.explode(levels).alias("_level"), "_x").select(
        "_level", F.expr("shiftright(_x, _level)").alias("_block"), "_y", *names).where("_block % 2 = 0")
    sums = added.groupBy("_level", "_block", "_y").agg(*[F.sum(n).alias(n) for n in names])
    asked = points.select("as_of", "_y", (F.datediff("as_of", F.lit(lo)) + 1).alias("_n"), F.explode(levels).alias("_level")).select(
        "as_of", "_y", "_level", (F.expr("shiftright(_n, _level)") - 1).alias("_block")).where("_block >= 0 AND _block % 2 = 0")
    run = Window.partitionBy("_level", "_block").orderBy("_y").rangeBetween(Window.unboundedPreceding, 0)
    both = sums.withColumn("as_of", F.lit(None).cast("date")).unionByName(asked.select("*", *[F.lit(None).cast("long").alias(n) for n in names]))
    below = both.select("as_of", "_y", *[F.sum(n).over(run).alias(n) for n in names]).where("as_of IS NOT NULL")
    return below.groupBy("as_of", F.col("_y").alias(known_at)).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def resolve_identity(
    probes: DataFrame, identity: DataFrame, probe_id: str, keys: Sequence[str] = ("code",), at: str = "as_of"
) -> DataFrame:
    """Exactly one identity per probe, else MISSING or AMBIGUOUS.

    ``identity`` carries ``security_id``; optional ``isin``/``ticker`` on the
    probe narrow the match. A probe without a key value cannot resolve.
    """
    side = identity
    for c in ("isin", "ticker"):
        if c in identity.columns:
            side = side.withColumnRenamed(c, f"_{c}")
    joined = interval_join(probes, side, keys, at, "valid_from", "valid_to", "left")
    for c in ("isin", "ticker"):
        if c in probes.columns and c in identity.columns:
            fits = F.col(c).isNull() | (F.upper(c) == F.col(f"_{c}"))
            joined = joined.withColumn("security_id", F.when(fits, F.col("security_id")))
    grouped = joined.groupBy(probe_id).agg(
        F.count("security_id").alias("matches"), F.min("security_id").alias("security_id")
    )
    return grouped.select(
        probe_id, "matches",
        F.when(F.col("matches") == 1, F.col("security_id")).alias("security_id"),
        F.when(F.col("matches") == 1, "MATCH").when(F.col("matches") == 0, "MISSING").otherwise("AMBIGUOUS").alias(
            "resolution"
        ),
    )


def eligible_segments(identity: DataFrame, status: DataFrame) -> DataFrame:
    """Day ranges with a listed identity and exactly one active, session-eligible status."""
    listed = identity.where(R.in_set("listing_status", LISTED_STATUSES))
    flags = {s: F.col("status") == s for s in SESSION_STATUSES}
    zero = F.lit(0)
    moves = steps(
        listed, ["code", "board"], "valid_from", "valid_to",
        {"identities": F.lit(1), "statuses": zero, **{s: zero for s in SESSION_STATUSES}},
    ).unionByName(
        steps(
            status, ["code", "board"], "effective_from", "effective_to",
            {"identities": zero, "statuses": F.lit(1), **flags},
        )
    )
    level = segments(moves, ["code", "board"], ["identities", "statuses", *SESSION_STATUSES])
    state = F.coalesce(*[F.when(F.col(s) == 1, F.lit(s)) for s in SESSION_STATUSES])
    return level.where("identities >= 1 AND statuses = 1").select(
        "code", "board", "segment_from", "segment_to", state.alias("status")
    ).where("status IS NOT NULL")


def eligible_denominator(calendar: DataFrame, identity: DataFrame, status: DataFrame) -> DataFrame:
    """(trade_date, code, board, status) for every eligible security and trading day.

    All joining happens on intervals; days are generated last, so the large
    output is never shuffled. The calendar broadcast is size-checked.
    """
    span = calendar.agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi")).first()
    lo, hi = F.lit(span["lo"]), F.lit(span["hi"])
    first = F.greatest("segment_from", lo)
    last = F.least(F.coalesce("segment_to", hi), hi)
    open_days = broadcast_if_small(calendar.where("is_trading_day").select("trade_date"))
    return (
        eligible_segments(identity, status).where(first <= last)
        .withColumn("trade_date", F.explode(F.sequence(first, last)))
        .join(open_days, "trade_date", "left_semi")
        .select("trade_date", "code", "board", "status")
    )


def overlapping_keys(
    intervals: DataFrame, keys: Sequence[str], start: str, end: str, distinct_by: Sequence[str] = ()
) -> DataFrame:
    """Keys under which two intervals cover one day, without pairing intervals.

    With ``distinct_by`` the intervals of one owner are merged first, so only
    different owners collide (the ISIN rule).
    """
    owners = intervals
    if distinct_by:
        by = [*keys, *distinct_by]
        level = segments(steps(intervals, by, start, end, {"active": F.lit(1)}), by, ["active"])
        # Touching covered segments of one owner count once: keep the 0/1 cover level.
        cover = level.select(
            *by, F.col("segment_from").alias(start), F.col("segment_to").alias(end), (F.col("active") > 0).alias("on")
        )
        owners = cover.where("on")
    level = segments(steps(owners, keys, start, end, {"active": F.lit(1)}), keys, ["active"])
    return level.where("active > 1").groupBy(*keys).agg(F.min("segment_from").alias("first_overlap_day"))


def build_calendar(
    spark: SparkSession,
    first: date,
    last: date,
    holidays: DataFrame,
    weekend: Sequence[int] = (6, 7),
    regimes: DataFrame | None = None,
) -> DataFrame:
    """One row per civil date; holiday beats weekend beats trading.

    ``holidays(trade_date, holiday_name)``; ``weekend`` uses Spark day numbers
    (1 = Sunday, so 6 and 7 are Friday and Saturday); ``regimes`` carries session
    times with ``regime_from``/``regime_to``.
    """
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("trade_date"))
    marked = spine.join(broadcast_if_small(holidays), "trade_date", "left")
    closed = (
        F.when(F.col("holiday_name").isNotNull(), "OFFICIAL_HOLIDAY")
        .when(F.dayofweek("trade_date").isin(*weekend), "WEEKEND")
    )
    calendar = marked.select(
        "trade_date", closed.isNull().alias("is_trading_day"), closed.alias("closed_reason"), "holiday_name"
    )
    if regimes is None:
        return calendar
    return calendar.join(
        broadcast_if_small(regimes),
        active_on(F.col("trade_date"), "regime_from", "regime_to") & F.col("is_trading_day"),
        "left",
    ).drop("regime_from", "regime_to")


def check_calendar(calendar: DataFrame, first: date, last: date) -> DataFrame:
    """Missing, extra and repeated civil dates and trading days without session times."""
    spine = calendar.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last))).alias("trade_date"), F.lit(True).alias("expected")
    )
    has_times = "session_close" in calendar.columns
    seen = calendar.groupBy("trade_date").agg(
        F.count("*").alias("n"),
        (F.bool_or(F.col("is_trading_day") & F.col("session_close").isNull()) if has_times else F.lit(False)).alias(
            "no_times"
        ),
    )
    joined = spine.join(seen, "trade_date", "full_outer")
    checked = R.check(
        joined,
        R.never("CALENDAR_MISSING_DATE", F.col("n").isNull()),
        R.never("CALENDAR_EXTRA_DATE", F.col("expected").isNull()),
        R.never("CALENDAR_DUPLICATE_DATE", F.col("n") > 1),
        R.never("TRADING_DAY_LACKS_SESSION_TIMES", F.col("no_times")),
    )
    return R.issues(checked, "calendar", "trade_date")


def next_sessions(calendar: DataFrame) -> DataFrame:
    """Each civil date with the first trading day after it, at most 370 days away."""
    following = Window.orderBy("trade_date").rowsBetween(1, Window.unboundedFollowing)
    after = F.min(F.when(F.col("is_trading_day"), F.col("trade_date"))).over(following)
    return calendar.select(
        "trade_date", F.when(F.datediff(after, F.col("trade_date")) <= NEXT_SESSION_LIMIT_DAYS, after).alias("next_session")
    )


def nth_eligible_session(
    decisions: DataFrame, calendar: DataFrame, status: DataFrame, horizon: str = "horizon_sessions"
) -> DataFrame:
    """The day of the n-th later session on which the security trades.

    Status intervals become disjoint segments with a running count of TRADING
    sessions and of sessions whose status is missing or ambiguous. A decision
    finds its segment, adds ``n`` to its own trading count and finds the segment
    holding that count: two bucketed range joins on the code, no day grid. A
    defect on the way makes an issue instead of a date. With ``decision_at`` on
    the decisions and ``session_close`` on the calendar, a decision before the
    close of its own session is refused; a civil date that the calendar lacks
    between decision and due day is an issue.
    """
    span = calendar.agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi")).first()
    lo, hi = F.lit(span["lo"]), F.lit(span["hi"])
    timed = "decision_at" in decisions.columns and "session_close" in calendar.columns
    close = F.col("session_close") if timed else F.lit(None).cast("timestamp")
    # One row per civil date, so the running counts are bounded by the calendar.
    spine = calendar.sparkSession.range(1).select(F.explode(F.sequence(lo, hi)).alias("trade_date"))
    so_far = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    numbered = spine.join(calendar, "trade_date", "left").select(
        F.col("trade_date").alias("_day"), F.coalesce("is_trading_day", F.lit(False)).alias("is_trading_day"), close.alias("_close"),
        F.sum(F.coalesce(F.col("is_trading_day").cast("int"), F.lit(0))).over(so_far).alias("_upto"),
        F.sum(F.col("is_trading_day").isNull().cast("int")).over(so_far).alias("_missing"),
    )
    upto = broadcast_if_small(numbered.select("_day", "_upto"))
    level = segments(
        steps(status, ["code"], "effective_from", "effective_to",
              {"active": F.lit(1), "trading": F.col("status") == "TRADING"}),
        ["code"], ["active", "trading"],
    )
    clipped = level.select(
        "code", F.greatest("segment_from", lo).alias("segment_from"),
        F.least(F.coalesce("segment_to", hi), hi).alias("segment_to"), "active", "trading",
    ).where("segment_from <= segment_to")
    sized = (
        clipped.join(upto, F.date_sub("segment_from", 1) == F.col("_day"), "left")
        .select("code", "segment_from", "segment_to", "active", "trading",
                (F.coalesce("_upto", F.lit(0)) + 1).alias("first_no"))
        .join(upto, F.col("segment_to") == F.col("_day"))
        .select("code", "segment_from", "segment_to", "first_no", F.col("_upto").alias("last_no"),
                ((F.col("active") == 1) & (F.col("trading") == 1)).alias("trades"), (F.col("active") != 1).alias("defect"))
        .withColumn("sessions", F.col("last_no") - F.col("first_no") + 1)
    )
    before = Window.partitionBy("code").orderBy("segment_from").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    walk = sized.select(
        "code", "segment_from", "segment_to", "first_no", "sessions", "trades",
        F.coalesce(F.sum(F.when(F.col("trades"), F.col("sessions")).otherwise(0)).over(before), zero).alias("traded_before"),
        F.coalesce(F.sum(F.when(F.col("defect"), F.col("sessions")).otherwise(0)).over(before), zero).alias("defects_before"),
        F.sum(F.when(F.col("defect"), F.col("sessions")).otherwise(0)).over(Window.partitionBy("code")).alias("defects_all"),
    )
    day_info = broadcast_if_small(numbered)
    placed = interval_join(
        decisions.join(day_info, F.col("decision_day") == F.col("_day"), "left").drop("_day"),
        walk, ["code"], "decision_day", "segment_from", "segment_to", "left",
    ).withColumn(
        "_target", F.col("traded_before") + F.col("_upto") - F.col("first_no") + 1 + F.col(horizon)
    ).drop("segment_from", "segment_to", "first_no", "sessions", "traded_before")
    goals = walk.where("trades AND sessions > 0").select(
        "code", (F.col("traded_before") + 1).alias("_lo"), (F.col("traded_before") + F.col("sessions")).alias("_hi"),
        F.col("first_no").alias("_goal_no"), F.col("defects_before").alias("_goal_defects"),
    )
    found = range_join(placed, goals, ["code"], "_target", "_lo", "_hi", "left").withColumn(
        "_due_no", F.col("_goal_no") + F.col("_target") - F.col("_lo")
    )
    index = broadcast_if_small(
        numbered.where("is_trading_day").select(
            F.col("_upto").alias("_due_no"), F.col("_day").alias("due_day"), F.col("_missing").alias("_due_missing"))
    )
    all_missing = numbered.agg(F.max("_missing").alias("n")).first()["n"] or 0
    joined = found.join(index, "_due_no", "left")
    early = F.col("decision_at") < F.col("_close") if timed else F.lit(False)
    unclosed = F.col("_close").isNull() if timed else F.lit(False)
    issue = (
        F.when(~F.coalesce("is_trading_day", F.lit(False)), "DECISION_NOT_ON_TRADING_SESSION")
        .when(unclosed, "DECISION_OFFICIAL_SESSION_CLOSE_INVALID").when(early, "DECISION_AT_PRECEDES_OFFICIAL_SESSION_CLOSE")
        .when(~F.coalesce("trades", F.lit(False)), "DECISION_SECURITY_STATUS_NOT_TRADING")
        .when(F.coalesce("_due_missing", F.lit(all_missing)) > F.col("_missing"), "OFFICIAL_TRADING_CALENDAR_MISSING_DATE")
        .when(F.coalesce("_goal_defects", "defects_all") > F.col("defects_before"), "SECURITY_STATUS_MISSING_OR_AMBIGUOUS")
        .when(F.col("due_day").isNull(), "SESSION_HORIZON_NOT_COVERED")
    )
    return joined.select(
        *[F.col(c) for c in decisions.columns],
        F.when(issue.isNull(), F.col("due_day")).alias("due_day"), issue.alias("issue_code"),
    )


def window_tags(available: Column, decision: Column) -> Column:
    """Inclusive lookback tags of an availability instant."""
    age = F.unix_micros(decision) - F.unix_micros(available)
    return F.array_compact(
        F.array(
            *[
                F.when((age >= 0) & (age <= F.lit(hours * 3_600_000_000)), F.lit(name))
                for name, hours in WINDOW_TAGS
            ]
        )
    )


def snapshot_status(identity: DataFrame, suspended: DataFrame, delisted: DataFrame, snapshot: Column) -> DataFrame:
    """Current status per listed code and conflicts with the suspended and delisted lists."""
    s = suspended.groupBy("code").agg(F.min("ticker").alias("s_ticker"))
    d = delisted.groupBy("code").agg(F.min("delisting_date").alias("delisting_date"))
    joined = identity.select("code", "ticker").join(s, "code", "left").join(d, "code", "left")
    present = F.col("s_ticker").isNotNull()
    return R.check(
        joined.select(
            "code", "ticker", "s_ticker", "delisting_date",
            F.when(present, "SUSPENDED").otherwise("TRADING").alias("status"),
            F.when(present, "PRESENT_IN_CURRENT_SUSPENDED_TABLE")
            .otherwise("ABSENT_FROM_COMPLETE_SUSPENDED_TABLE").alias("reason_code"),
            snapshot.alias("effective_from"),
        ),
        R.never("SUSPENDED_TICKER_CONFLICT", F.col("s_ticker") != F.col("ticker")),
        R.never("CURRENT_IDENTITY_APPEARS_DELISTED", F.col("delisting_date") <= snapshot),
    ).drop("s_ticker", "delisting_date")


def benchmark_asof(probes: DataFrame, registry: DataFrame, at: str = "as_of") -> DataFrame:
    """Benchmark uniquely active on a date; sector requests need a SECTOR scope."""
    joined = interval_join(probes, registry, ["benchmark_code"], at, "effective_from", "effective_to", "left")
    grouped = joined.groupBy(*probes.columns).agg(F.count("scope").alias("n"), F.min("scope").alias("scope"))
    wants_sector = F.col("sector").isNotNull() if "sector" in probes.columns else F.lit(False)
    return grouped.select(
        *probes.columns,
        F.when(F.col("n") == 1, F.col("scope")).alias("scope"),
        F.when(F.col("n") != 1, "BENCHMARK_NOT_UNIQUELY_ACTIVE")
        .when(wants_sector & (F.col("scope") != "SECTOR"), "SECTOR_BENCHMARK_REQUIRED").alias("issue_code"),
    )


def opportunity_scan(
    observations: DataFrame, identity: DataFrame, max_securities: int, at: str = "as_of"
) -> DataFrame:
    """Leads and rejects; the lead list is the first ``max_securities`` in arrival order."""
    resolved = resolve_identity(observations, identity, "seq", at=at)
    reason = (
        F.when(F.col("resolution") != "MATCH", "IDENTITY_NOT_UNIQUELY_RESOLVED")
        .when(F.col("evidence_class") != "OFFICIAL_VERIFICATION", "CONTEXT_ONLY_SOURCE")
    )
    judged = observations.join(resolved, "seq").withColumn("reason", reason)
    leads = judged.where("reason IS NULL").orderBy("seq").limit(max_securities).select("seq", F.lit(True).alias("_lead"))
    return judged.join(F.broadcast(leads) if max_securities <= 100_000 else leads, "seq", "left").select(
        *observations.columns, "security_id", "reason",
        F.when(F.col("reason").isNotNull(), "REJECTED").when(F.col("_lead"), "CANDIDATE_CONTEXT_ONLY").otherwise(
            "BEYOND_REQUEST_LIMIT"
        ).alias("status"),
    )


def market_snapshot(days: DataFrame, calendar: DataFrame, identity: DataFrame, registry: DataFrame) -> DataFrame:
    """Per as-of day: session flag, universe size, benchmark and blocked reasons."""
    sizes = count_members(days, identity).groupBy("as_of").agg(F.sum("members").alias("universe_size"))
    marks = benchmark_asof(days.select("as_of", "benchmark_code"), registry).select(
        "as_of", "benchmark_code", "scope"
    )
    flags = calendar.select(F.col("trade_date").alias("as_of"), "is_trading_day", "closed_reason")
    joined = (
        days.join(flags, "as_of", "left").join(sizes, "as_of", "left").join(marks, ["as_of", "benchmark_code"], "left")
        .withColumn("universe_size", F.coalesce("universe_size", F.lit(0)))
    )
    blocked = R.code_array(
        R.must("NON_TRADING_SESSION", F.col("is_trading_day")),
        R.never("EMPTY_OR_UNVERIFIED_UNIVERSE", F.col("universe_size") == 0),
        R.must("BENCHMARK_NOT_UNIQUELY_ACTIVE", F.col("scope").isNotNull()),
    )
    return joined.withColumn("blocked_reasons", blocked).withColumn(
        "status", F.when(F.size("blocked_reasons") > 0, "ABSTAIN").otherwise("READY_FOR_EVIDENCE")
    )
