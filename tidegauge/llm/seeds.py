"""Benchmark decontamination: texts that overlap the sealed holdout, word substitutions tolerated.

Spaced-seed hashing. A mask such as ``111011`` is laid over every position of a token sequence; the tokens under its
ones are hashed, those under its zeros are ignored. Equal hashes of an event and a holdout text are hits; the tokens
around the hits of one alignment are then compared for real.

With the masks ``11111`` and ``111011`` every alignment of twelve tokens of which at most two differ has a hit, wherever
the two are (the tests try all placements), so the result is exact and not a sample of the overlaps.

DataFrame functions only. The hashes of all events are never shuffled as long as the distinct holdout hashes stay within
``MAX_BROADCAST`` (8 bytes each, counted before the hint); beyond it the same semi-join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.lines import body_of
from tidegauge.session import broadcast_if_small, materialise

MASKS = ("11111", "111011")
MIN_OVERLAP = 12
SIMILARITY = 0.8
MAX_BROADCAST = 2_000_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _seeds(words: Column, masks: tuple[str, ...]) -> Column:
    """Hashes of all placements of all masks, mask after mask: ``size - span + 1`` of each."""

    def placements(w: Column, number: int) -> Column:
        span, ones = len(masks[number]), [i for i, c in enumerate(masks[number]) if c == "1"]
        at = F.when(F.size(w) >= span, F.sequence(F.lit(0), F.size(w) - span)).otherwise(F.expr("array()").cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.lit(number), *(F.get(w, i + o) for o in ones)))

    # Bound to a variable, so that the word hashes are made once and not once per placement.
    hashed = F.array(F.transform(words, lambda t: F.xxhash64(t)))
    return F.flatten(F.transform(hashed, lambda w: F.concat(*(placements(w, n) for n in range(len(masks))))))


def _placed(index: Column, n_tokens: Column, masks: tuple[str, ...]) -> Column:
    """Token position of the placement at ``index`` of :func:`_seeds`."""
    position, before = index, F.lit(0)
    for mask in masks[:-1]:
        before = before + F.greatest(n_tokens - len(mask) + 1, F.lit(0))
        position = F.when(index >= before, index - before).otherwise(position)
    return position


def overlaps(
    events: DataFrame, holdout: DataFrame, min_overlap: int = MIN_OVERLAP, similarity: float = SIMILARITY, masks: tuple[str, ...] = MASKS,
) -> DataFrame:
    """Overlaps of ``events(event_id, raw_text, ...)`` with ``holdout(holdout_id, raw_text, ...)``.

    A holdout text and an event overlap when, in some alignment without gaps, ``min_overlap`` successive tokens of the
    holdout text have at least ``similarity`` equal tokens. A holdout text of fewer tokens must occur whole and
    unchanged; one of fewer tokens than the shortest mask (five), but at least one, must be the whole event.

    Returns one row per overlapping pair: ``event_id, holdout_id, window_tokens`` (the length compared),
    ``equal_tokens`` (in the best window) and ``similarity``. Rows that repeat an id are united: the best window of any
    counts. Null ids are kept as an id of their own. Null and empty texts overlap nothing, other columns are ignored,
    and an empty table on either side gives an empty result.
    """
    everything = holdout.select("holdout_id", tokens(F.col("raw_text")).alias("own")).where(F.size("own") > 0).distinct()
    everything = materialise(everything.withColumn("text_key", F.xxhash64("holdout_id", "own")))
    own, short = (everything.where(rule) for rule in (F.size("own") >= min(map(len, masks)), F.size("own") < min(map(len, masks))))
    held = own.select("text_key", F.size("own").alias("n"), _seeds(F.col("own"), masks).alias("seeds"))
    seeds = materialise(
        held.select("text_key", "n", F.posexplode("seeds").alias("index", "seed"))
        .select("text_key", "seed", _placed(F.col("index"), F.col("n"), masks).alias("own_at")))

    texts = events.select("event_id", body_of(F.col("raw_text")).alias("body"), "raw_text")
    words = texts.select("event_id", "body", tokens(F.col("raw_text")).alias("words"))
    # The token array must not pass through the generator, which would repeat it in every row.
    hashed = words.select("event_id", "body", F.size("words").alias("n"), _seeds(F.col("words"), masks).alias("seeds"))
    placed = hashed.select("event_id", "body", "n", F.posexplode("seeds").alias("index", "seed"))
    met = placed.join(broadcast_if_small(seeds.select("seed").distinct(), MAX_BROADCAST), "seed", "left_semi")
    hits = met.select("event_id", "body", "seed", _placed(F.col("index"), F.col("n"), masks).alias("at"))
    reach = max(map(len, masks)) + min_overlap
    aligned = hits.join(seeds, "seed").groupBy("event_id", "body", "text_key", (F.col("at") - F.col("own_at")).alias("shift")).agg(
        F.min("own_at").alias("first"), F.max("own_at").alias("last"))
    # One row per text and holdout text: both token arrays stand there once, whatever the number of alignments.
    pairs = materialise(aligned.groupBy("event_id", "body", "text_key").agg(F.collect_list(F.struct("shift", "first", "last")).alias("places")))
    found = pairs.alias("a").join(
        texts.distinct().alias("t"), F.col("a.event_id").eqNullSafe(F.col("t.event_id")) & (F.col("a.body") == F.col("t.body"))
    ).select("a.event_id", "a.body", "text_key", "places", tokens(F.col("raw_text")).alias("words")).join(own, "text_key")

    def compared(place: Column) -> Column:
        low, high = F.greatest(place["first"] - reach, F.lit(0)), F.least(place["last"] + reach, F.size("own") - 1)
        at = lambda i: i + place["shift"]
        return F.struct(low.alias("low"), F.transform(F.sequence(low, high), lambda i: F.coalesce(
            (at(i) >= 0) & (F.get("words", F.greatest(at(i), F.lit(0))) == F.get("own", i)), F.lit(False))).alias("equal"))

    size = F.least(F.lit(min_overlap), F.size("own")).alias("window_tokens")
    # Alignments that agree in the same places are one: a run of one token has very many of them.
    united = found.select("event_id", "body", "holdout_id", "text_key", size, F.explode(F.transform("places", compared)).alias("p")).select(
        "event_id", "body", "holdout_id", "text_key", "window_tokens", "p.low", "p.equal").distinct()
    rows = united.withColumn("shift", F.xxhash64("low", "equal")).select(
        "event_id", "body", "holdout_id", "text_key", "shift", "window_tokens", F.posexplode("equal").alias("at", "equal"))
    window = Window.partitionBy("event_id", "body", "text_key", "shift").orderBy("at").rowsBetween(1 - min_overlap, 0)
    need = F.when(F.col("window_tokens") < min_overlap, F.col("window_tokens")).otherwise(F.ceil(F.lit(similarity) * min_overlap - 1e-9))
    best = (
        rows.withColumn("equal_tokens", F.sum(F.coalesce(F.col("equal"), F.lit(False)).cast("int")).over(window))
        .where(F.col("equal_tokens") >= need)
        .groupBy("event_id", "holdout_id").agg(F.max(F.struct(
            (F.col("equal_tokens") / F.col("window_tokens")).alias("similarity"), "window_tokens", "equal_tokens")).alias("best")))
    whole = words.select("event_id", F.col("words").alias("own")).where(F.size("own").between(1, min(map(len, masks)) - 1)).distinct().join(short, "own").select(
        "event_id", "holdout_id", F.size("own").alias("window_tokens"), F.size("own").cast("bigint").alias("equal_tokens"), F.lit(1.0).alias("similarity"))
    # Rows of one holdout id may be short and long: the best of both counts.
    longer = best.select("event_id", "holdout_id", "best.window_tokens", "best.equal_tokens", "best.similarity")
    return longer.unionByName(whole).groupBy("event_id", "holdout_id").agg(F.max(F.struct("similarity", "window_tokens", "equal_tokens")).alias("best")).select(
        "event_id", "holdout_id", "best.window_tokens", "best.equal_tokens", "best.similarity")
