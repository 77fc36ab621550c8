"""Post-open scan with its state inside the stream: one open slot per security, settled by event time.

``post_open`` stores every line and settles stored slots by a batch. Here the stream itself holds the lines of a slot as
state under (slot, security), an event-time timer at the slot's end decides them, and the state is dropped with it. The
watermark runs on the slot's end, so a line is late exactly if its slot ended by the watermark, whatever else arrives
with it. Every line ends in one place: settled with its reason (NULL: admitted), refused as broken or late, or waiting
in the state. Lines that agree on all fields are separate rows, the later ones duplicates; a line without a time, a code
or with any other contract issue is refused at once and moves neither state nor watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidegauge.operators import scan
from tidegauge.sources.files import parse_json_lines
from tidegauge.streaming.post_open import SLOT_MINUTES, slot_end

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINE = "observed_us long, raw_line string, reason string"
SETTLED = f"slot_ms long, official_code string, {LINE}"
LATE = "LATE_OBSERVATION"
DUPLICATE = "DUPLICATE_SECURITY_OBSERVATION"


def settled_row(slot_ms: int, code: str, observed_us: int, raw_line: str, reason: str | None) -> Row:
    return Row(slot_ms=slot_ms, official_code=code, observed_us=observed_us, raw_line=raw_line, reason=reason)


class SlotProcessor(StatefulProcessor):
    """Lines of one security in one slot; their number is bounded by the feed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", LINE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        slot_ms, code = key
        late = slot_ms <= timerValues.getCurrentWatermarkInMs()
        arrived = [(r["observed_us"], r["raw_line"], r["reason"]) for r in rows]
        if late:
            for observed_us, raw_line, _ in arrived:
                yield settled_row(slot_ms, code, observed_us, raw_line, LATE)
            return
        if not self.lines.exists():
            self.handle.registerTimer(slot_ms)
        self.lines.appendList(arrived)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        slot_ms, code = key
        taken = False
        for observed_us, raw_line, reason in sorted(self.lines.get(), key=lambda line: (line[0], line[1])):
            yield settled_row(slot_ms, code, observed_us, raw_line, DUPLICATE if taken else reason)
            taken = taken or reason is None
        self.lines.clear()

    def close(self) -> None:
        pass


def settle_slots(
    observations: DataFrame, identity: DataFrame, minutes: int = SLOT_MINUTES, delay: str = "10 minutes",
    maximum_age_minutes: int = scan.MAXIMUM_AGE_MINUTES, minimum_turnover: float = scan.MINIMUM_TURNOVER,
) -> DataFrame:
    """Stream of decided lines: ``scan_at, official_code, observed_at, raw_line, reason``.

    ``observations`` is a contract-checked stream (``post_open.observation_stream``), ``identity(official_code)`` the
    verified universe. A slot is settled once a later slot's end lies ``delay`` past its own. Of the lines of a security
    in a slot the first admitted one by time, then by text, counts.
    """
    listed = identity.select("official_code", F.lit(True).alias("_listed")).distinct()
    broken = observations.where(F.size("issue_codes") > 0).select(
        slot_end(F.col("observed_at"), minutes).alias("scan_at"), "official_code", "observed_at", "raw_line",
        F.concat(F.lit("CONTRACT:"), F.concat_ws("|", "issue_codes")).alias("reason"))
    timed = (
        observations.where(F.size("issue_codes") == 0).withColumn("scan_at", slot_end(F.col("observed_at"), minutes))
        .withWatermark("scan_at", delay).join(listed, "official_code", "left")
        .withColumn("identity_verified", F.col("identity_verified") & F.col("_listed").isNotNull()))
    # The watermark column itself stays behind: with it, the operator would drop late lines instead of handing them over.
    lines = timed.select(
        F.unix_millis("scan_at").alias("slot_ms"), "official_code", F.unix_micros("observed_at").alias("observed_us"), "raw_line",
        scan.own_reason(F.col("scan_at"), maximum_age_minutes, minimum_turnover).alias("reason"))
    settled = lines.groupBy("slot_ms", "official_code").transformWithState(SlotProcessor(), SETTLED, "Append", "EventTime")
    return settled.select(
        F.timestamp_millis("slot_ms").alias("scan_at"), "official_code", F.timestamp_micros("observed_us").alias("observed_at"), "raw_line", "reason",
    ).unionByName(broken)


def run_available(decided: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Decides all that has arrived, appends it to parquet files below ``out`` and ends; a later run goes on from ``checkpoint``."""
    spark = decided.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STATE_STORE)
    try:  # the running query keeps the settings it was started with
        query = decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    return query


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Lines still held as state after the last run, with the reason they would have on their own."""
    state = spark.read.format("statestore").option("stateVarName", "lines").load(checkpoint)
    return state.select(
        F.timestamp_millis("key.slot_ms").alias("scan_at"), "key.official_code",
        F.timestamp_micros("list_element.observed_us").alias("observed_at"), "list_element.raw_line", "list_element.reason")


def candidates(decided: DataFrame, weights: dict[str, dict[str, float]], minutes: int = SLOT_MINUTES, top_n: int = 25) -> DataFrame:
    """Ranked candidates of the settled slots: admitted lines are read again from their text and scored."""
    admitted = parse_json_lines(decided.where("reason IS NULL"), scan.OBSERVATION_SCHEMA, "raw_line")
    return scan.rank_candidates(admitted.withColumn("scan_id", slot_end(F.col("observed_at"), minutes).cast("string")), weights, top_n)
