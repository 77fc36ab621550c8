"""Post-open scan over a stream of observations.

The stream stores every line it reads, with its contract codes and the time slot of ``observed_at``; slots are settled
from what is stored. A scan is a slot, so its candidates do not depend on how the lines were spread over files or
micro-batches, and every line ends up in exactly one place: among the admitted, the refused, or the waiting ones of a
slot that has not ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidegauge.operators import scan
from tidegauge.session import materialise
from tidegauge.sources.files import parse_json_lines

SLOT_MINUTES = 5


def observation_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """JSON-lines observations arriving in a folder, contract-checked; ``options`` go to the file source."""
    return parse_json_lines(spark.readStream.format("text").options(**options).load(folder), scan.OBSERVATION_SCHEMA)


def slot_end(observed_at: Column, minutes: int = SLOT_MINUTES) -> Column:
    """End of the slot an instant falls in."""
    width = minutes * 60_000_000
    return F.timestamp_micros((F.floor(F.unix_micros(observed_at) / width) + 1) * width)


def store_observations(stream: DataFrame, out: str, checkpoint: str, minutes: int = SLOT_MINUTES) -> DataStreamWriter:
    """Stores every line below ``out``; a replayed batch replaces its own folder."""

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("scan_at", slot_end(F.col("observed_at"), minutes)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)


def settle(
    stored: DataFrame, identity: DataFrame, weights: dict[str, dict[str, float]], until: Column, last_batch: DataFrame | None = None, top_n: int = 25,
) -> dict[str, DataFrame]:
    """Candidates of all slots that ended by ``until``, and where every stored line went.

    ``identity(official_code)`` is the verified universe. ``last_batch(scan_id, batch)`` tells up to which batch a slot was
    settled before: lines that came later are refused as late and do not change its candidates. Returns ``candidates``,
    ``refused`` (with its reason), ``waiting`` and ``settled``, the next run's ``last_batch``.

    Of the lines of one security in one slot the first by time, then by text, counts; the rest are duplicates. Rows per
    security and slot are bounded by the feed, so a window numbers them.
    """
    listed = identity.select("official_code", F.lit(True).alias("_listed")).distinct()
    order = Window.partitionBy("scan_id", "official_code").orderBy("observed_at", "raw_line", "batch")
    rows = stored.withColumn("scan_id", F.col("scan_at").cast("string")).join(listed, "official_code", "left").withColumns({
        "identity_verified": F.col("identity_verified") & F.col("_listed").isNotNull(), "seq": F.row_number().over(order)}).drop("_listed")
    if last_batch is None:
        rows = rows.withColumn("_last", F.lit(None).cast("int"))
    else:
        rows = rows.join(last_batch.select("scan_id", F.col("batch").alias("_last")), "scan_id", "left")
    rows = materialise(rows)
    broken = F.size("issue_codes") > 0
    late = F.coalesce(F.col("batch") > F.col("_last"), F.lit(False))
    ended = F.coalesce(F.col("scan_at") <= until, F.lit(False))
    judged = materialise(scan.admit(rows.where(~broken & ~late & ended)))
    codes = F.concat(F.lit("CONTRACT:"), F.concat_ws("|", "issue_codes"))
    shown = ["scan_id", "official_code", "observed_at", "raw_line"]
    refused = (
        rows.where(broken).select(*shown, codes.alias("reason"))
        .unionByName(rows.where(~broken & late).select(*shown, F.lit("LATE_OBSERVATION").alias("reason")))
        .unionByName(judged.where("reason IS NOT NULL").select(*shown, "reason")))
    return {
        "candidates": scan.rank_candidates(judged.where("reason IS NULL"), weights, top_n),
        "admitted": judged.where("reason IS NULL").select(*shown),
        "refused": refused,
        "waiting": rows.where(~broken & ~late & ~ended).select(*shown),
        "settled": rows.where(~broken & ended & ~late).groupBy("scan_id").agg(F.max(F.coalesce("_last", "batch")).alias("batch")),
    }


def read_stored(spark: SparkSession, out: str) -> DataFrame:
    """All stored lines with the number of their batch."""
    return spark.read.parquet(out)
