"""From raw documents to packed training windows, each stage an operator of ``tidegauge.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import copies, language, lines, packing, seeds, simhash
from tidegauge.llm.queries import byte_vocabulary
from tidegauge.session import materialise


def as_events(docs: DataFrame) -> DataFrame:
    """Documents as source events; the whole row travels in ``document``."""
    return docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("raw_text"), F.struct("*").alias("document"))


def same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression cannot tell go; the dictionaries come from a bounded sample of the labelled ones."""
    labelled = docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("raw_text"), F.col("lang").alias("language"))
    found = language.predict(as_events(docs), language.fit(labelled))
    return found.where(~F.col("rejected")).select("record.document.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay in the largest document only."""
    events = as_events(docs)
    kept = lines.apply_bitmaps(events, lines.keep_bitmaps(events.select("event_id", "raw_text"), min_chars=20, min_events=3))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return kept.select("kept_text", "record.document.*").select(
        *((new[f.name].cast(f.dataType) if f.name in new else F.col(f"`{f.name}`")).alias(f.name) for f in docs.schema))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    SimHash links and shared minima of five-word shingles propose the copies, their Jaccard of 0.8 or more decides.
    """
    events = as_events(docs)
    stays = simhash.representatives(copies.groups(events, shingle=5, percent=80))
    rows = events.withColumn("body", lines.body_of(F.col("raw_text"))).alias("d")
    kept = rows.join(stays.alias("s"), same("d.event_id", "s.event_id") & (F.col("d.body") == F.col("s.body")), "left_semi")
    # Rows that repeat an id and its text are one document.
    return kept.dropDuplicates(["event_id", "body"]).select("document.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark passage go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("holdout_id"), F.col("text").alias("raw_text"))
    events = as_events(docs)
    found = seeds.overlaps(events.select("event_id", "raw_text"), benchmark).select("event_id").distinct()
    return events.alias("d").join(found.alias("f"), same("d.event_id", "f.event_id"), "left_anti").select("document.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of 1024 ids, a row per piece of a document."""
    return packing.pack(as_events(docs), **byte_vocabulary(), end_id=0, window=1024).withColumnRenamed("event_id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack_windows),
]

#: SQL has no zstandard, XXH64 or tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
