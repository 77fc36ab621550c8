"""Language of captured texts by compression.

Every language gets a zstandard raw-content dictionary of sample text. A text is reduced to its letters and compressed
with each of them in independent blocks, so that the dictionary counts and not what came earlier in a long text. The
language whose dictionary gives the fewest bytes is chosen, and the choice is rejected when the runner-up comes too
close.

The dictionaries are the only thing fitted, from a bounded sample: at most ``sample_events`` labelled events per
language, and at most ``DICTIONARY_BYTES`` of their text. Prediction reads every text whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.schemas import schema

SAMPLE_EVENTS = 96
EVENT_BYTES = 4_096
DICTIONARY_BYTES = 98_304
BLOCK_BYTES = 2_048
LEVEL = 9
MIN_MARGIN = 0.002
TELLING_BYTES = 200
UNDETERMINED = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The words of a text in lower case, without digits, signs or white space but one blank between words."""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def fit(labelled: DataFrame, sample_events: int = SAMPLE_EVENTS) -> dict[str, bytes]:
    """Dictionary text per language from ``labelled(event_id, raw_text, language)``.

    Rows with a null language, a null text or no letter teach nothing. Per language the ``sample_events`` texts
    smallest by hash are read, each up to ``EVENT_BYTES``: a bounded sample whatever the input. Repeated rows and ties
    of the hash are resolved by the event id, then by the text. The languages come in order of their labelled events,
    most first. No usable row: an empty dictionary set.
    """
    usable = labelled.where(F.col("language").isNotNull() & F.col("raw_text").rlike(r"\p{L}"))
    order = Window.partitionBy("language").orderBy("hashed", "event_id", "raw_text")
    # Only texts of some length are worth a place; shorter ones fill up where there are no others.
    ranked = usable.select(
        "language", "event_id", F.substring("raw_text", 1, EVENT_BYTES).alias("raw_text"),
        F.struct((F.length("raw_text") < 200).alias("short"), F.xxhash64("event_id", "raw_text").alias("h")).alias("hashed"))
    rows = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_events).select("language", "rank", "raw_text").collect()
    frequent = [r.language for r in usable.groupBy("language").count().orderBy(F.desc("count"), "language").collect()]
    texts: dict[str, bytes] = dict.fromkeys(frequent, b"")
    for row in sorted(rows, key=lambda r: (r.language, -r.rank)):
        texts[row.language] = (texts[row.language] + b" " + letters(row.raw_text))[-DICTIONARY_BYTES:]
    return texts


def _compressors(dictionaries: dict[str, bytes]) -> list:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=BLOCK_BYTES, dict_size=DICTIONARY_BYTES, write_content_size=0, write_dict_id=0, write_checksum=0)
    made = []
    for text in dictionaries.values():
        content = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=params)
        made.append(zstandard.ZstdCompressor(dict_data=content, compression_params=params))
    return made


def sizes(raw: bytes, compressors: list) -> list[int]:
    """Compressed bytes of the whole text's letters under each dictionary, block by block."""
    blocks = [raw[at:at + BLOCK_BYTES] for at in range(0, len(raw), BLOCK_BYTES)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def _predict(batches: Iterator[pa.RecordBatch], dictionaries: dict[str, bytes], min_margin: float) -> Iterator[pa.RecordBatch]:
    names = list(dictionaries)
    compressors = _compressors(dictionaries)
    for batch in batches:
        languages, scores, rejected = [], [], []
        for text, has_letter in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not has_letter or not names:
                languages.append(UNDETERMINED)
                scores.append(0.0)
                rejected.append(True)
                continue
            raw = letters(text)
            found = sorted(zip(sizes(raw, compressors), range(len(names))))
            margin = 1.0 if len(found) == 1 else 1 - found[0][0] / max(1, found[1][0])
            languages.append(names[found[0][1]])
            scores.append(margin)
            rejected.append(margin < min_margin and len(raw) >= TELLING_BYTES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(languages, pa.string()), pa.array(np.array(scores, np.float64)), pa.array(rejected, pa.bool_()), *batch.columns[2:]],
            names=["predicted_language", "margin", "rejected", *batch.schema.names[2:]])


def predict(events: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """Language of every row of ``events(event_id, raw_text, ...)``; only the text is looked at.

    Returns ``predicted_language`` (``und`` for a null text or one without a letter), ``margin`` (0 to 1: the share of
    the runner-up's bytes that the chosen dictionary saves), ``rejected`` (undetermined, or a margin below
    ``min_margin`` on at least ``TELLING_BYTES`` bytes of letters; shorter texts compress too alike to be refused for
    it) and ``record``, the input row as a struct, so that no column name can clash. Ties go to the language with the
    most labelled events. With one language every text with a letter is that language, margin 1.
    """
    wide = events.select("raw_text", F.coalesce(F.col("raw_text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"), F.struct("*").alias("record"))
    return wide.mapInArrow(
        partial(_predict, dictionaries=dictionaries, min_margin=min_margin),
        schema("predicted_language string, margin double, rejected boolean", ("record", wide.schema["record"].dataType)))
