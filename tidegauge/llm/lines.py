"""Line de-duplication of captured texts: which lines of each source event stay.

A capture repeats banners, disclaimers and navigation that other captures carry too. Lines are compared by key; a
frequent key stays in one event only, the one with the largest ``event_id``. The result is a compressed bitmap per
text, not the text.

1. Each text is cut into lines in the task that reads it; a row per distinct key carries all its positions there.
2. The rows are range-partitioned by (key hash, event id) and sorted within partitions, largest event first, so a key
   held by a third of all events spans as many partitions as it needs.
3. A stream over each partition numbers the events of a key. From the third on they lose the line, whatever other
   partitions hold. Only the first two events of the first and last key of a partition stay open; they are settled
   from one small row per partition and key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.schemas import schema
from tidegauge.session import materialise

BLANKS = b" \t\n\x0b\x0c\r"
KEY = ("key_high", "key_low")


def line_key(line: bytes) -> bytes:
    """The line without surrounding white space, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def _occurrences(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        rows, keys, positions = [], [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            found: dict[bytes, list[int]] = {}
            for position, line in enumerate((text or b"").split(b"\n")):
                if len(line) >= min_chars:
                    key = line_key(line)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                        found.setdefault(digest(key), []).append(position)
            rows.extend([row] * len(found))
            keys.extend(found)
            positions.extend(found.values())
        halves = np.frombuffer(b"".join(keys), dtype=">i8").astype(np.int64).reshape(-1, 2)
        index = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(index), batch.column(1).take(index),
             pa.array(positions, pa.list_(pa.int32()))],
            names=[*KEY, "event_id", "body", "positions"])


class _Stream:
    """Numbers the events of each key in one sorted partition and tells which rows go."""

    def __init__(self, min_events: int):
        self.min_events = min_events
        self.key: tuple | None = None
        self.events = 0  # of the present key, so far
        self.last_event = None
        self.top_event = None
        self.first_group = True
        self.held: list[tuple] = []  # rows of the events below min_events, not decided yet
        self.out: list[tuple] = []

    def row(self, key: tuple, event_id, body: int, positions) -> None:
        if key != self.key:
            self.close(last=False)
            self.key, self.events, self.held, self.top_event = key, 0, [], event_id
        if not self.events or event_id != self.last_event:
            self.events, self.last_event = self.events + 1, event_id
        if self.events >= self.min_events:
            self.out.append((event_id, body, positions, None, None, None, 0))
        else:
            self.held.append((event_id, body, positions))

    def close(self, last: bool) -> None:
        if self.key is None:
            return
        if self.first_group or last:  # may go on in another partition
            self.out += [(e, b, p, *self.key, None, 1) for e, b, p in self.held]
            self.out.append((self.top_event, None, None, *self.key, self.events, 2))
        elif self.events >= self.min_events:
            self.out += [(e, b, p, None, None, None, 0) for e, b, p in self.held if e != self.top_event]
        self.first_group = False


def _first_occurrences(batches: Iterator[pa.RecordBatch], min_events: int) -> Iterator[pa.RecordBatch]:
    stream = _Stream(min_events)
    kind = None

    def drained() -> pa.RecordBatch:
        columns = list(zip(*stream.out)) or [[]] * 7
        stream.out = []
        types = (kind, pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=["event_id", "body", "positions", *KEY, "n_events", "kind"])

    for batch in batches:
        kind = batch.schema.field("event_id").type
        high, low = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        # A key that stands alone inside a batch needs no row of its own: skip those outright.
        same = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
        keep = np.ones(len(high), bool)
        if len(high) > 2:
            keep[1:-1] = same[1:] | same[:-1]
        picked = batch.filter(pa.array(keep))
        for record in zip(picked.column(0).to_pylist(), picked.column(1).to_pylist(), *(picked.column(i).to_pylist() for i in (2, 3, 4))):
            stream.row(record[:2], *record[2:])
        yield drained()
    if kind is not None:
        stream.close(last=True)
        yield drained()


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            keep = np.ones(n, bool)
            for positions in gone or ():
                keep[positions] = False
            dropped.append(int(n - keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())],
            names=["event_id", "body", "n_lines", "n_dropped", "keep_bitmap"])


def body_of(raw_text: Column) -> Column:
    """Tells apart texts that share an event id; a null text counts as an empty one."""
    return F.xxhash64(F.coalesce(raw_text, F.lit("")))


def keep_bitmaps(events: DataFrame, min_chars: int = 20, min_events: int = 3) -> DataFrame:
    """Which lines of ``events(event_id, raw_text, ...)`` stay.

    A line's key is the line without surrounding ASCII white space, A-Z lower-cased. A key of at least ``min_chars``
    code points that at least ``min_events`` events hold loses all its lines except those in the largest event.

    Returns one row per distinct (event_id, raw_text): ``event_id, body, n_lines, n_dropped, keep_bitmap``, where
    ``body`` is :func:`body_of` the text and the bitmap holds a bit per line, first line first, packed and
    zlib-compressed. A null or empty text has one empty line, which stays. Rows that repeat an event id are one
    event: they share its decisions. A null event id is an event of its own, below all others. Columns other than
    the two named are ignored. An empty table gives an empty result.
    """
    event_id = ("event_id", events.schema["event_id"].dataType)
    texts = events.select("event_id", body_of(F.col("raw_text")).alias("body"), F.col("raw_text").cast("binary").alias("raw"))
    occurrences = materialise(texts.mapInArrow(
        partial(_occurrences, min_chars=min_chars),
        schema("key_high long, key_low long", event_id, "body long, positions array<int>")))
    order = [*KEY, F.desc_nulls_last("event_id")]
    streamed = materialise(
        occurrences.repartitionByRange(*order).sortWithinPartitions(*order, "body", F.element_at("positions", 1))
        .mapInArrow(partial(_first_occurrences, min_events=min_events),
                    schema(event_id, "body long, positions array<int>, key_high long, key_low long, n_events long, kind int")))
    settled = streamed.where("kind = 2").groupBy(*KEY).agg(
        F.sum("n_events").alias("total"), F.max("event_id").alias("top"))
    open_rows = (
        streamed.where("kind = 1").select(*KEY, "event_id", "body", "positions").join(settled, list(KEY))
        .where((F.col("total") >= min_events) & ~F.col("event_id").eqNullSafe(F.col("top"))).select("event_id", "body", "positions"))
    gone = (
        streamed.where("kind = 0").select("event_id", "body", "positions").unionByName(open_rows)
        .groupBy("event_id", "body").agg(F.collect_list("positions").alias("gone")))
    bodies = events.select(
        "event_id", body_of(F.col("raw_text")).alias("body"),
        F.size(F.split(F.coalesce("raw_text", F.lit("")), "\n", -1)).cast("long").alias("n_lines")).distinct()
    joined = bodies.alias("l").join(
        gone.alias("r"), F.col("l.event_id").eqNullSafe(F.col("r.event_id")) & (F.col("l.body") == F.col("r.body")), "left"
    ).select("l.event_id", "l.body", "n_lines", "gone")
    return joined.mapInArrow(_bitmaps, schema(event_id, "body long, n_lines long, n_dropped long, keep_bitmap binary"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for raw, n, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
            if packed is None:
                texts.append(None)
                continue
            keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n)
            texts.append(b"\n".join(line for line, stays in zip((raw or b"").split(b"\n"), keep) if stays))
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.binary()), *(batch.column(i) for i in range(3, batch.num_columns))], names=["kept", *batch.schema.names[3:]])


def apply_bitmaps(events: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``events`` with each text reduced to the lines its bitmap keeps.

    Returns ``kept_text, n_lines, n_dropped, record``; ``record`` is the input row as a struct, so that no column name
    can clash. A null text comes back empty.
    """
    record = F.struct("*")
    wide = events.select("event_id", body_of(F.col("raw_text")).alias("body"), record.alias("record"))
    joined = wide.alias("l").join(
        bitmaps.alias("r"), F.col("l.event_id").eqNullSafe(F.col("r.event_id")) & (F.col("l.body") == F.col("r.body"))
    ).select(F.col("record.raw_text").cast("binary").alias("raw"), F.col("n_lines").cast("int").alias("n"), "keep_bitmap",
             "n_lines", "n_dropped", "record")
    done = joined.mapInArrow(_kept, schema("kept binary, n_lines long, n_dropped long", ("record", wide.schema["record"].dataType)))
    return done.select(F.col("kept").cast("string").alias("kept_text"), "n_lines", "n_dropped", "record")
