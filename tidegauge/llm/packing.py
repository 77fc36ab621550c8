"""Training windows from source events: bounded-space online packing.

Each text becomes token ids and one end id, and is cut into full windows and a remainder. Full windows are finished at
once. A remainder goes to the open window it fits best; when it fits in none, the fullest open window is emitted and a
new one opened, so that a task never holds more than ``open_windows`` of them. The pieces still in open windows at the
end of the tasks, at most ``MERGE_TASKS * open_windows`` windows at a time, are merged by best fit, longest first.

The pieces are written once and then read; merging sorts its input, so that a lost executor changes nothing that was
already decided.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.schemas import schema
from tidegauge.session import materialise

WINDOW = 1024
OPEN_WINDOWS = 64
MERGE_TASKS = 64
ENCODE_CHARS = 1 << 20
# Fixed value: how the byte-level vocabulary splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(tokenizer: str, ranks: str | None):
    """A function from texts to id lists.

    With ``ranks`` (a ranks file of the same vocabulary) the merges run in a faster library; the special strings that
    the tokenizer file knows become their ids there too, wherever they stand in a text.
    """
    if ranks is None:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(tokenizer)
        return lambda texts: [e.ids for e in loaded.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    with open(tokenizer, encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file).get("added_tokens") or ()}
    with open(ranks, "rb") as file:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens=special)
    return lambda texts: [encoding.encode(t, allowed_special="all") for t in texts]


class _Windows:
    """At most ``limit`` open windows; best fit, emit the fullest when none fits."""

    def __init__(self, window: int, limit: int, name):
        self.window, self.limit, self.name = window, limit, name
        self.free: list[int] = []
        self.content: list[list] = []

    def put(self, length: int, item) -> Iterator[tuple]:
        """Places one item; yields (sequence, offset, item, length) of a window that is emitted for it."""
        fits = [(free, i) for i, free in enumerate(self.free) if free >= length]
        if fits:
            free, at = min(fits)
            self.content[at].append((item, length))
            self.free[at] -= length
            if not self.free[at]:
                yield from self._emit(at)
            return
        if len(self.free) >= self.limit:
            yield from self._emit(min(range(len(self.free)), key=self.free.__getitem__))
        self.free.append(self.window - length)
        self.content.append([(item, length)])

    def _emit(self, at: int) -> Iterator[tuple]:
        sequence, offset = self.name(), 0
        for item, length in self.content[at]:
            yield sequence, offset, item, length
            offset += length
        del self.free[at], self.content[at]

    def rest(self) -> Iterator[tuple[int, list]]:
        return ((i, content) for i, content in enumerate(self.content))

    def close(self) -> Iterator[tuple]:
        while self.free:
            yield from self._emit(0)


def _place(
    batches: Iterator[pa.RecordBatch], tokenizer: str, ranks: str | None, end_id: int, window: int, open_windows: int,
) -> Iterator[pa.RecordBatch]:
    encode = _encoder(tokenizer, ranks)
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    made = 0

    def name() -> int:
        nonlocal made
        made += 1
        return task << 32 | made

    windows = _Windows(window, open_windows, name)
    kind = None
    out: list[tuple] = []

    def drained() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 10
        out.clear()
        types = (kind, *[pa.int64()] * 9)
        names = ("event_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "open", "place")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))

    def placed(found) -> None:
        out.extend((*piece, sequence, offset, task, None, None) for sequence, offset, piece, _ in found)

    for batch in batches:
        kind = batch.schema.field(1).type
        texts, events = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop] or "") <= ENCODE_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            for event_id, found in zip(events[at:stop], encode([t or "" for t in texts[at:stop]])):
                ids = np.array([*found, end_id], dtype="<u4")
                for start in range(0, len(ids), window):
                    part = ids[start:start + window]
                    piece = (event_id, start, len(part), zlib.crc32(part), len(ids))
                    if len(part) == window:
                        out.append((*piece, name(), 0, task, None, None))
                    else:
                        placed(windows.put(len(part), piece))
            at = stop
        yield drained()
    if kind is not None:
        for number, content in windows.rest():
            out.extend((*piece, None, None, task, number, place) for place, (piece, _) in enumerate(content))
        yield drained()


def _merge(group: int, table: pa.Table, window: int) -> pa.Table:
    """The pieces of the open windows of some tasks, longest first, each where it fits best."""
    rows = table.sort_by([("length", "descending"), ("task", "ascending"), ("open", "ascending"), ("place", "ascending")])
    lengths = rows.column("length").to_numpy()
    free = np.full(len(lengths), window, np.int64)  # every piece could need a window of its own
    number, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for row, length in enumerate(lengths):
        left = free[:used] - length
        fits = np.flatnonzero(left >= 0)
        at = fits[left[fits].argmin()] if len(fits) else used
        used = max(used, at + 1)
        number[row], offset[row] = at, window - free[at]
        free[at] -= length
    sequence = -((group << 32) + number + 1)
    wanted = rows.select(["event_id", "start", "length", "ids_crc32", "doc_tokens"])
    return wanted.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack(
    events: DataFrame, tokenizer: str, ranks: str | None = None, end_id: int = 0, window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """Windows of at most ``window`` ids from ``events(event_id, raw_text, ...)``.

    ``tokenizer`` is a tokenizer file that every worker can read, ``ranks`` a ranks file of the same byte-level
    vocabulary, given to have the same ids faster. A text is its ids, special tokens not added, and ``end_id``; a null
    or empty text is the end id alone. Every id is in exactly one piece.

    Returns one row per piece: ``event_id, start`` (ids of its event before it), ``length, ids_crc32`` (of the ids as
    little-endian unsigned 32-bit), ``doc_tokens`` (ids of the event, end id included), ``sequence_id`` (unique; below
    zero for merged windows) and ``offset``, gapless from 0 in each sequence. Repeated rows are packed as often as they
    occur, null event ids included; other columns are ignored; an empty table gives an empty result.
    """
    event_id = ("event_id", events.schema["event_id"].dataType)
    pieces = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = materialise(events.select("raw_text", "event_id").mapInArrow(
        partial(_place, tokenizer=tokenizer, ranks=ranks, end_id=end_id, window=window, open_windows=open_windows),
        schema(event_id, pieces, "task long, open long, place long")))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return _merge(key[0].as_py(), table, window)

    still_open = placed.where("open IS NOT NULL")
    merged = still_open.withColumn("tasks", F.floor(F.col("task") / MERGE_TASKS)).groupBy("tasks").applyInArrow(merge, schema(event_id, pieces))
    return placed.where("open IS NULL").drop("task", "open", "place").unionByName(merged)
