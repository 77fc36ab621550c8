"""Exact removal of long byte strings that repeat across source events, on merged Burrows-Wheeler transforms.

A window is ``length`` consecutive bytes of one text. It goes when the same bytes start earlier: in a smaller event, or
before it in the same one.

1. Every window has a key, the least hash among its grams, so equal windows have equal keys wherever they stand.
   Neighbouring windows of one key form a fragment. Fragments of a key that occurs once hold nothing that repeats; of
   fragments with equal bytes the earliest stands for all, the others go whole.
2. What is left, different fragments of one key, is dealt over shards by key. The task that reads the texts sorts the
   suffixes of its own fragments and sends their Burrows-Wheeler transform.
3. The transforms of a shard are merged by refining their interleave, for the rows with a window before them: round by
   round each moves to the row of the suffix one byte longer, sorted by that byte. Rows that stay together for ``h``
   rounds share a prefix of ``h`` bytes; rows that are alone leave. What is together after ``length`` rounds are the
   repeated windows. No suffix is sorted again.
4. Positions come from walking each such row back to the head of its fragment. All but the earliest window of a group go.

Grams that a sample finds in very many texts count as larger than all others, so a common phrase is the key only of
windows it fills. That choice spreads the work; the result does not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tidegauge.llm.lines import body_of
from tidegauge.llm.schemas import schema
from tidegauge.session import materialise

SLAB = 1 << 20  # bytes of text hashed at once
RUN = 512  # windows of a fragment at most
BUCKET_BYTES = 16 << 20  # of text whose fragments meet in one group
SHARD_BYTES = 2 << 20  # of fragments in one merge
SAMPLE = 64  # one text in so many is searched for common grams
COMMON = 1000  # a gram in at least one of so many sampled texts, and eight of them, is common
COMMON_GRAMS = 1 << 16  # the most frequent ones, at most
_MASK = (1 << 22) - 1
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _gram_size(length: int) -> int:
    return 1 << max(0, (length // 2).bit_length() - 1) if length < 64 else 32


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on; ``size`` is a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    width = 1
    while width < size:
        h = (h[:-width] ^ (h[:-width] >> np.uint64(29))) * _MIX[1] + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    return h ^ (h >> np.uint64(29))


def _extreme(least: np.ufunc, h: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum over each ``width`` neighbours."""
    out, done, n = h, 1, len(h) - width + 1
    while 2 * done <= width:
        out = least(out[:-done], out[done:])
        done *= 2
    return least(out[:n], out[width - done:][:n])


def _fragments(data: np.ndarray, texts: list[tuple[int, int]], length: int, common: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """``(start, windows, key, twice)`` of the fragments of texts at the given spans of ``data``.

    ``twice`` tells that the key's gram stands more than once in the fragment, which may then repeat a window itself.
    """
    size = _gram_size(length)
    width = length - size + 1  # grams of a window
    inside = np.zeros(len(data) - length + 1, bool)
    for start, stop in texts:
        inside[start:max(start, stop - length + 1)] = True
    h = _grams(data, size) >> np.uint64(1)
    if common is not None:
        h |= common[(h & np.uint64(_MASK)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
    key = _extreme(np.minimum, h, width)
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (key[1:] != key[:-1])
    start = np.flatnonzero(first)
    stop = np.flatnonzero(inside & np.append(first[1:] | ~inside[1:], True)) + 1
    pieces = -(-(stop - start) // RUN)
    if len(start) and pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        stop = np.minimum(np.repeat(stop, pieces), np.repeat(start, pieces) + (nth + 1) * RUN)
        start = np.repeat(start, pieces) + nth * RUN
    # A gram is the key of some window if it equals the largest key among the windows that hold it.
    edge = np.zeros(width - 1, np.uint64)
    picked = np.flatnonzero(h == _extreme(np.maximum, np.concatenate([edge, np.where(inside, key, 0), edge]), width))
    low, high = np.searchsorted(picked, start), np.searchsorted(picked, stop + width - 1)
    owner = np.repeat(np.arange(len(start)), high - low)
    at = picked[np.arange(len(owner)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[owner]]
    key = key[start]
    return start, stop - start, key, np.bincount(owner[h[at] == key[owner]], minlength=len(start)) > 1


def _slabs(texts: pa.Array | pa.ChunkedArray, length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]]:
    """Bytes, spans of texts in them, and per span the row and the offset in its text; long texts in overlapping pieces."""
    held, spans, owners, size = [], [], [], 0
    for row, text in enumerate(texts):
        raw = text.as_py() or b""
        for offset in range(0, max(1, len(raw) - length + 1), SLAB):
            piece = raw[offset:offset + SLAB + length - 1]
            if len(piece) < length:
                continue
            held.append(piece)
            spans.append((size, size + len(piece)))
            owners.append((row, offset))
            size += len(piece)
            if size >= SLAB:
                yield np.frombuffer(b"".join(held), np.uint8), spans, owners
                held, spans, owners, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), spans, owners


def _common_grams(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Grams that several texts of a batch hold, with the number of these texts."""
    for batch in batches:
        found = []
        for data, spans, _ in _slabs(batch.column(2), length):
            h = _grams(data, _gram_size(length)) >> np.uint64(1)
            found += [np.unique(h[a:b - _gram_size(length) + 1]) for a, b in spans]
        grams, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        several = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(grams[several].astype(np.int64)), pa.array(counts[several].astype(np.int64))], names=["gram", "texts"])


def _table_of(grams: list[int]) -> np.ndarray | None:
    if not grams:
        return None
    table = np.zeros(_MASK + 1, bool)
    table[np.array(grams, np.int64) & _MASK] = True
    return table


def _sorted(table: pa.Table, *columns: str) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in columns], null_placement="at_start"))


def _repeats_row(table: pa.Table, *columns: str) -> np.ndarray:
    """Whether each row equals the one before it in all these columns."""
    same = np.zeros(table.num_rows, bool)
    if table.num_rows > 1:
        same[1:] = True
        for name in columns:
            column = table.column(name)
            a, b = column.slice(1), column.slice(0, table.num_rows - 1)
            equal = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.and_(pc.is_null(a), pc.is_null(b)), pc.equal(a, b))
            same[1:] &= equal.to_numpy(zero_copy_only=False).astype(bool)
    return same


def _cut(batches: Iterator[pa.RecordBatch], length: int, buckets: int, common: list[int]) -> Iterator[pa.RecordBatch]:
    """Fragments packed by bucket of their key. Equal fragments of one batch are met at once: its copies travel in any one bucket."""
    frequent = _table_of(common)
    for batch in batches:
        kind = batch.schema.field("event_id").type
        order = pc.sort_indices(pa.table({"e": batch.column(0), "b": batch.column(1)}), sort_keys=[("e", "ascending"), ("b", "ascending")], null_placement="at_start")
        texts = pa.table(batch.take(order).columns, names=["event_id", "body", "raw"])
        texts = texts.filter(pa.array(~_repeats_row(texts, "event_id", "body")))
        parts = []
        for data, spans, owners in _slabs(texts.column("raw"), length):
            start, windows, key, twice = _fragments(data, spans, length, frequent)
            view, digest = memoryview(data), xxhash.xxh3_64_intdigest
            content = np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), (start + windows + length - 1).tolist())), np.uint64, len(start))
            span = np.searchsorted([a for a, _ in spans], start, "right") - 1
            row, offset = np.array(owners, np.int64).T
            parts.append((key.view(np.int64), content.view(np.int64), row[span], start - np.array([a for a, _ in spans])[span] + offset[span], windows, twice))
        if not parts:
            continue
        key, content, row, start, windows, twice = map(np.concatenate, zip(*parts))
        # Texts are in the order of events, so the first of equal fragments is the earliest.
        by = np.lexsort((start, row, content, key))
        copy = np.zeros(len(by), bool)
        copy[1:] = (key[by][1:] == key[by][:-1]) & (content[by][1:] == content[by][:-1])
        bucket = ((key.view(np.uint64)[by] >> np.uint64(31)) % np.uint64(buckets)).astype(np.int32)
        bucket[copy] = -1
        pack = np.lexsort((start[by], row[by], bucket))
        by, bucket = by[pack], bucket[pack]
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        offsets = pa.array(np.append(edges, len(by)), pa.int32())
        rows, at = _distinct_rows(row[by], edges)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (
            key[by], content[by], at.astype(np.int32), start[by].astype(np.int32), windows[by].astype(np.int16), twice[by])]
        named = [pa.ListArray.from_arrays(pa.array(rows[1], pa.int32()), texts.column(i).combine_chunks().take(pa.array(rows[0]))) for i in (0, 1)]
        copies = bucket[edges] < 0
        anywhere = texts.column("body")[0].as_py() % buckets
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(copies, anywhere, bucket[edges]).astype(np.int32)), pa.array(copies), *[t.cast(pa.list_(k)) for t, k in zip(named, (kind, pa.int64()))], *lists],
            names=["bucket", "copies", "event_ids", "bodies", "keys", "contents", "texts", "starts", "windows", "twice"])


def _distinct_rows(row: np.ndarray, edges: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct values of each slice of ``row`` (sorted inside slices) with their offsets, and each entry's place among its slice's."""
    new = np.append(True, row[1:] != row[:-1])
    new[edges] = True
    number = np.cumsum(new) - 1
    return (row[new], np.append(number[edges], number[-1] + 1)), number - np.repeat(number[edges], np.diff(np.append(edges, len(row))))


def _unpacked(table: pa.Table) -> pa.Table:
    """Packed rows as one row per fragment."""
    sizes = pc.list_value_length(table.column("keys")).to_numpy()
    texts = pc.list_value_length(table.column("event_ids")).to_numpy()
    shift = np.repeat(np.cumsum(texts) - texts, sizes)

    def flat(name: str) -> pa.Array:
        return pc.list_flatten(table.column(name)).combine_chunks()

    text = pa.array(flat("texts").to_numpy() + shift)
    return pa.table({
        "key": flat("keys"), "content": flat("contents"), "event_id": flat("event_ids").take(text), "body": flat("bodies").take(text),
        "start": flat("starts"), "windows": flat("windows").cast(pa.int32()), "twice": flat("twice")})


_FOUND = ("event_id", "body", "start", "windows", "key")


def _met(table: pa.Table) -> pa.Table:
    """Of the fragments of one bucket: copies, with a null key, and those that have to be compared byte by byte."""
    known = _unpacked(table.filter(table.column("copies"))).select(_FOUND[:4])
    rows = _unpacked(table.filter(pc.invert(table.column("copies"))))
    key = rows.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    alike = key[order][1:] == key[order][:-1]
    often = np.zeros(len(key), bool)
    often[order] = np.append(alike, False) | np.append(False, alike)
    rows = _sorted(rows.filter(pa.array(often | rows.column("twice").to_numpy())), "key", "content", "event_id", "body", "start")
    rows = rows.filter(pa.array(~_repeats_row(rows, "key", "content", "event_id", "body", "start")))
    copy = _repeats_row(rows, "key", "content")
    classes = rows.filter(pa.array(~copy))
    same = _repeats_row(classes, "key")
    several = same | np.append(same[1:], False) | classes.column("twice").to_numpy()
    compared = classes.filter(pa.array(several)).select(_FOUND)
    gone = pa.concat_tables([known, rows.filter(pa.array(copy)).select(_FOUND[:4])])
    return pa.concat_tables([gone.append_column("key", pa.nulls(gone.num_rows, pa.int64())), compared])


def transform(fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of fragments, each ended by a terminator of its own, smaller than all bytes, in their order.

    Returns the byte before each suffix in sorted order, empty suffixes first, and per fragment the row of its whole self,
    where no byte comes before.
    """
    sizes = np.array([len(f) + 1 for f in fragments])
    ends = np.cumsum(sizes) - 1
    heads = ends - sizes + 1
    n = int(sizes.sum())
    symbols = np.frombuffer(b"\0".join(fragments) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[ends] = 0
    left = np.repeat(ends, sizes) - np.arange(n)  # bytes before the terminator
    packed = np.zeros(n, np.int64)
    for i in range(7):
        shifted = np.zeros(n, np.int64)
        shifted[:max(0, n - i)] = symbols[i:]
        shifted[left < i] = 0
        packed = (packed << 9) | shifted
    order = np.argsort(packed, kind="stable")
    # A prefix that reaches the terminator is told from its equals by its place.
    new = np.append(True, (packed[order][1:] != packed[order][:-1]) | (left[order][1:] < 7))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 7
    while True:
        alone = np.append(new[1:], True) & new
        if alone.all():
            break
        places = np.flatnonzero(~alone)
        at = order[places]
        by = np.lexsort((rank[at + depth], rank[at]))  # both have more than ``depth`` bytes left
        one, two = rank[at][by], rank[at + depth][by]
        order[places] = at[by]
        new[places[1:]] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        depth *= 2
    before = np.where(order > 0, symbols[np.maximum(order - 1, 0)] - 1, 0)
    rows = np.empty(n, np.int64)
    rows[order] = np.arange(n)
    before[rows[heads]] = 0
    return before.astype(np.uint8), rows[heads].astype(np.int32)


def _longer(before: np.ndarray, heads: np.ndarray, shift: int) -> np.ndarray:
    """For each row of a transform the row of the suffix one byte longer, ``shift`` added; -1 for whole fragments."""
    body = np.ones(len(before), bool)
    body[heads] = False
    rows = np.flatnonzero(body)
    out = np.full(len(before), -1, np.int32)
    out[rows[np.argsort(before[rows], kind="stable")]] = np.arange(len(rows), dtype=np.int32) + (len(heads) + shift)
    return out


def repeated_windows(transforms: list[tuple[np.ndarray, np.ndarray]], windows: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(group, fragment, position)`` of all windows that stand more than once in the merged transforms.

    ``windows`` gives the number of windows of each fragment. Fragments are numbered through all transforms in order.
    """
    sizes = [len(b) for b, _ in transforms]
    shifts = np.cumsum([0] + sizes[:-1])
    before = np.concatenate([b for b, _ in transforms])
    longer = np.concatenate([_longer(b, h, s) for (b, h), s in zip(transforms, shifts.tolist())])
    # Only suffixes with a window to their left can grow to one: from the ends of fragments as many steps as they have windows.
    at = np.concatenate([np.arange(len(h), dtype=np.int32) + s for (_, h), s in zip(transforms, shifts.astype(np.int32))])
    left, starts = np.concatenate(windows), []
    while len(at := at[left > 0]):
        starts.append(at)
        at, left = longer[at], left[left > 0] - 1
    rows = np.sort(np.concatenate(starts)) if starts else at  # the interleave: all suffixes share the empty prefix
    group = np.zeros(len(rows), np.int32)
    for _ in range(length):
        if not len(rows):
            break
        byte = before[rows]
        order = np.argsort(byte, kind="stable")  # inside a byte the earlier order holds
        byte, group, rows = byte[order], group[order], longer[rows[order]]
        new = np.empty(len(rows) + 1, bool)
        new[0] = new[-1] = True
        np.logical_or(byte[1:] != byte[:-1], group[1:] != group[:-1], out=new[1:-1])
        together = ~(new[:-1] & new[1:])
        group = np.cumsum(new[:-1], dtype=np.int32)[together]
        rows = rows[together]
    fragment = np.full(len(before), -1, np.int64)
    heads = np.concatenate([h + s for (_, h), s in zip(transforms, shifts)])
    fragment[heads] = np.arange(len(heads))
    position, walking, at = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
    while len(walking := walking[longer[at[walking]] >= 0]):
        at[walking] = longer[at[walking]]
        position[walking] += 1
    return group, fragment[at], position


def _transforms(batches: Iterator[pa.RecordBatch], length: int, shards: int) -> Iterator[pa.RecordBatch]:
    """One Burrows-Wheeler transform per batch and shard, with where its fragments stand."""
    for batch in batches:
        cut: dict[int, list] = {}
        for row, (raw, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            for w in wanted:
                cut.setdefault((w["key"] % (1 << 64) >> 17) % shards, []).append((raw[w["start"]:w["start"] + w["windows"] + length - 1], row, w["start"]))
        made = [(shard, *transform([f for f, _, _ in found]), [r for _, r, _ in found], [s for _, _, s in found], [len(f) - length + 1 for f, _, _ in found])
                for shard, found in cut.items()]
        kinds = [batch.schema.field(i).type for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.int32()), pa.array([m[1].tobytes() for m in made], pa.binary()), pa.array([m[2] for m in made], pa.list_(pa.int32())),
             *[pa.array([batch.column(i).take(pa.array(m[3])).to_pylist() for m in made], pa.list_(k)) for i, k in enumerate(kinds)],
             *[pa.array([m[i] for m in made], pa.list_(pa.int32())) for i in (4, 5)]],
            names=["shard", "transform", "heads", "event_ids", "bodies", "starts", "windows"])


def _merged(table: pa.Table, length: int) -> pa.Table:
    """Windows of one shard that stand earlier too, as runs ``(event_id, body, start, windows)``."""
    transforms = [(np.frombuffer(b, np.uint8), np.array(h, np.int64)) for b, h in zip(table.column("transform").to_pylist(), table.column("heads").to_pylist())]
    group, fragment, position = repeated_windows(transforms, [np.array(w) for w in table.column("windows").to_pylist()], length)

    def flat(name: str) -> pa.Array:
        return pc.list_flatten(table.column(name)).combine_chunks()

    at = pa.array(fragment)
    start = pa.array(flat("starts").to_numpy()[fragment] + position.astype(np.int32))
    rows = _sorted(pa.table({"group": group, "event_id": flat("event_ids").take(at), "body": flat("bodies").take(at), "start": start}), "group", "event_id", "body", "start")
    rows = rows.filter(pa.array(~_repeats_row(rows, "group", "event_id", "body", "start")))
    gone = _sorted(rows.filter(pa.array(_repeats_row(rows, "group"))), "event_id", "body", "start")
    place = gone.column("start").to_numpy()
    on = _repeats_row(gone, "event_id", "body") & np.append(False, np.diff(place) <= 1)[:len(place)]
    first = np.flatnonzero(~on)
    last = np.append(first[1:], len(place))[:len(first)] - 1
    return gone.take(pa.array(first)).select(["event_id", "body", "start"]).append_column("windows", pa.array((place[last] - place[first] + 1).astype(np.int32)))


def _cleaned(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept = [], []
        for raw, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw, runs = raw or b"", []
            for start, stop in sorted((g["start"], g["start"] + g["windows"] + length - 1) for g in gone or ()):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], stop)
                else:
                    runs.append([start, stop])
            edges = [0, *(x for run in runs for x in run), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"start": a, "stop": b} for a, b in runs])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(r or b"") for r in batch.column(1).to_pylist()], pa.int64()),
             pa.array([sum(s["stop"] - s["start"] for s in x) for x in spans], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            names=["event_id", "n_bytes", "n_removed", "removed_spans", "kept_bytes"])


def _same(left: str, right: str):
    return F.col(f"{left}.event_id").eqNullSafe(F.col(f"{right}.event_id")) & (F.col(f"{left}.body") == F.col(f"{right}.body"))


def remove(events: DataFrame, length: int = 100) -> DataFrame:
    """``events(event_id, raw_text, ...)`` without bytes that strings of ``length`` bytes starting earlier cover.

    Texts are their UTF-8 bytes, a null text is empty, and no string spans two texts. Earlier is a smaller event id, or the
    same text and a smaller start; overlaps count; strings are judged on the input, not on what is left. A null event id is
    below all others. Texts that share an event id are in the order of their hash; rows that repeat an event id and its
    text are one text and share its result.

    Returns one row per input row: ``event_id, n_bytes, n_removed, removed_spans``, the maximal removed runs as an array
    of (start, stop), stop exclusive, and ``kept_bytes``, the remaining bytes. Removed bytes may be part of a character,
    so the rest need not be UTF-8. Other columns are ignored; an empty table gives an empty result.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    spark, kind = events.sparkSession, events.schema["event_id"].dataType
    key = ("event_id", kind)
    texts = events.select("event_id", body_of(F.col("raw_text")).alias("body"), F.col("raw_text").cast("binary").alias("raw"))
    long = texts.where(F.length("raw") >= length)
    size = events.agg(F.sum(F.octet_length("raw_text"))).first()[0] or 0
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-size // BUCKET_BYTES))

    sample = long.where(F.pmod(F.xxhash64("event_id"), F.lit(SAMPLE)) == 0)
    found = sample.mapInArrow(partial(_common_grams, length=length), "gram long, texts long").groupBy("gram").agg(F.sum("texts").alias("texts"))
    enough = F.greatest(F.lit(8), F.lit(sample.count() // COMMON))
    common = [r.gram for r in found.where(F.col("texts") >= enough).orderBy(F.desc("texts"), "gram").limit(COMMON_GRAMS).collect()]

    packed = long.mapInArrow(partial(_cut, length=length, buckets=buckets, common=common), schema(
        "bucket int, copies boolean", ("event_ids", ArrayType(kind)), "bodies array<long>, keys array<long>, contents array<long>, texts array<int>, "
        "starts array<int>, windows array<smallint>, twice array<boolean>"))
    met = materialise(packed.groupBy("bucket").applyInArrow(_met, schema(key, "body long, start int, windows int, key long")))
    compared = met.where(F.col("key").isNotNull())
    bytes_compared = compared.agg(F.sum(F.col("windows") + length)).first()[0] or 0
    shards = max(least, -(-bytes_compared // SHARD_BYTES))
    wanted = compared.groupBy("event_id", "body").agg(F.collect_list(F.struct("start", "windows", "key")).alias("wanted"))
    sent = long.alias("l").join(wanted.alias("r"), _same("l", "r")).select("l.event_id", "l.body", "raw", "wanted").mapInArrow(
        partial(_transforms, length=length, shards=shards), schema(
            "shard int, transform binary, heads array<int>", ("event_ids", ArrayType(kind)), "bodies array<long>, starts array<int>, windows array<int>"))

    def merged(table: pa.Table) -> pa.Table:
        return _merged(table, length)

    repeated = sent.groupBy("shard").applyInArrow(merged, schema(key, "body long, start int, windows int"))

    gone = met.where(F.col("key").isNull()).drop("key").unionByName(materialise(repeated)).groupBy("event_id", "body").agg(
        F.collect_list(F.struct("start", "windows")).alias("gone"))
    joined = texts.alias("l").join(gone.alias("r"), _same("l", "r"), "left").select("l.event_id", "raw", "gone")
    return joined.mapInArrow(partial(_cleaned, length=length), schema(
        key, "n_bytes long, n_removed long, removed_spans array<struct<start: int, stop: int>>, kept_bytes binary"))
