"""Language-model scores of source events: interpolated modified Kneser-Ney, counted in Spark.

A model of order n is n tables, one per n-gram length, each a sorted array of 64-bit hashes with the numbers that belong
to them. A table is cut into shards by the high bits of the hash, written by the task that counted the shard into the
folder of ``spark.checkpoint.dir`` and memory-mapped from there by the workers that score. That folder must therefore be
a mounted one. Nothing is pruned and no worker holds a table in memory, so the model may grow with the corpus.

Counting. A task hashes its words, counts distinct n-grams and sends each shard its part as one compressed block. Shards
go by the hash of the whole n-gram, so a word that makes up a third of the corpus is spread over all of them. A shard
adds up its n-grams, writes them, and sends what they say about shorter ones: each is one more left neighbour of its
suffix, and one more continuation of its context. The same step then makes the table of the next shorter length.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import partial
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.schemas import schema
from tidegauge.session import shared_dir

ORDER = 2
SLICE_BYTES = 1 << 20
FLUSH_ROWS = 1_500_000
#: Numbers of an n-gram: occurrences, distinct left neighbours; as a context: continuations' sum, and how many of them count 1, 2, more.
FIELDS = ("occurrences", "neighbours", "total", "ones", "twos", "more")

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
START, END = np.uint64(1), np.uint64(2)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_keys(words: np.ndarray) -> np.ndarray:
    """One hash per row of an (n, k) array of word hashes."""
    key = np.full(len(words), words.shape[1], np.uint64)
    for column in range(words.shape[1]):
        key = _mixed(key * _BASE + words[:, column])
    return key


def _slice_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words in a stretch of lower-cased bytes, by differences of one running sum."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers = np.full(len(raw), _BASE)
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)))
    inverse = np.full(len(raw), _INVERSE)
    inverse[:1] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    own = (sums[stops] - sums[starts]) * inverse[starts]
    return _mixed(own + (stops - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), starts


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an end token after each, and the number of tokens of each text."""
    hashes, owners, group, held = [], [], [], 0

    def done() -> None:
        joined = b" ".join(t for _, t in group)
        raw = np.frombuffer(joined.lower(), np.uint8)
        found, starts = _slice_words(raw)
        ends = np.cumsum([len(t) + 1 for _, t in group])
        hashes.append(found)
        owners.append(np.array([n for n, _ in group], np.int64)[np.searchsorted(ends, starts, side="right")])

    for number, text in enumerate(texts):
        text = text or b""
        at = 0
        while at < len(text):
            stop = min(len(text), at + SLICE_BYTES - held)
            while stop < len(text) and text[stop] not in b" \t\n\x0b\x0c\r":
                stop += 1
            group.append((number, text[at:stop]))
            held += stop - at
            at = stop
            if held >= SLICE_BYTES:
                done()
                group, held = [], 0
    if group:
        done()
    words, owner = np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate([np.empty(0, np.int64), *owners])
    counts = np.bincount(owner, minlength=len(texts)) if len(texts) else np.empty(0, np.int64)
    return np.insert(words, np.cumsum(counts), END), counts + 1


def gram_rows(tokens: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """A row of ``order`` word hashes per token, the token last; starts stand before a text."""
    first = np.repeat(np.cumsum(counts) - counts, counts)
    at = np.arange(len(tokens))
    return np.stack([np.where(at - back >= first, tokens[np.maximum(at - back, 0)], START) for back in range(order - 1, -1, -1)], axis=1)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _packed(words: np.ndarray, numbers: dict[str, np.ndarray]) -> bytes:
    """A block of n-grams: sorted by first word, column after column, narrow integers, compressed."""
    order = np.argsort(words[:, 0], kind="stable")
    parts, head = [np.ascontiguousarray(words[order, c]).tobytes() for c in range(words.shape[1])], {}
    for name, values in numbers.items():
        kind = np.min_scalar_type(int(values.max(initial=0)))
        head[name] = kind.str
        parts.append(values[order].astype(kind).tobytes())
    lead = json.dumps({"n": len(words), "k": words.shape[1], "numbers": head}).encode()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(lead).to_bytes(4, "little"), lead, *parts]))


def _unpacked(block: bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    data = zstandard.ZstdDecompressor().decompress(block)
    at = 4 + int.from_bytes(data[:4], "little")
    head = json.loads(data[4:at])
    n, k = head["n"], head["k"]
    words = np.frombuffer(data, np.uint64, n * k, at).reshape(k, n).T
    at += 8 * n * k
    numbers = {}
    for name, kind in head["numbers"].items():
        numbers[name] = np.frombuffer(data, kind, n, at).astype(np.uint64)
        at += n * np.dtype(kind).itemsize
    return words, numbers


def _added(words: np.ndarray, numbers: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Rows of equal n-grams added up, sorted by key."""
    keys = gram_keys(words)
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.empty(0, np.int64)
    summed = {name: np.add.reduceat(values[order], first) if len(first) else values[:0] for name, values in numbers.items()}
    return ordered[first], words[order[first]], summed


def _blocks(words: np.ndarray, numbers: dict[str, np.ndarray], shards: int) -> Iterator[tuple[int, bytes]]:
    keys, words, numbers = _added(words, numbers)
    shard = _shard_of(keys, shards)
    bounds = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(keys) else [0]
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield int(shard[a]), _packed(words[a:b], {name: values[a:b] for name, values in numbers.items()})


def _count(batches: Iterator[pa.RecordBatch], order: int, shards: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def sent() -> pa.RecordBatch:
        rows = np.concatenate([np.empty((0, order), np.uint64), *held])
        held.clear()
        blocks = list(_blocks(rows, {"occurrences": np.ones(len(rows), np.uint64)}, shards))
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=["shard", "block"])

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for at in range(0, len(texts), 512):
            held.append(gram_rows(*token_hashes(texts[at:at + 512]), order))
            if sum(map(len, held)) >= FLUSH_ROWS:
                yield sent()
    yield sent()


def _write(path: str, keys: np.ndarray, numbers: dict[str, np.ndarray], facts: dict) -> None:
    """One shard of a table; a repeated task replaces the file by an equal one."""
    columns = {name: values.astype(np.min_scalar_type(int(values.max(initial=0)))) for name, values in numbers.items()}
    head = json.dumps({"n": len(keys), "columns": {n: v.dtype.str for n, v in columns.items()}, "facts": facts}).encode()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as file:
        file.write(len(head).to_bytes(8, "little") + head + b" " * (-(len(head) + 8) % 64))
        for values in (keys, *columns.values()):
            file.write(values.tobytes() + b"\0" * (-values.nbytes % 64))
    os.replace(own, path)


def _table(key: tuple, table: pa.Table, level: int, top: bool, folder: str, shards: int) -> pa.Table:
    """Adds up a shard of the n-grams of one length, writes it, and returns blocks for the next shorter length."""
    shard = key[0].as_py()
    parts = [_unpacked(b.as_py()) for b in table.column("block")]
    words = np.concatenate([w for w, _ in parts])
    numbers = {
        name: np.concatenate([p.get(name, np.zeros(len(w), np.uint64)) for w, p in parts])
        for name in (FIELDS[:1] if top else FIELDS)}
    del parts
    keys, words, numbers = _added(words, numbers)
    counted = numbers["occurrences" if top else "neighbours"]
    facts = {f"t{k}": int((counted == k).sum()) for k in (1, 2, 3, 4)}
    facts |= {"kinds": int((counted > 0).sum()), "counted": int(counted.sum()), "occurrences": int(numbers["occurrences"].sum())}
    _write(f"{folder}/{level}/{shard}.table", keys, numbers, facts)
    out = []
    if level > 1:
        real = counted > 0  # not only a context
        zero, one = np.zeros(int(real.sum()), np.uint64), np.ones(int(real.sum()), np.uint64)
        count = counted[real]
        suffix = dict(zip(FIELDS, (numbers["occurrences"][real], one, zero, zero, zero, zero)))
        context = dict(zip(FIELDS, (zero, zero, count, (count == 1).astype(np.uint64), (count == 2).astype(np.uint64), (count > 2).astype(np.uint64))))
        shorter = np.concatenate([words[real, 1:], words[real, :-1]])
        out = list(_blocks(shorter, {n: np.concatenate([suffix[n], context[n]]) for n in FIELDS}, shards))
    return pa.table({"shard": pa.array([s for s, _ in out], pa.int32()), "block": pa.array([b for _, b in out], pa.binary())})


def _table_of(level: int, top: bool, folder: str, shards: int):
    def table(key: tuple, rows: pa.Table) -> pa.Table:
        return _table(key, rows, level, top, folder, shards)

    return table


@dataclass
class Model:
    """Where the tables are and what holds for all n-grams; small, and sent to the workers."""

    folder: str
    order: int
    shards: int
    facts: list[dict] = field(default_factory=list)  # by length, from 1

    @property
    def train_tokens(self) -> int:
        return self.facts[0]["occurrences"]

    @property
    def vocabulary(self) -> int:
        return self.facts[0]["kinds"]

    def discounts(self, level: int) -> np.ndarray:
        """What is taken from counts of 0, 1, 2 and more."""
        t1, t2, t3, t4 = (self.facts[level - 1][f"t{k}"] for k in (1, 2, 3, 4))
        if not (t1 and t2 and t3):  # too few n-grams to estimate from
            return np.array([0, 0.5, 0.75, 0.9])
        y = t1 / (t1 + 2 * t2)
        return np.clip([0, 1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3], 0, [0, 1, 2, 3])


def _local(uri: str) -> str:
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder, which workers can map: {uri}")
    return unquote(parsed.path)


def fit(spark: SparkSession, events: DataFrame, order: int = ORDER) -> Model:
    """Counts the n-grams of all texts of ``events(raw_text, ...)`` up to ``order`` (2 at least) words.

    Words are runs of other than ASCII white space after A-Z are lower-cased; each text ends with an end token. Null
    texts are empty ones: an end token alone. Repeated rows count as often as they occur; other columns are ignored.
    An empty table gives a model that knows nothing and scores every token alike.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{_local(shared_dir(spark))}/ngrams/{uuid.uuid4().hex}"
    blocks = events.select(F.col("raw_text").cast("binary").alias("raw")).mapInArrow(
        partial(_count, order=order, shards=shards), "shard int, block binary")
    for level in range(order, 0, -1):
        blocks = blocks.groupBy("shard").applyInArrow(_table_of(level, level == order, folder, shards), "shard int, block binary")
    blocks.write.format("noop").mode("overwrite").save()
    model = Model(folder, order, shards)
    for level in range(1, order + 1):
        sums = dict.fromkeys(("t1", "t2", "t3", "t4", "kinds", "counted", "occurrences"), 0)
        for shard in range(shards):
            if os.path.exists(path := f"{folder}/{level}/{shard}.table"):
                for name, value in _head(path)[0]["facts"].items():
                    sums[name] += value
        model.facts.append(sums)
    return model


def _head(path: str) -> tuple[dict, int]:
    with open(path, "rb") as file:
        n = int.from_bytes(file.read(8), "little")
        head = json.loads(file.read(n))
    return head, n + 8 + (-(n + 8) % 64)


_MAPPED: dict[str, tuple | None] = {}


def _mapped(path: str) -> tuple[np.ndarray, dict[str, np.ndarray]] | None:
    """Keys and columns of a shard, mapped once per worker."""
    if path not in _MAPPED:
        if not os.path.exists(path):
            _MAPPED[path] = None
        else:
            head, at = _head(path)
            arrays = []
            for kind in ("<u8", *head["columns"].values()):
                size = head["n"] * np.dtype(kind).itemsize
                arrays.append(np.memmap(path, kind, "r", at, (head["n"],)) if head["n"] else np.empty(0, kind))
                at += size + (-size % 64)
            _MAPPED[path] = arrays[0], dict(zip(head["columns"], arrays[1:]))
    return _MAPPED[path]


def _looked_up(model: Model, level: int, keys: np.ndarray, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Numbers of the n-grams behind ``keys``, zero where a table lacks one; each shard is searched in its own order."""
    distinct, back = np.unique(keys, return_inverse=True)
    found = {name: np.zeros(len(distinct), np.float64) for name in names}
    shard = _shard_of(distinct, model.shards)
    bounds = np.searchsorted(shard, np.arange(model.shards + 1))
    for number in np.unique(shard).tolist():
        mapped = _mapped(f"{model.folder}/{level}/{number}.table")
        if mapped is None or not len(mapped[0]):
            continue
        a, b = bounds[number], bounds[number + 1]
        at = np.minimum(np.searchsorted(mapped[0], distinct[a:b]), len(mapped[0]) - 1)
        here = mapped[0][at] == distinct[a:b]
        for name in names:
            if name in mapped[1]:
                found[name][a:b] = np.where(here, mapped[1][name][at], 0)
    return {name: values[back] for name, values in found.items()}


def _probabilities(model: Model, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the last word of each row, and its occurrences in the training texts."""
    known = _looked_up(model, 1, gram_keys(rows[:, -1:]), ("occurrences", "neighbours"))
    facts = model.facts[0]
    uniform = 1 / (model.vocabulary + 1)
    if not facts["counted"]:
        return np.full(len(rows), uniform), known["occurrences"]
    d = model.discounts(1)
    count = known["neighbours"]
    kinds = np.array([0, facts["t1"], facts["t2"], facts["kinds"] - facts["t1"] - facts["t2"]])
    p = (count - d[np.minimum(count, 3).astype(int)]) / facts["counted"] + (d @ kinds) / facts["counted"] * uniform
    for level in range(2, model.order + 1):
        words = rows[:, -level:]
        name = "occurrences" if level == model.order else "neighbours"
        count = _looked_up(model, level, gram_keys(words), (name,))[name]
        context = _looked_up(model, level - 1, gram_keys(words[:, :-1]), ("total", "ones", "twos", "more"))
        d = model.discounts(level)
        seen = context["total"] > 0
        total = np.where(seen, context["total"], 1)
        left = (d[1] * context["ones"] + d[2] * context["twos"] + d[3] * context["more"]) / total
        p = np.where(seen, (count - d[np.minimum(count, 3).astype(int)]) / total + left * p, p)
    return p, known["occurrences"]


def _score(batches: Iterator[pa.RecordBatch], facts: dict) -> Iterator[pa.RecordBatch]:
    model = Model(**facts)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        columns: list[list[np.ndarray]] = [[] for _ in range(4)]
        for at in range(0, len(texts), 512):
            tokens, counts = token_hashes(texts[at:at + 512])
            starts = np.cumsum(counts) - counts
            p, c = _probabilities(model, gram_rows(tokens, counts, model.order))
            base = np.log10((c + 0.5) / (model.train_tokens + 0.5 * (model.vocabulary + 1)))
            columns[0].append(counts)
            columns[1].append(np.add.reduceat((c > 0).astype(np.int64), starts))
            columns[2].append(np.add.reduceat(base, starts))
            columns[3].append(np.add.reduceat(np.log10(p), starts))
        merged = [np.concatenate(c) if c else np.empty(0) for c in columns]
        yield pa.RecordBatch.from_arrays(
            [pa.array(merged[0], pa.int64()), pa.array(merged[1], pa.int64()), pa.array(merged[2], pa.float64()), pa.array(merged[3], pa.float64()),
             pa.array(10 ** (-merged[3] / np.maximum(merged[0], 1)), pa.float64()), batch.column(1)],
            names=["n_tokens", "n_known", "base_score", "score", "perplexity", "event_id"])


def score(events: DataFrame, model: Model) -> DataFrame:
    """Scores every row of ``events(event_id, raw_text, ...)``.

    Returns one row per input row: ``event_id, n_tokens`` (words and one end), ``n_known`` (tokens seen in training),
    ``base_score`` (log10 under additively smoothed single words), ``score`` (log10 probability under the model) and
    ``perplexity`` per token. A null or empty text is the end token alone; null ids are kept; other columns are ignored.
    """
    return events.select(F.col("raw_text").cast("binary").alias("raw"), "event_id").mapInArrow(
        partial(_score, facts=asdict(model)),
        schema("n_tokens long, n_known long, base_score double, score double, perplexity double", ("event_id", events.schema["event_id"].dataType)))
