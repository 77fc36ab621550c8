"""Near copies of source events by the Jaccard similarity of their word shingles, every link checked exactly.

1. Texts of the same words are one content with a SimHash fingerprint of its shingles. Fingerprints within ``RADIUS`` bits
   of each other are linked by ``simhash.links`` as stars; the contents of a star share a key.
   A fingerprint alone misses many near copies: each content also has ``BANDS`` keys, each made of ``ROWS`` minima over the
   shingles' hashes. Contents of similarity s share one with probability ``1 - (1 - s ** ROWS) ** BANDS``: 0.9996 at 0.8.
2. Contents that share a key are candidates. Every candidate link is checked on the two texts, by their sets of shingles.
3. Pairs inside a component tell nothing more and are left out before texts are fetched. A key with few pairs across
   components, as nearly all keys have from the start, is checked outright and done. The members of a larger key are first
   compared with a few of them; what that links is contracted, label onto label. Where many pairs across components
   remain, blocks of members outside the key's largest component are compared with all blocks in tiles: one product of
   the matrices of their shingles gives what all pairs have in common, and a tile returns a forest of links, not pairs.

So the groups are exactly the components of all candidate links of the wanted similarity, whatever the order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import simhash
from tidegauge.llm.lines import body_of
from tidegauge.llm.schemas import schema
from tidegauge.operators.graph import components
from tidegauge.session import materialise

RADIUS = 3  # differing bits of linked fingerprints
BANDS, ROWS = 20, 5
SLICE = 4096  # shingle hashes that are permuted at once
FEW = 4  # pairs across components for each member of a key that are checked in one go
FEW_PIVOTS = 10_000  # so many pivots, of some forty bytes each, are broadcast
BLOCK = 512  # members of a key in one block of a tile
PIVOTS = 8  # members of a larger key that each of its members is compared with in one round
_TIMES = np.array([xxhash.xxh64_intdigest(b"times %d" % i) | 1 for i in range(BANDS * ROWS)], np.uint64)[:, None]
_PLUS = np.array([xxhash.xxh64_intdigest(b"plus %d" % i) for i in range(BANDS * ROWS)], np.uint64)[:, None]


def shingles(raw: bytes | None, shingle: int) -> set[bytes]:
    """The distinct shingles of a text's lower-cased words; a text of fewer words is one; no word: none."""
    words = (raw or b"").lower().split()
    return set(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) if len(words) > shingle else {b" ".join(words)} if words else set()


def band_keys(grams: set[bytes]) -> np.ndarray:
    """The keys of a set of shingles as longs; none for an empty set."""
    if not grams:
        return np.empty(0, np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams))
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), SLICE):
        np.minimum(least, (hashes[at:at + SLICE] * _TIMES + _PLUS).min(axis=1), out=least)
    return np.array([digest(part.tobytes(), band) for band, part in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _contents(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content, size, keys, prints = [], [], [], []
        for raw in batch.column(0).to_pylist():
            grams = shingles(raw, shingle)
            content.append(xxhash.xxh3_128_digest(b" ".join((raw or b"").lower().split())))
            size.append(len(grams))
            keys.append(band_keys(grams))
            prints.append(simhash.fingerprint(raw, shingle))
        yield pa.RecordBatch.from_arrays(
            [pa.array(content, pa.binary()), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64())),
             pa.array(np.array(prints, np.uint64).view(np.int64)), *batch.columns[1:]],
            names=["content", "size", "keys", "fingerprint", *batch.schema.names[1:]])


def _similar(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            left, right = shingles(one, shingle), shingles(two, shingle)
            both = len(left & right)
            keep.append(100 * both >= percent * (len(left) + len(right) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose texts are similar. ``b`` may be frequent: that exchange is a plain join, which Spark splits."""
    one = texts.select(F.col("content").alias("a"), F.col("size").alias("size_a"), F.col("raw").alias("one"))
    two = texts.select(F.col("content").alias("b"), F.col("size").alias("size_b"), F.col("raw").alias("two"))
    near = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    met = pairs.join(one, "a").join(two, "b").where(near).select("a", "b", "one", "two")
    return materialise(met.mapInArrow(partial(_similar, shingle=shingle, percent=percent), "a binary, b binary"))


def _tile(table: pa.Table, shingle: int, percent: int) -> pa.Table:
    """Links between the components of one tile's members, as few as connect what is similar across the two sides."""
    content, label, side, raw = (table.column(c).to_pylist() for c in ("content", "label", "side", "raw"))
    numbers: dict[bytes, int] = {}
    sets = [np.fromiter((numbers.setdefault(g, len(numbers)) for g in shingles(r, shingle)), np.int64) for r in raw]
    sizes = np.array([len(x) for x in sets])
    often = np.bincount(np.concatenate(sets), minlength=len(numbers)) > 1
    place = np.cumsum(often) - 1
    owner, column = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    owner, column = owner[often[column]], place[column[often[column]]]
    left, right = (np.flatnonzero(np.array(side) & bit) for bit in (1, 2))
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(often.sum()), SLICE):
        here = (column >= at) & (column < at + SLICE)
        matrix = np.zeros((len(sets), SLICE), np.float32)
        matrix[owner[here], column[here] - at] = 1
        both += matrix[left] @ matrix[right].T
    near = 100 * both.astype(np.int64) >= percent * (sizes[left][:, None] + sizes[right] - both.astype(np.int64))
    names = {x: i for i, x in enumerate(dict.fromkeys(label))}
    group, links = np.array([names[x] for x in label]), []
    for i, row in enumerate(near):
        for j in right[row]:
            if group[j] != group[left[i]]:
                group[group == group[j]] = group[left[i]]
                links.append((content[left[i]], content[j]))
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _tiled(live: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links across the components of whole keys ``live(key, content, label, largest, n, most)``.

    Blocks of the members outside a key's largest component meet each other and all blocks inside it.
    """
    inside = F.col("label") == F.col("largest")
    blocks = {True: F.ceil(F.col("most") / BLOCK), False: F.ceil((F.col("n") - F.col("most")) / BLOCK)}
    own = F.pmod(F.xxhash64("content"), F.when(inside, blocks[True]).otherwise(blocks[False])).cast("int")

    def row(kind: int, i, j, side: int):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    def others(kind: str):
        return F.sequence(F.lit(0), (blocks[kind == "in"] - 1).cast("int"))

    meets = F.transform(others("out"), lambda j: row(0, F.col("own"), j, 1))
    met = F.transform(others("in"), lambda i: row(0, i, F.col("own"), 2))
    mutual = F.transform(others("out"), lambda j: F.struct(
        F.lit(1).alias("kind"), F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j"),
        F.when(F.col("own") == j, 3).when(F.col("own") < j, 1).otherwise(2).alias("side")))
    tiles = live.withColumn("own", own).select("key", "content", "label", F.explode(F.when(inside, meets).otherwise(F.concat(met, mutual))).alias("t"))
    dealt = tiles.select("key", "content", "label", "t.*").join(texts.select("content", "raw"), "content")

    def compared(table: pa.Table) -> pa.Table:
        return _tile(table, shingle, percent)

    return materialise(dealt.groupBy("key", "kind", "i", "j").applyInArrow(compared, "a binary, b binary"))


def _linked(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Components ``(content, label)`` of the similar pairs among ``members(key, content)`` of equal keys."""
    labels = None
    for first in (True, False):
        named = members.withColumn("label", F.col("content")) if first else members.join(labels, "content", "left").select(
            "key", "content", F.coalesce("label", "content").alias("label"))
        parts = named.groupBy("key", "label").agg(F.count("*").cast("decimal(38,0)").alias("n"))
        summed = parts.groupBy("key").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count("*").alias("parts"), F.max(F.struct("n", "label")).alias("largest"))
        way = F.when((F.col("n") * F.col("n") - F.col("same")) / 2 <= FEW * F.col("n"), "pairs").otherwise("pivots" if first else "tiles")
        keys = materialise(summed.where("parts > 1").select(
            "key", "n", F.col("largest.n").alias("most"), F.col("largest.label").alias("largest"), way.alias("way")))
        left = keys.agg(F.count_if(F.col("way") == "pairs"), F.count_if(F.col("way") == "pivots"), F.count_if(F.col("way") == "tiles")).first()
        if not sum(left):
            return labels
        live = named.join(keys, "key")
        whole = live.where("way = 'pairs'")
        other = whole.select("key", F.col("content").alias("b"), F.col("label").alias("other"))
        pairs = whole.join(other, "key").where(F.col("label") < F.col("other")).select(F.col("content").alias("a"), "b")
        if left[1]:
            large = live.where("way = 'pivots'").withColumn("hash", F.xxhash64("content"))
            order = Window.partitionBy("key").orderBy("hash", "content")
            pivots = large.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS).select(
                "key", F.col("content").alias("b"), F.col("hash").alias("at"))
            met = large.join(F.broadcast(pivots) if left[1] * PIVOTS <= FEW_PIVOTS else pivots, "key").where(F.col("content") != F.col("b"))
            nearest = Window.partitionBy("a").orderBy("at", "b")
            chosen = met.select(F.col("content").alias("a"), "b", "at").distinct().withColumn("place", F.row_number().over(nearest))
            pairs = pairs.unionByName(chosen.where(F.col("place") <= PIVOTS).select("a", "b"))
        found = _verified(materialise(pairs.distinct()), texts, shingle, percent)
        if left[2]:
            found = found.unionByName(_tiled(live.where("way = 'tiles'"), texts, shingle, percent))
        if not first:
            for side in ("a", "b"):
                known = labels.select(F.col("content").alias(side), F.col("label").alias(f"label_{side}"))
                found = found.join(known, side, "left").withColumn(side, F.coalesce(f"label_{side}", side)).drop(f"label_{side}")
        moved = components(found.select("a", "b"))
        links = moved.select(F.col("node").alias("content"), "label")
        if not first:
            onto = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("moved")), "label", "left").select(
                "content", F.coalesce("moved", "label").alias("label"))
            links = onto.unionByName(links.join(labels.select("content"), "content", "left_anti"))
        labels = materialise(links)
        if not left[1]:
            break
        members = materialise(members.join(keys.where("way = 'pivots'").select("key"), "key", "left_semi"))
    return labels


def _members(classes: DataFrame) -> DataFrame:
    """``(key, content)`` of every key that several contents share: centres of the SimHash links' stars, and keys of minima."""
    told = classes.select("content", "made.fingerprint")
    stars = simhash.links(told, RADIUS).select(F.col("a").alias("fingerprint"), F.col("b").alias("key"))
    alike = told.select("content", F.col("fingerprint").alias("key")).unionByName(told.join(stars, "fingerprint").select("content", "key"))
    entries = classes.select("content", F.explode("made.keys").alias("key")).unionByName(alike)
    shared = entries.groupBy("key").agg((F.min("content") != F.max("content")).alias("several")).where("several").select("key")
    return entries.join(shared, "key").select("key", "content").distinct()


def groups(events: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Near-copy group of every row of ``events(event_id, raw_text, ...)``.

    Words are split at ASCII white space after A-Z are lower-cased; a text of fewer words than ``shingle`` is one
    shingle; texts without words are copies of each other. Texts link when their sets of shingles share at least
    ``percent`` per cent of what both hold together; a pair at that limit is met with probability 0.9996, more similar
    ones nearly always. Returns one row per input row: ``event_id, component_id``, the smallest event id that links
    reach, ``group``, which names the group, and ``body``, a hash that tells apart texts of one event id. Null ids are
    kept; other columns are ignored; an empty table gives an empty result.
    """
    read = events.select(F.col("raw_text").cast("binary").alias("raw"), "event_id", body_of(F.col("raw_text")).alias("body"))
    made = schema("content binary, size int, keys array<long>, fingerprint long", ("event_id", events.schema["event_id"].dataType), "body long")
    rows = materialise(read.mapInArrow(partial(_contents, shingle=shingle), made))
    classes = materialise(rows.groupBy("content").agg(
        F.min("event_id").alias("least"), F.min(F.struct("event_id", "body")).alias("row"), F.min(F.struct("size", "keys", "fingerprint")).alias("made")))
    members = materialise(_members(classes))
    wanted = classes.join(members.select("content").distinct(), "content").select("content", "made.size", "row.event_id", "row.body")
    texts = materialise(read.alias("r").join(
        wanted.alias("w"), F.col("r.event_id").eqNullSafe(F.col("w.event_id")) & (F.col("r.body") == F.col("w.body"))
    ).select("content", "size", "raw").dropDuplicates(["content"]))
    labels = _linked(members, texts, shingle, percent)
    group = F.lit(None).cast("binary").alias("label")
    labelled = (classes.withColumn("label", group) if labels is None else classes.join(labels, "content", "left")).select(
        "content", "least", F.coalesce("label", "content").alias("group"))
    named = labelled.join(labelled.groupBy("group").agg(F.min("least").alias("component_id")), "group")
    return rows.select("content", "event_id", "body").join(named, "content").select("event_id", "component_id", "group", "body")
