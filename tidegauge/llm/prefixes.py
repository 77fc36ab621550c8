"""Prefix trie over the request histories of source routes, by vertical bitmaps.

Routes that open with the same requests could share those captures. A history is the sequence of a route's attempts, each
a strategy and the URL it asked for; a node of the trie is a distinct opening of a history.

1. Requests become digests. Histories are range-partitioned by route id and cut into shards of bounded size.
2. In a shard, every (position, request) posts the bitset of its routes. From the root, the bitset of all routes, the
   bitset of a node is intersected with the posting of its lowest open route's next request; that is a child. What is left
   goes on with the next open route, depth first. Population counts are the members, the routes that end here a list.
3. Nodes of several shards meet by a 128-bit digest of their opening: counts are summed, the smallest route id is kept.
   End lists of shards are runs of ascending ids and are streamed in order through SHA-256, never gathered.
4. Sums over subtrees need only nodes with two or more members, since below one member there is a chain. They are
   gathered by doubling: each round a node adds what its descendants at twice the distance hold, so the rounds grow with
   the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tidegauge.llm.schemas import schema
from tidegauge.session import materialise

SHARD_ROUTES = 4096  # bits of a bitset
SHARD_ATTEMPTS = 1 << 17  # a shard is closed at the route that reaches it
PART_ATTEMPTS = 1 << 18  # attempts of a range partition
NODE, PARENT = ("node_a", "node_b"), ("parent_a", "parent_b")
_ROOT = bytes(16)


def _nodes(histories: list[list[bytes]]) -> Iterator[tuple]:
    """``(node, parent, depth, first, members, last request, open members, ends)`` of each distinct opening in one shard.

    Routes are numbered by place; ``ends`` are the places of those whose history ends here.
    """
    posted: dict[tuple[int, bytes], list[int]] = {}
    ended: dict[int, int] = {}
    for place, history in enumerate(histories):
        ended[len(history)] = ended.get(len(history), 0) | 1 << place
        for position, request in enumerate(history):
            posted.setdefault((position, request), []).append(place)
    bitsets: dict[tuple[int, bytes], int] = {}

    def posting(at: tuple[int, bytes]) -> int:
        if at not in bitsets:
            bits = bytearray(len(histories) // 8 + 1)
            for place in posted[at]:
                bits[place >> 3] |= 1 << (place & 7)
            bitsets[at] = int.from_bytes(bits, "little")
        return bitsets[at]

    digest = xxhash.xxh3_128_digest
    stack = [(_ROOT, None, 0, (1 << len(histories)) - 1, None)]
    while stack:
        node, parent, depth, members, last = stack.pop()
        first = (members & -members).bit_length() - 1
        if members & (members - 1) == 0:  # one member: the rest of its history is a chain
            history = histories[first]
            while True:
                over = len(history) == depth
                yield node, parent, depth, first, 1, last, 0 if over else 1, [first] if over else None
                if over:
                    break
                last = history[depth]
                node, parent, depth = digest(node + last), node, depth + 1
            continue
        over = members & ended.get(depth, 0)
        rest = members ^ over
        ends, left = [], over
        while left:
            low = left & -left
            ends.append(low.bit_length() - 1)
            left ^= low
        yield node, parent, depth, first, members.bit_count(), last, rest.bit_count(), ends or None
        while rest:
            place = (rest & -rest).bit_length() - 1
            request = histories[place][depth]
            child = rest & posting((depth, request)) if len(posted[depth, request]) > 1 else 1 << place
            rest ^= child
            stack.append((digest(node + request), node, depth + 1, child, request))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of consecutive slices of one sorted partition of ``(route_id, request_a, request_b, chars)``."""
    routes: list = []
    histories: list[list[bytes]] = []
    chars: dict[bytes, int] = {}
    kind, held, open_route = None, 0, object()

    def drained() -> pa.RecordBatch:
        node, parent, depth, first, members, last, going, ends = zip(*_nodes(histories))

        def halves(digests) -> list[pa.Array]:
            two = np.frombuffer(b"".join(d or _ROOT for d in digests), "<i8").reshape(-1, 2)
            gone = np.array([d is None for d in digests])
            return [pa.array(two[:, i], mask=gone) for i in (0, 1)]

        return pa.RecordBatch.from_arrays(
            [*halves(node), *halves(parent), pa.array(depth, pa.int64()), pa.array([routes[i] for i in first], kind), pa.array(members, pa.int64()),
             pa.array([chars[x] if x else None for x in last], pa.int64()), pa.array(going, pa.int64()),
             pa.array([None if e is None else [routes[i] for i in e] for e in ends], pa.list_(kind))],
            names=[*NODE, *PARENT, "depth", "route_id", "n_routes", "chars", "going_on", "ends"])

    for batch in batches:
        kind = batch.schema.field("route_id").type
        two = np.stack([batch.column(i).fill_null(0).to_numpy() for i in (1, 2)], axis=1).astype("<i8").tobytes()
        for row, (route, at, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).is_valid().to_pylist(), batch.column(3).to_pylist())):
            if route != open_route:
                if len(routes) >= SHARD_ROUTES or held >= SHARD_ATTEMPTS:
                    yield drained()
                    routes, histories, chars, held = [], [], {}, 0
                routes.append(route)
                histories.append([])
                open_route = route
            if at:
                request = two[16 * row:16 * row + 16]
                histories[-1].append(request)
                chars[request] = size
                held += 1
    if routes:
        yield drained()


def _streamed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, from lists that come sorted by node and first id."""
    key, made = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([made.hexdigest()])], names=[*NODE, "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
            text = ",".join(map(str, ids)).encode()
            if (a, b) != key:
                if key is not None:
                    yield row()
                key, made = (a, b), hashlib.sha256(text)
            else:
                made.update(b"," + text)
    if key is not None:
        yield row()


def _matches(left: tuple, right: tuple):
    return (F.col(f"l.{left[0]}") == F.col(f"r.{right[0]}")) & (F.col(f"l.{left[1]}") == F.col(f"r.{right[1]}"))


def _subtree_sums(shared: DataFrame) -> DataFrame:
    """``shared(node_*, parent_*, n_leaves, saved_chars)`` with both numbers summed over each node's subtree."""
    state = materialise(shared.select(*NODE, *PARENT, "n_leaves", "saved_chars"))
    while state.where(F.col("parent_a").isNotNull()).limit(1).count():
        below = state.where(F.col("parent_a").isNotNull()).groupBy(*PARENT).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_chars").alias("saved"))
        summed = state.alias("l").join(below.alias("r"), _matches(NODE, PARENT), "left").select(
            *[f"l.{c}" for c in (*NODE, *PARENT)], (F.col("n_leaves") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_chars") + F.coalesce("saved", F.lit(0))).alias("saved_chars"))
        above = state.select(*NODE, F.col("parent_a").alias("above_a"), F.col("parent_b").alias("above_b"))
        state = materialise(summed.alias("l").join(above.alias("r"), _matches(PARENT, NODE), "left").select(
            *[f"l.{c}" for c in NODE], F.col("above_a").alias("parent_a"), F.col("above_b").alias("parent_b"), "n_leaves", "saved_chars"))
    return state.select(*NODE, "n_leaves", "saved_chars")


def trie(attempts: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Every distinct opening of the histories in ``attempts(route_id, event_seq, strategy_id, requested_url, ...)``.

    A route's attempts are ordered by ``event_seq``, null first; attempts of equal number follow in an order fixed by their
    content, so repeated rows are repeated attempts. A null strategy or URL is an empty one. ``routes(route_id)`` names
    routes that may have no attempt; these are members of the root. Attempts without a route id belong to no route and
    are left out. Other columns are ignored; without any route there is no node, not even a root.

    Returns per node ``route_id``, its smallest member; ``depth``; ``parent_route_id``, null for the root; ``n_routes``,
    members; ``n_children``; ``n_leaves``, nodes without children in its subtree, itself included; ``saved_chars``, over
    its subtree the sum of ``(n_routes - 1)`` times the code points in the node's last URL; ``ends_sha256``, the SHA-256
    of the ascending ids, comma-joined, of the routes that end here. One history is held by one task, as digests.
    """
    key = ("route_id", attempts.schema["route_id"].dataType)
    url, strategy = (F.coalesce(c, F.lit("")) for c in ("requested_url", "strategy_id"))
    steps = attempts.where(F.col("route_id").isNotNull()).select(
        "route_id", "event_seq", F.xxhash64(strategy, url).alias("request_a"), F.xxhash64(F.lit("again"), url, strategy).alias("request_b"),
        F.length(url).cast("long").alias("chars"))
    if routes is not None:
        bare = routes.where(F.col("route_id").isNotNull()).select(F.col("route_id").cast(key[1])).distinct()
        steps = steps.unionByName(bare.join(steps.select("route_id").distinct(), "route_id", "left_anti"), allowMissingColumns=True)
    steps = materialise(steps)
    parts = max(1, -(-steps.count() // PART_ATTEMPTS))
    order = ["route_id", F.asc_nulls_first("event_seq"), "request_a", "request_b"]
    ranged = steps.repartitionByRange(parts, "route_id").sortWithinPartitions(*order).select("route_id", "request_a", "request_b", "chars")
    local = materialise(ranged.mapInArrow(_shards, schema(
        "node_a long, node_b long, parent_a long, parent_b long, depth long", key, "n_routes long, chars long, going_on long",
        ("ends", ArrayType(key[1])))))

    nodes = materialise(local.groupBy(*NODE).agg(
        *[F.max(c).alias(c) for c in (*PARENT, "depth", "chars")], F.min("route_id").alias("route_id"),
        *[F.sum(c).alias(c) for c in ("n_routes", "going_on")]))
    shared = nodes.where("n_routes > 1")
    kids = nodes.groupBy(*PARENT).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_routes") == 1).alias("single"))
    own = materialise(shared.alias("l").join(kids.alias("r"), _matches(NODE, PARENT), "left").select(
        "l.*", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(F.col("single")).cast("long").alias("n_leaves"),
        ((F.col("n_routes") - 1) * F.coalesce("chars", F.lit(0))).alias("saved_chars")))
    sums = _subtree_sums(own)
    listed = local.where(F.col("ends").isNotNull()).alias("l").join(own.select(*NODE).alias("r"), _matches(NODE, NODE), "left_semi").select(
        *NODE, "ends", F.col("ends")[0].alias("first"))
    ends = listed.repartition(*NODE).sortWithinPartitions(*NODE, "first").drop("first").mapInArrow(
        _streamed_ends, "node_a long, node_b long, ends_sha256 string")
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    many = own.drop("n_leaves", "saved_chars").alias("l").join(sums.alias("r"), _matches(NODE, NODE)).select(
        "l.*", "n_leaves", "saved_chars").alias("l").join(ends.alias("r"), _matches(NODE, NODE), "left").select(
        "l.*", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
    one = nodes.where("n_routes = 1").select(
        *own.columns[:-3], F.col("going_on").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_chars"),
        F.when(F.col("going_on") == 0, F.sha2(F.col("route_id").cast("string").cast("binary"), 256)).otherwise(nobody).alias("ends_sha256"))
    parents = own.select(*NODE, F.col("route_id").alias("shared_parent"))
    found = many.unionByName(one).alias("l").join(parents.alias("r"), _matches(PARENT, NODE), "left")
    # The parent of a node with one member is shared or has that same member.
    parent = F.when(F.col("depth") > 0, F.coalesce("shared_parent", "route_id")).alias("parent_route_id")
    return found.select("route_id", "depth", parent, "n_routes", "n_children", "n_leaves", "saved_chars", "ends_sha256")
