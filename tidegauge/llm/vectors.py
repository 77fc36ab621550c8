"""Near-duplicate vectors by an inverted multi-index.

The research records hold no vectors; this operator is general and takes any table of ids and number arrays.

The two halves of the unit vectors have codebooks of their own; a pair of codes names a cell of their product grid, and
every vector lives in one cell. A vector then visits cells in order of a bound on how far a vector of that cell must be
(multi-sequence traversal over the two sorted code lists), up to the limit that reaches ``target_recall`` on calibration
pairs; in a visited cell every cosine is computed in double precision, and a link found from either side counts once.

Equal vectors are reduced to one class with a weight before any of that. Vectors of a cell are compared in blocks, so a
cell may hold any share of them. A block returns counts per vector and a spanning forest of its links, never pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.simhash import forest
from tidegauge.operators.graph import components
from tidegauge.session import broadcast_if_small, materialise

SAMPLE = 8_192
CALIBRATION_PAIRS = 4_096  # of the sample's own links, from each block of it
MIN_COSINE = 0.95
TARGET_RECALL = 0.995
MEMBERS, QUERIES, CHUNK = 2_048, 8_192, 512
MAX_CODES = 1_024


@dataclass
class Codebook:
    """Centres of both halves for vectors of one length, and how far to go."""

    split: int
    first: np.ndarray
    second: np.ndarray
    limit: float


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means from random rows."""
    centres = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(12):
        code = _distances(x, centres).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, code, x)
        size = np.bincount(code, minlength=len(centres))
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _bounds(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance from each row to the border of each centre's region: no vector living there is nearer."""
    d = _distances(x, centres)
    home = d.argmin(1)
    apart = np.sqrt(np.maximum(_distances(centres, centres)[home], 1e-30))
    bound = ((d - d[np.arange(len(x)), home][:, None]) / (2 * apart)) ** 2
    bound[np.arange(len(x)), home] = 0
    return bound


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int, float]]:
    """Cells ``(i, j)`` by increasing ``first[i] + second[j]``, up to ``limit``."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    heap, pushed = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= limit:
        bound, i, j = heapq.heappop(heap)
        yield int(one[i]), int(two[j]), bound
        for step in ((i + 1, j), (i, j + 1)):
            if step[0] < len(a) and step[1] < len(b) and step not in pushed:
                pushed.add(step)
                heapq.heappush(heap, (a[step[0]] + b[step[1]], *step))


def fit_codebook(sample: np.ndarray, rows: int, min_cosine: float, target_recall: float) -> Codebook:
    """Codebook from unit vectors of one length, out of ``rows`` in all.

    The limit is the ``target_recall`` quantile of the bound between calibration pairs: the sample's own links, by brute
    force, and a copy of every sampled vector turned by exactly the angle of ``min_cosine`` in a random direction.
    """
    rng = np.random.default_rng(7)
    split = sample.shape[1] // 2
    codes = int(min(MAX_CODES, 2 ** max(2, round(np.log2(max(rows, 64) / 64) / 2))))
    first, second = _centres(sample[:, :split], codes, rng), _centres(sample[:, split:], codes, rng)
    side = rng.standard_normal(sample.shape)
    side -= (side * sample).sum(1)[:, None] * sample
    length = np.linalg.norm(side, axis=1)
    turned = sample * min_cosine + side / np.maximum(length, 1e-30)[:, None] * np.sqrt(1 - min_cosine ** 2)
    pairs = [(sample, turned)]
    for at in range(0, len(sample), 512):
        near = np.flatnonzero(sample[at:at + 512] @ sample.T >= min_cosine)
        one, two = at + near // len(sample), near % len(sample)
        taken = rng.permutation(np.flatnonzero(one != two))[:CALIBRATION_PAIRS]
        pairs.append((sample[one[taken]], sample[two[taken]]))

    def reach(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        own = np.arange(len(x))
        one = _bounds(x[:, :split], first)[own, _distances(y[:, :split], first).argmin(1)]
        return one + _bounds(x[:, split:], second)[own, _distances(y[:, split:], second).argmin(1)]

    # Either side of a pair may find the other.
    found = [np.minimum(reach(x, y), reach(y, x)) for x, y in pairs if len(x)]
    own = [np.quantile(np.concatenate(part), target_recall) for part in (found[:1], found[1:]) if part]
    return Codebook(split, first, second, float(max(own)) + 1e-9)


def _cells(batches: Iterator[pa.RecordBatch], books: dict[int, Codebook]) -> Iterator[pa.RecordBatch]:
    """For each class a member row in its own cell and a query row in every cell it visits."""
    for batch in batches:
        out: list[tuple] = []
        for node, weight, values in zip(*(c.to_pylist() for c in batch.columns)):
            x = np.array(values, np.float64)
            x /= np.linalg.norm(x)
            book = books[len(x)]
            one, two = _bounds(x[None, :book.split], book.first)[0], _bounds(x[None, book.split:], book.second)[0]
            visited = [len(x) << 40 | i << 20 | j for i, j, _ in multi_sequence(one, two, book.limit)]
            packed = x.tobytes()
            out.append((visited[0], True, node, weight, visited[0], visited, packed))
            out += [(cell, False, node, weight, visited[0], None, packed) for cell in visited]
        columns = list(zip(*out)) or [[]] * 7
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["cell", "member", "node", "weight", "home", "visited", "vector"])


def compare(members: pa.Table, queries: pa.Table, min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one block: node numbers, links found for each, and a spanning forest."""
    node_m, node_q = members.column("node").to_numpy(), queries.column("node").to_numpy()
    weight_m, weight_q = members.column("weight").to_numpy(), queries.column("weight").to_numpy()
    m = np.stack([np.frombuffer(v, np.float64) for v in members.column("vector").to_pylist()])
    q = np.stack([np.frombuffer(v, np.float64) for v in queries.column("vector").to_pylist()])
    homes, home = np.unique(queries.column("home").to_numpy(), return_inverse=True)
    # A member that visits the query's home finds the pair there from its own side.
    mutual = np.zeros((len(homes), len(m)), bool)
    for row, visited in enumerate(members.column("visited").to_pylist()):
        at = np.searchsorted(homes, visited)
        at = at[at < len(homes)]
        mutual[at, row] = np.isin(homes[at], visited)
    count_m, count_q, trees = np.zeros(len(m), np.int64), np.zeros(len(q), np.int64), []
    for at in range(0, len(q), CHUNK):
        part = slice(at, at + CHUNK)
        linked = (q[part] @ m.T >= min_cosine) & (node_q[part][:, None] != node_m[None, :])
        if linked.any():
            count_q[part] = linked @ weight_m
            count_m += (linked & ~mutual[home[part]]).T @ weight_q[part]
            rows, cols = np.nonzero(linked)
            trees.append(forest(np.stack([node_q[part][rows], node_m[cols]], axis=1)))
            if sum(map(len, trees)) > 1 << 18:
                trees = [forest(np.concatenate(trees))]
    edges = forest(np.concatenate(trees)) if trees else np.empty((0, 2), np.int64)
    return np.concatenate([node_q, node_m]), np.concatenate([count_q, count_m]), edges


def _compared(key: tuple, rows: pa.Table, min_cosine: float) -> pa.Table:
    member = rows.column("member")
    members, queries = rows.filter(member), rows.filter(pa.compute.invert(member))
    if not len(members) or not len(queries):
        nodes, counts, edges = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.int64)
    else:
        nodes, counts, edges = compare(members, queries, min_cosine)
    nodes, counts = nodes[counts > 0], counts[counts > 0]
    return pa.table({
        "a": pa.array(np.concatenate([nodes, edges[:, 0]])),
        "b": pa.concat_arrays([pa.nulls(len(nodes), pa.int64()), pa.array(edges[:, 1])]),
        "links": pa.array(np.concatenate([counts, np.zeros(len(edges), np.int64)]))})


def usable(vector: str = "vector"):
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def groups(vectors: DataFrame, min_cosine: float = MIN_COSINE, target_recall: float = TARGET_RECALL, sample: int = SAMPLE) -> DataFrame:
    """Links and components of ``vectors(vector_id, vector, ...)``, vectors of numbers of any length.

    Two rows link when their vectors have the same length and a cosine of at least ``min_cosine``, both in double
    precision. A vector that is null, empty, zero or holds a null or non-finite component links with nothing. The
    codebooks are fitted on at most ``sample`` vectors of each length; every row is indexed and queried. No link below
    ``min_cosine`` is returned; of those above, the traversal finds at least about ``target_recall``.

    Returns one row per input row: ``vector_id, n_links`` (other rows linked), ``component_id`` (smallest id reachable,
    the own one included) and ``kept`` (the row's id is the component's). Rows with equal vectors are copies: they link
    with each other and share everything else, also where they repeat an id. A null id is never a component's name as
    long as another id is in it. Other columns are ignored; an empty table gives an empty result.
    """
    typed = vectors.select("vector_id", F.col("vector").cast("array<double>").alias("vector"))
    marked = typed.select("vector_id", F.when(usable(), F.col("vector")).alias("vector"))
    rows = materialise(marked.withColumn("node", F.xxhash64("vector")))
    classes = materialise(
        rows.where("vector IS NOT NULL").groupBy("node")
        .agg(F.count("*").alias("weight"), F.min("vector_id").alias("least"), F.first("vector").alias("vector")))
    lengths = {r.n: r.rows for r in classes.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).collect()}
    books = {}
    for n, n_rows in lengths.items():
        taken = classes.where(F.size("vector") == n).orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").toArrow()
        x = taken.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, n)
        books[n] = fit_codebook(x / np.linalg.norm(x, axis=1, keepdims=True), n_rows, min_cosine, target_recall)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cells(batches, books)

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        return _compared(key, table, min_cosine)

    placed = materialise(classes.select("node", "weight", "vector").mapInArrow(
        cells, "cell long, member boolean, node long, weight long, home long, visited array<long>, vector binary"))
    # At most MAX_CODES squared cells for each length of vector.
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count_if("member") / MEMBERS).alias("member_blocks"), F.ceil(F.count_if(~F.col("member")) / QUERIES).alias("query_blocks"))
    here = F.pmod(F.xxhash64("node"), F.when(F.col("member"), F.col("member_blocks")).otherwise(F.col("query_blocks")))
    everywhere = F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("query_blocks")).otherwise(F.col("member_blocks")) - 1))
    spread = placed.join(broadcast_if_small(sizes, MAX_CODES ** 2), "cell").where("member_blocks > 0 AND query_blocks > 0").select(
        *placed.columns, here.alias("here"), everywhere.alias("there"))
    blocks = spread.withColumn("member_block", F.when(F.col("member"), F.col("here")).otherwise(F.col("there"))).withColumn(
        "query_block", F.when(F.col("member"), F.col("there")).otherwise(F.col("here")))
    # Dealt by block: the partitioning by cell alone would bring all blocks of a cell to one task.
    dealt = blocks.drop("here", "there").repartition("cell", "member_block", "query_block")
    found = materialise(
        dealt.groupBy("cell", "member_block", "query_block").applyInArrow(compared, "a long, b long, links long"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(found.where("b IS NOT NULL").select("a", "b"))
    labelled = classes.select("node", "weight", "least").join(labels, "node", "left").select(
        "node", "weight", "least", F.coalesce("label", "node").alias("label"))
    named = labelled.join(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "label").join(counts, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = rows.where("vector IS NOT NULL").select("vector_id", "node").join(named, "node").select("vector_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("vector_id", F.lit(0).cast("long").alias("n_links"), F.col("vector_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vector_id").eqNullSafe(F.col("component_id")))
