"""Content digests of rows and of whole tables.

Row digest: sha256 of the JSON of all columns in name order, NULLs kept.
Table digest: the root of a Merkle tree over the sorted row digests. The tree deals digests by their leading hex digits,
as many as bring a leaf to about ``LEAF_ROWS`` rows, so it depends on the rows alone: not on their order, nor on how they
are partitioned. Equal rows are counted before anything is gathered, digests are uniform, so leaves are small whatever
the table holds. A forged table would need a collision of sha256, and two trees tell which leaf differs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import materialise

LEAF_ROWS = 1024
_DEEPEST = 12  # hex digits; 2 ** 58 rows


def row_digest(columns: Sequence[str]) -> Column:
    return F.sha2(
        F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256
    )


def text_digest(*parts: Column | str, sep: str = "\u0000") -> Column:
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(sep, *cols), 256)


def _joined(kind: str, entries: str) -> Column:
    """Digest of a node: its kind and its sorted entries, so that no leaf can pass for an inner node."""
    return F.sha2(F.concat_ws("|", F.lit(kind), F.sort_array(F.collect_list(entries))), 256)


def merkle_tree(df: DataFrame, columns: Sequence[str] | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Nodes ``(*group, level, prefix, row_count, node_sha256)`` of a table's tree, one tree per group.

    The root has level 0 and an empty prefix; a node of level ``k`` covers the row digests that begin with its ``k`` hex
    digits. A leaf hashes its distinct digests with their counts, an inner node its children's prefixes and hashes. A
    table without rows has no node.
    """
    group, cols = list(group), list(columns or df.columns)
    counted = materialise(df.select(*group, row_digest(cols).alias("_d")).groupBy(*group, "_d").agg(F.count("*").alias("_n")))
    sizes = counted.groupBy(*group).agg(F.sum("_n").alias("_all"))
    depth = sum(((F.col("_all") > LEAF_ROWS * 16**k).cast("int") for k in range(_DEEPEST)), F.lit(0))
    depths = materialise(sizes.select(*group, depth.alias("_depth")))
    deepest = depths.agg(F.max("_depth")).first()[0]
    if deepest is None:
        return counted.select(*group, F.lit(0).alias("level"), F.lit("").alias("prefix"), F.col("_n").alias("row_count"), F.col("_d").alias("node_sha256"))
    if group:
        same = [F.col(f"c.{g}").eqNullSafe(F.col(f"d.{g}")) for g in group]
        placed = counted.alias("c").join(depths.alias("d"), same).select("c.*", "_depth")
    else:
        placed = counted.withColumn("_depth", F.lit(deepest))
    nodes = materialise(placed.withColumn("prefix", F.substring("_d", F.lit(1), F.col("_depth"))).withColumn(
        "_e", F.concat_ws(":", "_d", F.col("_n").cast("string"))).groupBy(*group, F.col("_depth").alias("level"), "prefix").agg(
        F.sum("_n").alias("row_count"), _joined("leaf", "_e").alias("node_sha256")))
    for level in range(deepest, 0, -1):
        below = nodes.where(F.col("level") == level)
        inner = below.withColumn("_e", F.concat_ws(":", "prefix", "node_sha256")).groupBy(*group, F.substring("prefix", 1, level - 1).alias("prefix")).agg(
            F.sum("row_count").alias("row_count"), _joined("node", "_e").alias("node_sha256"))
        nodes = materialise(nodes.unionByName(inner.withColumn("level", F.lit(level - 1))))
    return nodes


def table_digest(df: DataFrame, columns: Sequence[str] | None = None, group: Sequence[str] = ()) -> DataFrame:
    """``row_count`` and ``table_sha256``, the root of the table's Merkle tree, per group; without a group always one row."""
    roots = merkle_tree(df, columns, group).where("level = 0").select(*group, "row_count", F.col("node_sha256").alias("table_sha256"))
    if group:
        return roots
    empty = F.sha2(F.lit("leaf"), 256)
    return roots.agg(F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count"), F.coalesce(F.max("table_sha256"), empty).alias("table_sha256"))


def differing_nodes(one: DataFrame, two: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Where two trees differ, read from the roots down: ``(*group, level, prefix, row_count, other_row_count)``.

    Below a node that agrees nothing is read. A differing node is reported if no child of it is compared further: a leaf,
    or a node that one of the trees does not have or does not split. A missing node has no count.
    """
    group, found = list(group), None
    keys = [*group, "prefix"]
    deepest = max((t.agg(F.max("level")).first()[0] or 0) for t in (one, two))
    parents = None
    for level in range(deepest + 1):
        sides = [t.where(F.col("level") == level).select(*keys, F.col("row_count").alias(f"n_{i}"), F.col("node_sha256").alias(f"h_{i}")) for i, t in enumerate((one, two))]
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        if parents is not None:
            under = [F.col(f"s.{g}").eqNullSafe(F.col(f"p.{g}")) for g in group] + [F.substring("s.prefix", 1, level - 1) == F.col("p.prefix")]
            sides = [s.alias("s").join(parents.alias("p"), under, "left_semi") for s in sides]
        both = sides[0].alias("a").join(sides[1].alias("b"), same, "full_outer").where(~F.col("h_0").eqNullSafe(F.col("h_1")))
        here = materialise(both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], "n_0", "n_1"))
        rows = here.select(*group, F.lit(level).alias("level"), "prefix", F.col("n_0").alias("row_count"), F.col("n_1").alias("other_row_count"))
        if found is None:
            found = rows
        else:
            # A parent both trees split gives way to its children.
            parent = F.substring("c.prefix", 1, level - 1)
            split = [F.col(f"f.{g}").eqNullSafe(F.col(f"c.{g}")) for g in group] + [F.col("f.prefix") == parent, F.col("f.level") == level - 1]
            found = materialise(found.alias("f").join(here.alias("c"), split, "left_anti").unionByName(rows))
        if not here.limit(1).count():
            break
        parents = here
    return found
