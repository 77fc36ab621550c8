"""Merkle digests against a tree built by hand."""

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import digest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(rows, leaf_rows):
    """Root, count and leaves of ``rows``, dictionaries of one group."""
    lines = Counter(sha(json.dumps(r, sort_keys=True, separators=(",", ":"))) for r in rows)
    depth = 0
    while len(rows) > leaf_rows * 16**depth:
        depth += 1
    nodes = {}
    for d in sorted(lines):
        nodes.setdefault(d[:depth], []).append(f"{d}:{lines[d]}")
    nodes = leaves = {p: sha("|".join(["leaf", *entries])) for p, entries in nodes.items()}
    for level in range(depth - 1, -1, -1):
        above = {}
        for p in sorted(nodes):
            above.setdefault(p[:level], []).append(f"{p}:{nodes[p]}")
        nodes = {p: sha("|".join(["node", *entries])) for p, entries in above.items()}
    return nodes[""], len(rows), leaves


@pytest.fixture(autouse=True)
def small_leaves(monkeypatch):
    monkeypatch.setattr(digest, "LEAF_ROWS", 4)


def rows_of(n):
    return [{"a": i % 90, "b": f"text {i % 45}", "c": None} for i in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(r["a"], r["b"], r["c"]) for r in rows], "a int, b string, c string").repartition(parts)


@pytest.mark.parametrize("n", [1, 4, 5, 64, 65, 1500])
def test_root_equals_the_tree_built_by_hand(spark, n):
    root, count, _ = by_hand(rows_of(n), 4)
    for parts in (1, 7):
        assert digest.table_digest(frame(spark, rows_of(n), parts)).collect() == [(count, root)]


def test_groups_have_trees_of_their_own(spark):
    rows = [(None if i % 5 == 0 else i % 5, i) for i in range(150)] + [(9, 1)]
    got = {r.g: (r.row_count, r.table_sha256) for r in digest.table_digest(spark.createDataFrame(rows, "g int, v int"), ["v"], ["g"]).collect()}
    assert got == {g: by_hand([{"v": v} for h, v in rows if h == g], 4)[1::-1] for g in {g for g, _ in rows}}


def test_two_trees_name_the_leaf_that_differs(spark):
    rows = rows_of(80)
    tree = digest.merkle_tree(frame(spark, rows))
    assert digest.differing_nodes(tree, digest.merkle_tree(frame(spark, rows, 1))).count() == 0
    changed = [*rows[:-1], rows[-1] | {"b": "forged"}]
    want = {p for p, h in (by_hand(rows, 4)[2].items() ^ by_hand(changed, 4)[2].items())}
    found = digest.differing_nodes(tree, digest.merkle_tree(frame(spark, changed)))
    assert {r.prefix for r in found.collect()} == want and 1 <= len(want) <= 2


def test_an_exchange_of_digest_slices_is_noticed(spark, monkeypatch):
    """Two row digests that swap their middle sixty bits keep all sums of slices, but not the tree."""
    one, two = sha("one"), sha("two")
    swapped = [one[:15] + two[15:30] + one[30:], two[:15] + one[15:30] + two[30:]]
    monkeypatch.setattr(digest, "row_digest", lambda columns: F.col("d"))
    roots = {digest.table_digest(spark.createDataFrame([(d,) for d in pair], "d string")).first().table_sha256 for pair in ([one, two], swapped)}
    assert len(roots) == 2


def test_trees_of_different_depth_and_empty_tables(spark):
    small, large = digest.merkle_tree(frame(spark, rows_of(3))), digest.merkle_tree(frame(spark, rows_of(70)))
    found = digest.differing_nodes(small, large).collect()
    assert {r.level for r in found} == {2} and sum(r.other_row_count for r in found) == 70
    none = spark.createDataFrame([], "a int, b string, c string")
    assert digest.merkle_tree(none).count() == 0 and digest.table_digest(none).collect() == [(0, sha("leaf"))]
    assert [(r.prefix, r.row_count, r.other_row_count) for r in digest.differing_nodes(small, digest.merkle_tree(none)).collect()] == [("", 3, None)]
