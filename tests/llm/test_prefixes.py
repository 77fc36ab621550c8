"""The trie over request histories against a plain one; the query against the contract written out."""

import hashlib
import zlib
from collections import defaultdict

import pandas as pd
import pytest

from tidegauge.llm import prefixes, queries

COLUMNS = "route_id long, event_seq int, strategy_id string, requested_url string"


def brute(histories):
    """``{(smallest member, depth): row}`` of histories ``{id: [(strategy, url), ...]}``."""
    members = defaultdict(list)
    for i, steps in histories.items():
        for d in range(len(steps) + 1):
            members[tuple(steps[:d])].append(i)
    rows = {}
    for node, ids in members.items():
        below = [n for n in members if n[:len(node)] == node]
        ends = ",".join(str(i) for i in sorted(ids) if len(histories[i]) == len(node))
        rows[min(ids), len(node)] = (
            min(members[node[:-1]]) if node else None, len(ids), sum(len(n) == len(node) + 1 for n in below),
            sum(not any(len(m) == len(n) + 1 and m[:-1] == n for m in members) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest())
    assert len(rows) == len(members)
    return rows


def histories_of(rows):
    out = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out[r[0]].append((r[2] or "", r[3] or ""))
    return dict(out)


def rows_of(df):
    return {(r.route_id, r.depth): (r.parent_route_id, r.n_routes, r.n_children, r.n_leaves, r.saved_chars, r.ends_sha256) for r in df.collect()}


def attempts():
    """Many routes that open alike, copies of one long history, histories inside others, odd rows."""
    rows = []
    for i in range(300):
        depth = 1 + i % 7
        rows += [(i, d, "latest" if d % 2 else "archive", f"https://example.org/{(i // 3) % (d * d + 1)}/é") for d in range(depth)]
    for i in range(1000, 1080):
        rows += [(i, d, "copy", f"https://example.org/copy/{d}") for d in range(40)]
    rows += [(2000 + i, d, "copy", f"https://example.org/copy/{d}") for i in range(30) for d in range(i)]
    rows += [(-7, 3, None, None), (-7, None, "first", "u"), (-8, 1, "", ""), (3000, 1, "same", "x"), (3000, 1, "same", "x"), (None, 1, "lost", "y"),
             (3001, 1, "long", "z" * 200_000), (3002, 1, "long", "z" * 200_000)]
    return rows


def test_trie_equals_plain_version(spark, monkeypatch):
    rows = attempts()
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], COLUMNS + ", depth int, node_a string")
    named = [(i,) for i in (-9, -7, 5, 4000, None, 4000)]
    want = brute(histories_of(rows) | {-9: [], 4000: []})
    assert rows_of(prefixes.trie(df, spark.createDataFrame(named, "route_id long"))) == want
    # Shards of a few routes, over several partitions: the same nodes.
    monkeypatch.setattr(prefixes, "PART_ATTEMPTS", 400)
    monkeypatch.setattr(prefixes, "SHARD_ROUTES", 5)
    assert rows_of(prefixes.trie(df)) == brute(histories_of(rows))


def test_text_ids_ties_and_empty_tables(spark):
    rows = [("b", 1, "s", "u"), ("b", 1, "s", "v"), ("a", 2, "s", "v"), ("a", 2, "s", "u")]
    got = rows_of(prefixes.trie(spark.createDataFrame(rows, COLUMNS.replace("route_id long", "route_id string"))))
    assert {k: v[1] for k, v in got.items()} == {("a", 0): 2, ("a", 1): 2, ("a", 2): 2}
    assert got["a", 2][5] == hashlib.sha256(b"a,b").hexdigest()
    none = spark.createDataFrame([], COLUMNS)
    assert prefixes.trie(none).count() == 0
    only = rows_of(prefixes.trie(none, spark.createDataFrame([(3,)], "route_id long")))
    assert only == {(3, 0): (None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())}


@pytest.fixture(scope="module")
def turns(tmp_path_factory, spark):
    rows = [(c, t, "user" if t % 2 else None, f"turn {t} of {c % 4}" if (c + t) % 5 else None) for c in range(95, 330, 1) if c % 7 for t in range(c % 9)]
    rows += [(101, None, "system", "before all"), (200, 1, "user", "tie"), (None, 1, "user", "nobody"), (130, 50, "user", "late"), *((c, 1, "user", "short") for c in range(1, 20))]
    path = tmp_path_factory.mktemp("turns")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(path / "conversations.parquet"))
    return str(path), pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"], dtype=object)


def test_query_follows_its_contract(spark, turns):
    path, rows = turns
    own = defaultdict(list)
    for r in sorted((r for r in rows.itertuples(index=False) if r.conv_id is not None),
                    key=lambda r: (r.conv_id, r.turn is not None, r.turn or 0, r.role or "", r.text or "")):
        own[r.conv_id].append((r.role or "", r.text or ""))
    rebuilt = {c: own.get(c - c % 100, [])[:h] + steps[h:] for c, steps in own.items() for h in (zlib.crc32(str(c).encode()) % 6,)}
    assert any(not steps for steps in rebuilt.values())
    got = queries.op11_prefix_trie(spark, path)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for n, t in got.dtypes if n != "ends_sha256"} == {"bigint"}
    assert {(r[0], r[1]): tuple(r[2:]) for r in got.collect()} == brute(rebuilt)
