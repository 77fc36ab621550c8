"""Inverted multi-index against brute force."""

import numpy as np

from tidegauge.llm import vectors


def brute(rows, at_least=0.95):
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    label, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= at_least:
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    ids = {}
    for (i, _), x in zip(rows, label):
        ids[x] = min([v for v in (ids.get(x), i) if v is not None], default=None)
    return [(i, n, ids[x], i == ids[x]) for (i, _), n, x in zip(rows, links, label)]


def make(n=260, d=24, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.standard_normal(d)
        rows.append((i * 10, base.tolist()))
        if i % 5 == 0:
            for k in range(int(rng.integers(1, 9))):
                rows.append((i * 10 + 1 + k, (base * rng.uniform(0.5, 2) + rng.standard_normal(d) * rng.uniform(0, 0.25)).tolist()))
        if i % 50 == 0:
            rows += [(5000 + i * 10 + k, base.tolist()) for k in range(6)]
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "clash", 3) for i, v in rows], "vector_id long, vector array<double>, node string, links int").repartition(3)
    return [tuple(r) for r in vectors.groups(df, **options).collect()]


def test_recall_and_no_false_link(spark):
    rows = make()
    got = {r[0]: r for r in run(spark, rows)}
    expected = brute(rows)
    assert len(got) == len(rows)
    assert all(got[i][1] <= n for i, n, _, _ in expected)
    assert sum(r[1] for r in got.values()) >= 0.97 * sum(n for _, n, _, _ in expected) > 100
    assert sum(got[i][2] == c for i, _, c, _ in expected) >= 0.98 * len(rows)
    assert all(r[3] == (r[0] == r[2]) for r in got.values())


def test_a_dense_group_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MEMBERS", 16)
    monkeypatch.setattr(vectors, "QUERIES", 24)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(8)
    rows = [(i, (base + rng.standard_normal(8) * 0.22).tolist()) for i in range(120)]
    got, expected = sorted(run(spark, rows)), sorted(brute(rows))
    assert [r[2:] for r in got] == [r[2:] for r in expected]
    assert all(g[1] <= e[1] for g, e in zip(got, expected))
    assert sum(g[1] for g in got) >= 0.99 * sum(e[1] for e in expected) > 1000


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]),
            (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [3.0]), (12, [5.0]), (13, [-5.0]), (7, [1.0, 0.0])]
    assert sorted(run(spark, rows), key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    a, b = rng.random(7), rng.random(9)
    got = [(i, j) for i, j, _ in vectors.multi_sequence(a, b, 1.1)]
    every = sorted((a[i] + b[j], i, j) for i in range(7) for j in range(9) if a[i] + b[j] <= 1.1)
    assert got == [(i, j) for _, i, j in every]
