"""Whitening against numpy on centred rows."""

import numpy as np
import pytest

from tidegauge.llm import queries, whitening

NAN, INF = float("nan"), float("inf")


def plain(x, k):
    """Deviation, components, shares of variance."""
    x = [[int(v) for v in row] for row in x]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x]
    c = np.array(x, float) - np.array(sums, float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:k]
    return deviation, c @ u[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def check(rows, x, ids, k):
    deviation, scores, shares = plain(x, k)
    got = {(r[0], r.component): r for r in rows}
    assert len(got) == len(rows) == len(x) * k
    for j in range(k):
        mine = np.array([got[i, j + 1].whitened for i in ids])
        sign = 1 if mine @ scores[:, j] > 0 else -1
        assert np.allclose(mine, sign * scores[:, j], rtol=1e-7, atol=1e-7)
        assert {got[i, j + 1].explained for i in ids} == {got[ids[0], j + 1].explained}
        assert abs(got[ids[0], j + 1].explained / shares[j] - 1) < 1e-9
    assert all(int(got[i, 1].deviation) == d for i, d in zip(ids, deviation))
    assert all(r.n == len(x) and r.identity_error < 1e-9 for r in rows)


def numbers(n, d, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 300).astype(int) + 100_000


def test_snapshots_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 12 * 7)  # seven rows a block: many blocks over several partitions
    x = numbers(200, 12)
    rows = [(i, [int(v) for v in r], "clash", 1) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "security_code long, factor_values array<long>, index string, component int").repartition(6)
    check(whitening.whiten(df, 5).collect(), x, list(range(200)), 5)


def test_wide_snapshots_span_several_block_columns(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_COLS", 4)
    x = numbers(60, 10)
    df = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "security_code string, factor_values array<double>")
    check(whitening.whiten(df, 8).collect(), x, [str(i) for i in range(60)], 8)


def test_odd_rows(spark):
    x = numbers(30, 3)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [NAN, 1.0, 2.0]), (103, [1.0, INF, 2.0]), (104, []), (105, [1.0, 2.0])]
    rows += [(None, rows[0][1]), (7, rows[7][1])]  # no code; a repeated row
    got = whitening.whiten(spark.createDataFrame(rows, "security_code long, factor_values array<double>"), 8).collect()
    assert len(got) == 32 * 3 and {r.n for r in got} == {32}
    assert sorted((r.security_code, r.component) for r in got if r.security_code == 7) == [(7, 1), (7, 1), (7, 2), (7, 2), (7, 3), (7, 3)]
    assert sum(r.security_code is None for r in got) == 3


def test_directions_without_variance_give_no_row(spark):
    schema = "security_code long, factor_values array<long>"
    flat = whitening.whiten(spark.createDataFrame([(i, [i, 5, 2 * i]) for i in range(9)], schema)).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    assert whitening.whiten(spark.createDataFrame([(1, [4, 5])], schema)).count() == 0
    empty = whitening.whiten(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["security_code", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([("a", ["x"])], "security_code string, factor_values array<string>"))


def test_query_follows_its_contract(spark, tmp_path):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(80, 12)).astype(np.float32) / 3
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(vectors)] + [(900, [NAN] * 12, 0), (901, None, 0), (902, [None] + [0.0] * 11, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_whitening(spark, str(tmp_path))
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                          ("explained", "double"), ("identity_error", "double")]
    x = np.floor(vectors.astype(float) * 1024).astype(int) + 100_000
    check(got.collect(), x, list(range(80)), 8)
