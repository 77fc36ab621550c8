"""Removal of repeated strings against sets of windows."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import queries, repeats


def brute(rows, length):
    """``{(event_id, text): (removed spans, kept bytes)}``; texts in the order given."""
    seen, out = set(), {}
    for event, text in rows:
        raw = (text or "").encode()
        if (event, text or "") in out:
            continue
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            window = raw[i:i + length]
            if window in seen:
                gone[i:i + length] = True
            seen.add(window)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[event, text or ""] = ([(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])], bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


def compare(spark, rows, length, parts=5):
    df = spark.createDataFrame([(e, t, "clash", 7) for e, t in rows], "event_id long, raw_text string, body string, key int").repartition(parts)
    got = [(r.event_id, r.n_bytes, r.n_removed, [(s.start, s.stop) for s in r.removed_spans], bytes(r.kept_bytes)) for r in repeats.remove(df, length).collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    expected = brute(order, length)
    want = [(e, len((t or "").encode()), sum(b - a for a, b in expected[e, t or ""][0]), *expected[e, t or ""]) for e, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    return want


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(2, 9))) for _ in range(n))


def texts():
    """Passages that move, copies, near copies, texts that repeat themselves, runs of one byte, odd rows."""
    rng = np.random.default_rng(4)
    passages = [prose(rng, 40) for _ in range(5)]
    rows = [(i, " ".join([prose(rng, 15), passages[i % 5][i % 7:], prose(rng, 10), passages[(i + 1) % 5][:180 + i]])) for i in range(0, 60, 2)]
    rows += [(i + 1, t) for i, t in rows[:12]]
    for i in range(40):
        words = passages[0].split() + passages[1].split()
        words[int(rng.integers(len(words)))] = f"new{i}"
        rows.append((500 + i, " ".join(words)))
    own = prose(rng, 30)
    rows += [(900, own + own + own), (901, "a" * 3000), (902, "a" * 150 + "b" + "a" * 99), (903, "ab" * 700), (904, "é" * 900), (905, "x\0" * 80 + "\0" * 120)]
    rows += [(-3, passages[2]), (None, passages[3]), (910, None), (911, ""), (912, "short"), (913, "y" * 99), (914, passages[4]), (914, passages[4])]
    return rows


def test_removal_equals_brute_force(spark):
    want = compare(spark, texts(), 100)
    assert sum(len(w[3]) > 1 for w in want) > 10


def test_short_strings_small_pieces_and_common_grams(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLAB", 300)
    monkeypatch.setattr(repeats, "RUN", 7)
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    for length in (2, 3, 10, 70):
        compare(spark, texts(), length)


def test_long_repetitive_text(spark):
    out = repeats.remove(spark.createDataFrame([(1, "la " * 100_000), (2, "la " * 70_000), (3, "b" * 500_000)], "event_id long, raw_text string"))
    assert {(r.event_id, r.n_removed, len(r.kept_bytes)) for r in out.collect()} == {(1, 300_000 - 3, 3), (2, 210_000, 0), (3, 500_000 - 1, 1)}


def test_texts_of_one_id_share_its_place(spark):
    rng = np.random.default_rng(1)
    passage = prose(rng, 60)
    df = spark.createDataFrame([(1, passage), (1, passage + " end"), (2, passage)], "event_id long, raw_text string")
    got = {(r.event_id, r.n_bytes): r.n_removed for r in repeats.remove(df).collect()}
    n = len(passage.encode())
    assert got[2, n] == n and sorted([got[1, n], got[1, n + 4]]) == [0, n]


def test_text_ids_and_empty_table(spark):
    out = repeats.remove(spark.createDataFrame([("b", "z" * 120), ("a", "z" * 100)], "event_id string, raw_text string"))
    assert {(r.event_id, r.n_removed) for r in out.collect()} == {("a", 0), ("b", 120)}
    none = repeats.remove(spark.createDataFrame([], "event_id long, raw_text string"))
    assert none.count() == 0 and none.columns == ["event_id", "n_bytes", "n_removed", "removed_spans", "kept_bytes"]
    with pytest.raises(ValueError):
        repeats.remove(out, 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=40) | st.text("ab", max_size=60).map(str.encode), min_size=1, max_size=5), min_size=1, max_size=3), st.integers(1, 9))
def test_merged_transforms_give_the_repeated_windows(shards, length):
    made = [repeats.transform(fragments) for fragments in shards]
    for (before, heads), fragments in zip(made, shards):
        suffixes = sorted((f[p:], i, p) for i, f in enumerate(fragments) for p in range(len(f) + 1))
        assert [(f, p) for s, f, p in suffixes if p == 0] == [(i, 0) for i in np.argsort(heads)]
        assert [fragments[i][p - 1] for _, i, p in suffixes if p] == [int(b) for row, b in enumerate(before) if row not in set(heads.tolist())]
    counts = [np.array([max(0, len(f) - length + 1) for f in fragments]) for fragments in shards]
    group, fragment, position = repeats.repeated_windows(made, counts, length)
    flat = [f for fragments in shards for f in fragments]
    windows = {}
    for i, f in enumerate(flat):
        for p in range(len(f) - length + 1):
            windows.setdefault(f[p:p + length], set()).add((i, p))
    found = {}
    for g, i, p in zip(group.tolist(), fragment.tolist(), position.tolist()):
        found.setdefault(g, set()).add((i, p))
    assert sorted(map(sorted, found.values())) == sorted(sorted(w) for w in windows.values() if len(w) > 1)


def test_query_follows_its_contract(spark, tmp_path):
    rows = [r for r in texts() if r[0] is not None][:-1]
    spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_repeats(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    want = {(e, len(t.encode()), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for (e, t), (spans, kept) in brute(sorted(rows, key=lambda r: r[0]), 100).items()}
    assert {tuple(r) for r in got.collect()} == want
