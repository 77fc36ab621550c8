"""Near copies against brute-force Jaccard."""

import numpy as np
import pytest

import corpus_pipeline
from tidegauge.llm import copies, simhash


def grams(text, shingle=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def brute(rows, shingle=5, share=0.8):
    sets, label = [grams(t, shingle) for _, t in rows], list(range(len(rows)))
    for i, one in enumerate(sets):
        for j, two in enumerate(sets[:i]):
            if one == two or len(one & two) >= share * len(one | two):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    ids = {}
    for (e, _), x in zip(rows, label):
        ids[x] = min([v for v in (ids.get(x), e) if v is not None], default=None)
    return sorted(((e, ids[x]) for (e, _), x in zip(rows, label)), key=str)


def texts():
    """Copies with one to 30 changed words of 200, a chain of copies of copies, and one group of very many near copies."""
    rng = np.random.default_rng(6)
    fresh = iter(range(10**6))
    rows = []

    def changed(words, n):
        out = list(words)
        for at in rng.choice(len(out), n, replace=False):
            out[at] = f"new{next(fresh)}"
        return out

    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((i * 10, " ".join(words)))
        rows += [(i * 10 + k, " ".join(changed(words, int(rng.integers(1, 12)))).upper()) for k in range(1, 3)]
    chain = [f"c{x}" for x in range(200)]
    for i in range(12):
        rows.append((1000 + i, "\n".join(chain)))
        chain = changed(chain, 3)
    hot = [f"h{x}" for x in range(200)]
    rows += [(2000 + i, " ".join(changed(hot, 2 + i % 4))) for i in range(60)]
    return rows + [(3000, None), (3001, ""), (3002, " \n "), (3003, "one"), (3004, "ONE"), (None, "one two"), (3005, "one two"), (3005, "one two"),
                   (3006, "word " * 30000), (3007, "a b c d e f g h i j k l"), (3008, "a b c d e f g h i j k l m n")]


def test_groups_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "event_id long, raw_text string, content string, label int")
    got = sorted(((r.event_id, r.component_id) for r in copies.groups(df).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("name, value", [("FEW", 10**9), ("FEW", 0), ("PIVOTS", 1), ("FEW_PIVOTS", 0)])
def test_other_limits_give_the_same(spark, monkeypatch, name, value):
    monkeypatch.setattr(copies, name, value)
    rows = texts()
    got = copies.groups(spark.createDataFrame(rows, "event_id long, raw_text string")).collect()
    assert sorted(((r.event_id, r.component_id) for r in got), key=str) == brute(rows)


def test_stage_keeps_one_of_each_group(spark):
    """Copies at 0.8 and more go, and only those: documents of less in common stay."""
    rows = [(i, t, "en", "s", 1) for i, t in texts() if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, "").collect())
    assert kept == sorted({c for _, c in brute([r[:2] for r in rows])})


def test_empty_table(spark):
    out = copies.groups(spark.createDataFrame([], "event_id long, raw_text string"))
    assert out.count() == 0 and out.columns == ["event_id", "component_id", "group", "body"]


def test_a_large_group_takes_few_jobs(spark, monkeypatch):
    """Near copies of one text, a third of them too far from all others to link, are met in a few rounds."""
    monkeypatch.setattr(copies, "BLOCK", 100)
    rng = np.random.default_rng(2)
    base, rows = [f"b{x}" for x in range(200)], []
    for i in range(900):
        words = list(base)
        for at in rng.choice(200, 1 + i % 5, replace=False):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    spark.sparkContext.setJobGroup("copies", "copies")
    found = copies.groups(spark.createDataFrame(rows, "event_id long, raw_text string").repartition(4))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("copies"))
    spark.sparkContext.setJobGroup("rest", "rest")
    want = brute(rows)
    assert sorted(((r.event_id, r.component_id) for r in found.collect()), key=str) == want and 100 < len({c for _, c in want}) and jobs < 150


def test_fingerprints_propose_copies(spark):
    """Contents whose fingerprints link share a key though they share no minimum; their Jaccard still decides."""
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 5000, 2000)]
    often = "a " * 400
    rows = [(1, often + "b c d e f"), (2, often + "g h i j k"), (3, " ".join(words)), (4, " ".join([*words[:-1], "other"]))]
    classes = spark.createDataFrame(
        [(str(i).encode(), {"keys": [], "fingerprint": int(np.uint64(simhash.fingerprint(t.encode(), 5)).view(np.int64))}) for i, t in rows],
        "content binary, made struct<keys: array<long>, fingerprint: long>")
    met = {}
    for r in copies._members(classes).collect():
        met.setdefault(r.key, set()).add(int(r.content))
    assert sorted(map(sorted, met.values())) == [[1, 2], [3, 4]]
    got = copies.groups(spark.createDataFrame(rows, "event_id long, raw_text string")).collect()
    assert sorted((r.event_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 3)]
