"""Spaced-seed overlaps with the holdout against brute force."""

import itertools
import random
import re

from tidegauge.llm import seeds


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(events, holdout, k=12, similarity=0.8):
    out = {}
    for (e, text), (h, item) in itertools.product(events, holdout):
        t, q = words(text), words(item)
        if len(q) < 5:
            if q and t == q:
                out[e, h] = max(out.get((e, h), (0, 0, 0)), (1.0, len(q), len(q)))
            continue
        size = min(k, len(q))
        need = size if size < k else -(-round(similarity * k * 1000) // 1000)
        for shift in range(-len(q) + 1, len(t)):
            same = [0 <= i + shift < len(t) and t[i + shift] == q[i] for i in range(len(q))]
            for at in range(len(q) - size + 1):
                n = sum(same[at:at + size])
                if n >= need:
                    old = out.get((e, h), (0, 0, 0))
                    out[e, h] = max(old, (n / size, size, n))
    return {(e, h, size, n, s) for (e, h), (s, size, n) in out.items()}


def test_masks_find_every_twelve_with_two_substitutions():
    ones = [[i for i, c in enumerate(m) if c == "1"] for m in seeds.MASKS]
    for n, k in ((12, 2), (12, 1), (12, 0), (15, 3)):
        for changed in itertools.combinations(range(n), k):
            assert any(not {o + i for i in m} & {*changed} for m in ones for o in range(n - m[-1]))


def make(seed=11):
    rng = random.Random(seed)
    vocabulary = [f"term{i}" for i in range(60)] + ["über", "été"]
    holdout = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([40, 25, 13, 12, 11, 7, 5, 4, 60, 18])]
    events = []
    for e in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        if e % 2:
            item = words(rng.choice(holdout)[1])
            a, b = sorted((rng.randrange(len(item)), len(item)))
            part = item if e % 4 == 1 else item[a:b]
            part = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.1, 0.2]) else w for w in part]
            at = rng.randrange(len(own) + 1)
            own[at:at] = part
        events.append((e, ", ".join(own).title() + "."))
    events += [(100, None), (101, ""), (None, holdout[1][1]), (102, holdout[0][1] + " x " + holdout[0][1]), (102, holdout[2][1]), (102, holdout[2][1])]
    events += [(103, "Two, words."), (104, "two words more"), (105, "one"), (106, holdout[7][1]), (107, "one one"), (None, "two words")]
    holdout += [(60, "two words"), (61, "ONE"), (61, "one two three four five six"), (50, None), (51, ""), (None, holdout[8][1]), (3, holdout[9][1])]
    return events, holdout


def test_equal_to_brute_force(spark):
    events, holdout = make()
    e = spark.createDataFrame([(*r, "x") for r in events], "event_id long, raw_text string, seed string")
    h = spark.createDataFrame([(*r, "x") for r in holdout], "holdout_id long, raw_text string, words string")
    out = seeds.overlaps(e, h)
    got = {tuple(r) for r in out.collect()}
    assert got == brute(events, holdout) and out.count() == len(got) and len(got) > 20


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    events, holdout = make(4)
    e = spark.createDataFrame(events, "event_id long, raw_text string")
    h = spark.createDataFrame(holdout, "holdout_id long, raw_text string")
    monkeypatch.setattr(seeds, "MAX_BROADCAST", 3)
    assert {tuple(r) for r in seeds.overlaps(e, h).collect()} == brute(events, holdout)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "event_id long, raw_text string")
    h = spark.createDataFrame([(1, "a b c d e f g")], "holdout_id long, raw_text string")
    assert seeds.overlaps(e, h).count() == 0
    assert seeds.overlaps(h.withColumnRenamed("holdout_id", "event_id"), e.withColumnRenamed("event_id", "holdout_id")).count() == 0


def test_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(20))
    e = spark.createDataFrame([(1, "filler " * 300000 + item), (2, "filler " * 300000)], "event_id long, raw_text string")
    out = seeds.overlaps(e, spark.createDataFrame([(7, item)], "holdout_id long, raw_text string")).collect()
    assert [tuple(r) for r in out] == [(1, 7, 12, 12, 1.0)]


def test_one_word_repeated_very_often(spark):
    """As many alignments as words: they agree in the same places and are compared once."""
    e = spark.createDataFrame([(1, "la " * 100000), (2, "la " * 20 + "le"), (3, "le " * 50000 + "la " * 7)], "event_id long, raw_text string")
    h = spark.createDataFrame([(7, "la " * 40), (8, "le " * 6 + "la " * 6), (9, "la")], "holdout_id long, raw_text string")
    got = {tuple(r) for r in seeds.overlaps(e, h).collect()}
    assert got == {(1, 7, 12, 12, 1.0), (2, 7, 12, 12, 1.0), (3, 8, 12, 12, 1.0)}
