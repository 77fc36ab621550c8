"""The Kneser-Ney model against a plain in-memory one, and its scores on unseen texts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidegauge.llm import ngrams


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["</s>"]


class Plain:
    """Interpolated modified Kneser-Ney with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = {k: Counter() for k in range(1, order + 1)}
        for text in texts:
            t = ["<s>"] * (order - 1) + words(text)
            for i in range(order - 1, len(t)):
                self.counts[order][tuple(t[i - order + 1:i + 1])] += 1
        self.raw = Counter()
        for gram, n in self.counts[order].items():
            self.raw[gram[-1]] += n
        for k in range(order - 1, 0, -1):
            for gram in self.counts[k + 1]:
                self.counts[k][gram[1:]] += 1
        self.contexts = {k: defaultdict(list) for k in range(1, order + 1)}
        for k in self.counts:
            for gram, n in self.counts[k].items():
                self.contexts[k][gram[:-1]].append(n)
        self.d = {}
        for k in self.counts:
            t = [sum(n == i for n in self.counts[k].values()) for i in range(5)]
            if t[1] and t[2] and t[3]:
                y = t[1] / (t[1] + 2 * t[2])
                self.d[k] = [0] + [min(max(i - (i + 1) * y * t[i + 1] / t[i], 0), i) for i in (1, 2, 3)]
            else:
                self.d[k] = [0, 0.5, 0.75, 0.9]

    def p(self, gram):
        lower = self.p(gram[1:]) if len(gram) > 1 else 1 / (len(self.counts[1]) + 1)
        follows = self.contexts[len(gram)].get(gram[:-1])
        if not follows:
            return lower
        d, n = self.d[len(gram)], self.counts[len(gram)][gram]
        return (n - d[min(n, 3)]) / sum(follows) + sum(d[min(c, 3)] for c in follows) / sum(follows) * lower

    def score(self, text):
        t = ["<s>"] * (self.order - 1) + words(text)
        grams = [tuple(t[i - self.order + 1:i + 1]) for i in range(self.order - 1, len(t))]
        n, v = sum(self.raw.values()), len(self.raw)
        return (len(grams), sum(self.raw[g[-1]] > 0 for g in grams),
                sum(math.log10((self.raw[g[-1]] + 0.5) / (n + 0.5 * (v + 1))) for g in grams), sum(math.log10(self.p(g)) for g in grams))


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["Été", "ÜBER", "x" * 300]
    out = []
    for _ in range(n):
        t, w = [], 0
        for _ in range(rng.randrange(0, 60)):
            w = (w * 7 + rng.choice([1, 2, 3])) % len(vocabulary) if rng.random() < 0.8 else rng.randrange(len(vocabulary))
            t.append(rng.choice([str.upper, str.lower])(vocabulary[w]))
        out.append(rng.choice([" ", "\n", " \t "]).join(t))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_equal_to_a_plain_model(spark, order):
    taught = texts(150, 1) + [None, "", "the same text twice", "the same text twice"]
    unseen = texts(40, 2) + [None, "", " \n", "never met words", "w1 " * 50000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(taught)], "event_id long, raw_text string, score string").repartition(3)
    model = ngrams.fit(spark, df, order)
    plain = Plain(taught, order)
    assert model.train_tokens == sum(plain.raw.values()) and model.vocabulary == len(plain.raw)
    rows = list(enumerate(unseen)) + [(None, "w1 w2")]
    got = {r.event_id: r for r in ngrams.score(spark.createDataFrame(rows, "event_id long, raw_text string"), model).collect()}
    for event_id, text in rows:
        r = got[event_id]
        assert (r.n_tokens, r.n_known) == plain.score(text)[:2]
        assert np.allclose((r.base_score, r.score), plain.score(text)[2:], rtol=1e-9, atol=1e-9)
        assert np.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens))
    assert sum(got[i].score for i in range(40)) > sum(got[i].base_score for i in range(40))


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "event_id long, raw_text string")
    model = ngrams.fit(spark, empty)
    assert (model.train_tokens, model.vocabulary) == (0, 0)
    out = ngrams.score(spark.createDataFrame([(1, "a b"), (2, None)], empty.schema), model).collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in out] == [(3, 0, 0, 0), (1, 0, 0, 0)]
    assert ngrams.score(empty, model).count() == 0


def test_words_are_cut_and_hashed_alike_wherever_they_stand(monkeypatch):
    rng = random.Random(0)
    raw = [" ".join(rng.choice(["ab", "b", "abc\t", "é", "q" * 70]) for _ in range(200)).encode() for _ in range(9)] + [None, b"", b"x" * 5000]
    whole = ngrams.token_hashes(raw)
    monkeypatch.setattr(ngrams, "SLICE_BYTES", 64)
    cut = ngrams.token_hashes(raw)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])
    assert whole[1].tolist() == [len((t or b"").split()) + 1 for t in raw]
    flat = [w for t in raw for w in [*(t or b"").split(), None]]
    assert len(set(whole[0].tolist())) == len(set(flat)) == len(set(zip(flat, whole[0].tolist())))
