"""Compression language identification: held-out accuracy and defined odd cases."""

import random
import zlib

from tidegauge.llm import language

SYLLABLES = {
    "en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "fr": "es le de en re nt on er ou ai ie qu la me te is an it ur ne se et il ç é è au eu oi".split(),
    "de": "en er ch de ei ie in te ge nd un st sch be ü ä ö ß ung lich keit ver zu auf heit".split(),
}


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[name]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 300))]
        rows.append((i, " ".join(words), name))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "event_id long, raw_text string, language string")
    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    model = language.fit(spark.createDataFrame(taught, df.schema))
    found = {r.record.event_id: r for r in language.predict(df, model).collect()}
    unseen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(unseen) > 40
    assert sum(found[i].predicted_language == name for i, _, name in unseen) / len(unseen) > 0.97
    assert all(0 <= r.margin <= 1 for r in found.values())
    assert sum(found[i].rejected for i, _, _ in unseen) / len(unseen) < 0.03


def test_odd_rows(spark):
    model = language.fit(spark.createDataFrame(corpus(), "event_id long, raw_text string, language string"))
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 345 !!", "x"), (None, "the", None), (5, "then " * 200000, "y"), (5, "then " * 200000, "y")]
    out = language.predict(spark.createDataFrame(rows, "event_id long, raw_text string, predicted_language string"), model).collect()
    assert [r.predicted_language for r in out[:3]] == ["und"] * 3 and all(r.rejected for r in out[:3])
    assert out[3].predicted_language in SYLLABLES and not out[3].rejected
    assert out[4].predicted_language == out[5].predicted_language == "en"
    assert out[0].record.predicted_language == "x"


def test_blend_is_rejected_when_the_margin_is_narrow(spark):
    rows = corpus()
    model = language.fit(spark.createDataFrame(rows, "event_id long, raw_text string, language string"))
    out = language.predict(spark.createDataFrame([(1, rows[0][1])], "event_id long, raw_text string"), model, min_margin=0.99).first()
    assert out.rejected and out.predicted_language == rows[0][2]


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([(1, None, "en"), (2, "text", None)], "event_id long, raw_text string, language string")
    model = language.fit(empty)
    assert model == {}
    assert [r.predicted_language for r in language.predict(empty, model).collect()] == ["und", "und"]
    assert language.predict(empty.limit(0), model).count() == 0
    one = language.fit(spark.createDataFrame([(1, "the only text", "en")], empty.schema))
    assert [(r.predicted_language, r.margin) for r in language.predict(empty, one).collect()] == [("und", 0.0), ("en", 1.0)]
