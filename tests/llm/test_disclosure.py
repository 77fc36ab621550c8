"""Personal data spans and disclosing terms against a plain computation."""

import math
import random
import re
from collections import defaultdict

from tidegauge.llm import disclosure

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def plain(rows, threshold=0.9, support=2):
    """All spans per row index; rows that repeat an id and text count once."""
    held, together, with_term = defaultdict(set), defaultdict(set), defaultdict(int)
    firsts = {}
    for i, row in enumerate(rows):
        firsts.setdefault((row[0], row[1] or ""), i)
    for i in firsts.values():
        text = rows[i][1] or ""
        words = set(re.findall(r"[^\W_]+", text.lower()))
        for w in words:
            with_term[w] += 1
        entities = {(k, re.sub("[^0-9]", "", text[a:b]) if k in ("card", "phone") else text[a:b].lower()) for k, a, b in base_spans(text)}
        for entity in entities:
            held[entity].add(i)
            for w in words:
                together[entity, w].add(i)
    n, out = len(firsts), [base_spans(t) for _, t in rows]
    terms = defaultdict(set)
    for (entity, w), where in together.items():
        f = len(held[entity])
        if len(where) >= support and f < n and math.log(len(where) * n / (f * with_term[w])) / math.log(n / f) >= threshold - 1e-12:
            for i, (event_id, text) in enumerate(rows):
                if firsts[event_id, text or ""] in where:
                    terms[i].add(w)
    for i, words in terms.items():
        base = list(out[i])
        for m in re.finditer(r"[^\W_]+", rows[i][1]):
            if m.group().lower() in words and not any(a < m.end() and m.start() < b for _, a, b in base):
                out[i].append(("term", m.start(), m.end()))
    return out


def make():
    rng = random.Random(4)
    common = "the of and notice market price share total per cent board said".split()
    rows = []
    for i in range(80):
        words = [rng.choice(common) for _ in range(rng.randrange(5, 40))]
        if i % 4 == 0:
            who = i % 12
            words[2:2] = [f"Codename{who}", rng.choice(common), f"agent{who}@mail.example.com,", "4111 1111 1111 1111", f"+1 (555) 010-99{who:02}"]
            words.append(rng.choice([f"codename{who}", f"{who}7777"]))
        rows.append((i, " ".join(words)))
    odd = [
        "x 300.1.2.3 10.0.0.255 1.2.3.4.5.6.7.8 0001.02.3.4", "a@b.c+d@e.f a..b@c..d @x.y q@w .@a.b-", "1-1-1 4111-1111-1111-1111-0 4111  1111",
        "é ü 😀 mail: ünï@ex.org user@ex.org😀 +44 20 7946 0958. 😀 10.1.1.1", "+1234567890123456 +12345678 +1((((((((  5", "9" * 5000 + " " + "a" * 5000 + "@",
        "a@b" + ".c" * 3000 + " " + "1 " * 4000, "", None, "\n\t10.0.0.1\n", "4111111111111111@ex.com 10.10.10.10@ex.com"]
    return rows + [(100 + i, t) for i, t in enumerate(odd)] + [(None, "a@b.cd"), (3, rows[4][1]), (4, rows[4][1]), (200, "word " * 100000 + "z@y.xw")]


def test_equal_to_a_plain_computation(spark):
    rows = make()
    rows += [rows[8], rows[20], rows[20]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "event_id long, raw_text string, body string, kind int")
    got = defaultdict(list)
    for r in disclosure.sanitise(df).collect():
        got[r.event_id].append([(s.kind, s.start, s.stop) for s in r.spans])
    expected = defaultdict(list)
    order = [*disclosure.KINDS, "term"]
    for (event_id, _), spans in zip(rows, plain(rows)):
        expected[event_id].append(sorted(spans, key=lambda s: (order.index(s[0]), s[1])))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    assert sum(s[0] == "term" for v in got.values() for spans in v for s in spans) > 20


def test_text_is_sanitised(spark):
    rows = [(i, f"Falcon42 wrote to a{i % 2}@b.cd about 77123 and falcon42 again") for i in range(2)] + [(9, None), (10, "nothing here")]
    rows += [(20 + i, "the about and again to wrote") for i in range(30)]
    out = {r.event_id: r.sanitised_text for r in disclosure.sanitise(spark.createDataFrame(rows, "event_id long, raw_text string")).collect()}
    assert "a0@b.cd" not in out[0] and "[EMAIL]" in out[0] and out[9] == "" and out[10] == "nothing here"
    rows = [(i, "Falcon42 wrote to me@b.cd about 77123 and falcon42 again") for i in range(3)] + rows[2:]
    out = {r.event_id: r.sanitised_text for r in disclosure.sanitise(spark.createDataFrame(rows, "event_id long, raw_text string")).collect()}
    assert out[0] == "[NAME] wrote to [EMAIL] about [NUMBER] and  again"


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "x@y.zz"), (1, "x@y.zz"), (2, "x@y.zz other")]
    out = disclosure.sanitise(spark.createDataFrame(rows, "event_id long, raw_text string")).collect()
    assert sorted((r.event_id, len(r.spans)) for r in out) == [(1, 1), (1, 1), (2, 1)]
    assert disclosure.sanitise(spark.createDataFrame([], "event_id long, raw_text string")).count() == 0


def test_terms_are_placed_in_cut_texts_only(spark, tmp_path):
    rows = [(i, f"falcon{i % 3} met a{i % 3}@b.cd") for i in range(9)] + [(20 + i, "nothing here") for i in range(30)]
    spark.createDataFrame(rows, "event_id long, raw_text string").write.parquet(f"{tmp_path}/events")
    out = disclosure.sanitise(spark.read.parquet(f"{tmp_path}/events"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[event_id#\d+L?,raw_text#\d+\]", plan)) == 1
    assert sum(s.kind == "term" and s.value.startswith("falcon") for r in out.collect() for s in r.spans) == 9


def test_addresses_before_dots(spark):
    texts = ["Mail bob@example.com. Now", "bob@a.b..c", "bob@example.com...", "c@d.ef.", "a@b.c.@d.e", "a@b.c..@d.e.f. x@y.z.", "q@w. a@.b a@b..c",
             "a@b" + ".c" * 3000 + ".", "me@b.cd.\nyou@b.cd, 10.0.0.1.", "a@b.c+d@e.f."]
    df = spark.createDataFrame(list(enumerate(texts)), "event_id long, raw_text string")
    got = {r.event_id: r for r in disclosure.sanitise(df).collect()}
    assert {i: [(s.kind, s.start, s.stop) for s in r.spans] for i, r in got.items()} == {i: base_spans(t) for i, t in enumerate(texts)}
    assert got[0].sanitised_text == "Mail [EMAIL]. Now" and got[2].sanitised_text == "[EMAIL]..."
