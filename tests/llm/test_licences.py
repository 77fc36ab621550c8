"""Licences of artifacts against a plain computation."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest

from tidegauge.llm import licences


def plain(rows, min_cosine=licences.MIN_COSINE):
    is_file = lambda p: p is not None and bool(re.search(licences.LICENCE_FILE, p))
    own_notices = {}
    for path, text in rows:
        own_notices.setdefault(path, []).extend(licences.notices(text or "", is_file(path)))
    vectors = {n: Counter(n.split()) for ns in own_notices.values() for n in ns}
    templates = [(name, Counter(licences.terms(t))) for name, t in licences.TEMPLATES]
    df = Counter(t for v in [*vectors.values(), *(v for _, v in templates)] for t in v)
    n = len(vectors) + len(templates)
    weigh = lambda v: {t: c * (math.log((n + 1) / (df[t] + 1)) + 1) for t, c in v.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def best(notice):
        v, out = weigh(vectors[notice]), []
        for i, (name, t) in enumerate(templates):
            w = weigh(t)
            cosine = round(sum(x * w.get(k, 0) for k, x in v.items()) / (norm(v) * norm(w)), 9)
            if cosine >= min_cosine:
                out.append((cosine, -i, name))
        return max(out, default=None)

    own = {}
    for path, ns in own_notices.items():
        hits = [b for b in map(best, ns) if b]
        if hits:
            own[path] = max((c, name) for c, _, name in hits)
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    decided = {}
    for path, (c, name) in own.items():
        if path is not None and is_file(path):
            key = "/".join(x for x in folder(path).split("/") if x)
            decided[key] = min(decided.get(key, (1, "")), (-c, path, name)) if key in decided else (-c, path, name)
    out = []
    for path, _ in rows:
        if path in own:
            out.append((path, own[path][1], own[path][0], "own", path))
            continue
        parts = [x for x in folder(path).split("/") if x] if path is not None else []
        hit = next((decided[k] for d in range(len(parts), -1, -1) if (k := "/".join(parts[:d])) in decided), None) if path is not None else None
        out.append((path, hit[2], -hit[0], "inherited", hit[1]) if hit else (path, None, None, None, None))
    return out


def make():
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("market close board notice share price the of".split()) for _ in range(n))
    full = [t for _, t in licences.TEMPLATES]
    rows = []
    for i in range(90):
        folder = "/".join(["raw", f"s{i % 4}", f"d{i % 3}", "deep"][: rng.randrange(0, 5)])
        text = "\n".join([prose(20), prose(30)])
        if i % 6 == 0:
            text += "\n" + rng.choice(full) + ("\n" + prose(8) if i % 12 else "")
        if i % 9 == 0:
            header = rng.choice(full).split(", ")
            text = "\n".join(["# " + h for h in header]) + "\n\n\n\n" + text
        name = rng.choice(["LICENSE", "COPYING.txt", "notice-1.md"]) if i % 11 == 0 else f"file{i}.csv"
        rows.append((f"{folder}/{name}" if folder else name, rng.choice(full) if i % 11 == 0 else text))
    return rows + [(None, full[0]), (None, None), ("raw/s1/empty.txt", ""), ("raw/s1/null.txt", None), ("raw/s1/empty.txt", "x"), ("//odd//LICENSE", full[3]),
                   ("odd/x", "y"), ("raw/all.txt", "All rights reserved of the long line " + prose(50)), ("deep/" * 60 + "f", "z"), ("big", prose(200000))]


def test_equal_to_a_plain_computation(spark):
    rows = make()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "artifact_path string, raw_text string, licence string, notice string").repartition(3)
    got = sorted((tuple(r) for r in licences.scan(df).collect()), key=str)
    expected = sorted(plain(rows), key=str)
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [(e[0], e[1], e[3], e[4]) for e in expected]
    assert [g[2] for g in got] == [pytest.approx(e[2], abs=1e-8) if e[2] else None for e in expected]
    assert Counter(g[3] for g in got)["inherited"] > 10 and Counter(g[3] for g in got)["own"] > 10


def test_every_template_is_itself(spark):
    rows = [(f"a{i}/f.txt", f"prose before\n{text}\nprose after") for i, (_, text) in enumerate(licences.TEMPLATES)]
    got = {r.artifact_path: r.licence for r in licences.scan(spark.createDataFrame(rows, "artifact_path string, raw_text string")).collect()}
    assert [got[f"a{i}/f.txt"] for i in range(len(rows))] == [name for name, _ in licences.TEMPLATES]


def test_empty_table(spark):
    assert licences.scan(spark.createDataFrame([], "artifact_path string, raw_text string")).count() == 0


def test_full_texts_are_found_and_inherited(spark):
    """Whole licence texts, also with a copyright line, other line breaks or a part cut off, and what lies beside them."""
    folder, rows, expected = Path(licences.__file__).parent / "licence_texts", [], {}
    for file in sorted(folder.glob("*.txt")):
        text, name = file.read_text(encoding="utf-8"), file.stem
        for kind, variant in (("as_is", text), ("owner", "Copyright (c) 2024 Example Holdings\n\n" + text), ("joined", " ".join(text.split())),
                              ("cut", text[: len(text) * 9 // 10])):
            path = f"{name}/{kind}"
            rows += [(f"{path}/{'LICENSE' if kind == 'as_is' else 'COPYING.txt'}", variant), (f"{path}/src/data.csv", "a,b\n1,2")]
            expected |= {rows[-2][0]: name, rows[-1][0]: name}
    prose = " ".join(f"market close share {i} price of the board" for i in range(400))
    rows += [("none/LICENSE", prose), ("none/x.csv", "a,b")]
    got = {r.artifact_path: r.licence for r in licences.scan(spark.createDataFrame(rows, "artifact_path string, raw_text string")).collect()}
    assert got == expected | {"none/LICENSE": None, "none/x.csv": None}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "MIT", "BSD-3-Clause", "ISC"} <= set(expected.values())
