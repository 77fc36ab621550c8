"""SimHash groups of source events against brute force."""

import numpy as np
import xxhash

from tidegauge.llm import simhash


def brute(rows, shingle=3, radius=3):
    prints = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    ids = {}
    for (e, _), x in zip(rows, label):
        ids[x] = min([v for v in (ids.get(x), e) if v is not None], default=None)
    return sorted(((e, p, ids[x]) for (e, _), p, x in zip(rows, prints, label)), key=str)


def texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["İé", "ÄÖ"]
    rows = []
    for i in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 200))))
        rows.append((i * 3, " ".join(words)))
        if i % 4 == 0:
            words[len(words) // 2] = "changed"
            rows.append((i * 3 + 1, "\t".join(words).upper()))
        if i % 7 == 0:
            rows.append((i * 3 + 2, rows[-1][1]))
    return rows + [(500, None), (501, ""), (502, " \n "), (503, "one"), (504, "ONE"), (None, "one two"), (505, "one two"), (505, "one two"), (506, "word " * 30000)]


def test_groups_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "event_id long, raw_text string, fingerprint string, label int")
    got = sorted(((r.event_id, r.fingerprint % 2**64, r.component_id) for r in simhash.groups(df).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    out = simhash.groups(spark.createDataFrame([], "event_id long, raw_text string"))
    assert out.count() == 0 and out.columns == ["event_id", "fingerprint", "component_id", "group", "body"]


def test_one_text_of_each_group_stays(spark):
    rows = texts()
    grouped = simhash.groups(spark.createDataFrame(rows, "event_id long, raw_text string"))
    kept = simhash.representatives(grouped).collect()
    assert len(kept) == grouped.select("group").distinct().count()
    assert {r.event_id for r in kept} == {c for _, _, c in brute(rows)}


def test_links_between_finds_every_component():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (400, 4)).astype(np.uint64)
    near = base ^ np.bitwise_xor.reduce(flips, axis=1)
    prints = np.unique(np.concatenate([base, base ^ flips[:, 0], base ^ flips[:, 0] ^ flips[:, 1], near]))
    found = simhash.links_between(prints, prints, 3)
    parent = {int(p): int(p) for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found.tolist():
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {int(p): root(int(p)) for p in prints}
    parent = {int(p): int(p) for p in prints}
    for a in prints.tolist():
        for b in prints.tolist():
            if a < b and (a ^ b).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {int(p): root(int(p)) for p in prints}
