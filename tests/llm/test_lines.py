"""Line bitmaps of captures against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidegauge.llm import lines


def brute(rows, min_chars=20, min_events=3):
    holders = defaultdict(set)
    blanks = " \t\n\x0b\x0c\r"
    lower = {c: c + 32 for c in range(65, 91)}
    for event_id, text in rows:
        for line in (text or "").split("\n"):
            holders[line.strip(blanks).translate(lower)].add(event_id)
    out = set()
    for event_id, text in rows:
        kept = []
        every = (text or "").split("\n")
        for line in every:
            key = line.strip(blanks).translate(lower)
            ids = holders[key]
            top = max((i for i in ids if i is not None), default=None)
            if len(key) < min_chars or len(ids) < min_events or event_id == top:
                kept.append(line)
        out.add((event_id, len(every), len(every) - len(kept), "\n".join(kept)))
    return out


def rows_of(seed):
    rng = random.Random(seed)
    pool = [f"Shared line number {i} of the notice" for i in range(12)] + ["ü" * 20, "ü" * 19, "é" * 10 + "x" * 9, "short"]
    hot = "This line is on every page of the source"
    rows = []
    for i in range(150):
        own = [rng.choice(pool) for _ in range(rng.randrange(6))]
        own = [rng.choice([x, x.upper(), "  " + x + "\t", x + "\r"]) for x in own]
        rows.append((i, "\n".join([hot, *own, f"own line of event {i} only", ""])))
    return rows + [(200, None), (201, ""), (202, "\n\n"), (None, hot), (None, hot + "\n" + pool[0]), (149, hot), (149, hot),
                   (203, "\n".join([hot] * 5000))]


@pytest.mark.parametrize("partitions", ["1", "4", "23"])
def test_equal_to_brute_force(spark, partitions):
    rows = rows_of(int(partitions))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "x", None) for r in rows], "event_id long, raw_text string, body string, n_lines int")
        maps = lines.keep_bitmaps(df)
        assert maps.count() == len({(e, t or "") for e, t in rows})
        got = [(r.record.event_id, r.n_lines, r.n_dropped, r.kept_text) for r in lines.apply_bitmaps(df, maps).collect()]
        assert len(got) == len(rows) and set(got) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bitmap_is_packed_bits(spark):
    rows = [(i, "keep me\nthe same long line in all of them") for i in range(3)]
    got = {r.event_id: r for r in lines.keep_bitmaps(spark.createDataFrame(rows, "event_id long, raw_text string")).collect()}
    assert [got[i].n_dropped for i in range(3)] == [1, 1, 0]
    assert np.unpackbits(np.frombuffer(zlib.decompress(got[0].keep_bitmap), np.uint8), count=2).tolist() == [1, 0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "event_id string, raw_text string")
    assert lines.keep_bitmaps(df).count() == 0
