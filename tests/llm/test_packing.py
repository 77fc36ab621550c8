"""Packed windows: exact round trip of every id, gapless offsets, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidegauge.llm import packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def ids_of(text, tokenizer=Tokenizer.from_file(JSON)):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, pieces, window):
    """Every id of every row in one piece; sequences gapless and not too long."""
    texts = defaultdict(list)
    for event_id, text in rows:
        texts[event_id].append(ids_of(text))
    cut = defaultdict(list)
    for p in pieces:
        cut[p[0]].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    expected = defaultdict(list)
    for event_id, lists in texts.items():
        for ids in lists:
            for at in range(0, len(ids), window):
                part = np.array(ids[at:at + window], "<u4")
                expected[event_id].append((at, len(part), zlib.crc32(part), len(ids)))
    assert {k: sorted(v) for k, v in cut.items()} == {k: sorted(v) for k, v in expected.items()}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= window
    return sum(p.length for p in pieces) / (len(sequences) * window)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["notice", "Été", "1 234", "the", "\n", "問題", "<|endoftext|>", "it's"]) for _ in range(rng.randrange(1, 400))))
            for i in range(n)]


def test_round_trip(spark):
    rows = rows_of(300) + [(900, None), (901, ""), (None, "no id"), (902, "same"), (902, "same"), (903, "long word " * 60000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "event_id long, raw_text string, start int, offset int").repartition(5)
    for ranks in (None, RANKS):
        filled = check(rows, packing.pack(df, JSON, ranks, window=1024).collect(), 1024)
        assert filled > 0.95
    assert check(rows, packing.pack(df, JSON, RANKS, window=64, open_windows=2).collect(), 64) > 0.6


def test_both_libraries_give_the_same_ids():
    texts = [t for _, t in rows_of(40)] + ["  two  blanks\t\ttabs \r\n", "İstanbul ǅ", "a" * 3000, "<|endoftext|><|endoftext|> x"]
    assert packing._encoder(JSON, RANKS)(texts) == packing._encoder(JSON, None)(texts)


def test_empty_table(spark):
    out = packing.pack(spark.createDataFrame([], "event_id string, raw_text string"), JSON, RANKS)
    assert out.count() == 0


def test_best_fit_emits_the_fullest_when_none_fits():
    names = iter(range(100))
    w = packing._Windows(10, 2, lambda: next(names))
    assert list(w.put(6, "a")) == [] and list(w.put(7, "b")) == []
    assert list(w.put(3, "c")) == [(0, 0, "b", 7), (0, 7, "c", 3)]  # best fit fills b's window
    assert list(w.put(8, "d")) == []
    assert list(w.put(9, "e")) == [(1, 0, "d", 8)]  # none fits: the fullest goes
    assert sorted(w.close()) == [(2, 0, "a", 6), (3, 0, "e", 9)]
