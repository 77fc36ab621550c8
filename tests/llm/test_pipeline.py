"""The pipeline stage by stage against brute-force versions of each decision."""

import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm import test_copies, test_lines, test_packing, test_seeds
from tests.llm.test_language import corpus

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


def documents():
    rows = []
    for i, text, name in corpus(120):
        lines = [text, "This banner stands on very many of the pages", text[::-1]] if i % 3 == 0 else [text]
        rows.append((i, "\n".join(lines), name))
        if i % 10 == 0:
            rows.append((i + 1000, rows[-1][1].upper(), name))
    holdout = [(i, " ".join(f"item{i}word{j}" for j in range(30))) for i in range(4)]
    rows += [(2000 + i, rows[i][1] + " " + text, rows[i][2]) for i, text in holdout]
    rows += [(3000, None, "en"), (3001, "123 456", None), (3002, "", "en"), (3003, "Then.", "en"), (3004, "Then.", "en"), (3004, "Then.", "en"),
             (3005, "Then.", None)]
    return [(i, t, n, "s", len(t or "")) for i, t, n in rows], holdout


def test_stages_equal_brute_force(spark, tmp_path):
    rows, holdout = documents()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(holdout, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())

    told = {r.doc_id for r in kept[0]}
    assert told == {r[0] for r in rows} - {3000, 3001, 3002} and len(kept[0]) == len(rows) - 3

    assert {(r.doc_id, r.text) for r in kept[1]} == {(e, t) for e, _, _, t in test_lines.brute([(r.doc_id, r.text) for r in kept[0]])}
    assert all(r.n_chars == len(r.text) for r in kept[1]) and any(len(a.text) < a_old for a, a_old in ((r, dict((x.doc_id, x.n_chars) for x in kept[0])[r.doc_id]) for r in kept[1]))

    groups = {c for _, c in test_copies.brute([(r.doc_id, r.text) for r in kept[1]])}
    assert sorted(r.doc_id for r in kept[2]) == sorted(groups) and len(kept[2]) < len(kept[1])

    dirty = {e for e, *_ in test_seeds.brute([(r.doc_id, r.text) for r in kept[2]], holdout)}
    assert sorted(r.doc_id for r in kept[3]) == sorted(groups - dirty) and dirty

    test_packing.check([(r.doc_id, r.text) for r in kept[3]], kept[4], 1024)


def test_run_is_all_stages(spark, tmp_path):
    rows, holdout = documents()
    spark.createDataFrame(rows[:40], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(holdout, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() >= 30
    empty = tmp_path / "empty"
    spark.createDataFrame([], COLUMNS).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_training_rows_are_chosen_by_hash(spark):
    ids = spark.range(50).select("id", (F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in ids)
