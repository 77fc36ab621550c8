"""File scans, HTML tables, sinks and the streaming scan on small files."""

import hashlib
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.operators.lab import HORIZONS
from tidegauge.sources import files, html
from tidegauge.streaming import post_open, slots

AT = "2024-01-10T10:00:00+00:00"


def observation(code, at=AT, value=1.0, **more):
    row = {
        "official_code": code, "observed_at": at, "source_id": "s", "source_role": "LICENSED_MARKET_DATA", "rights_status": "LICENSED_RESEARCH_ALLOWED",
        "latency_class": "REAL_TIME", "last_price_sar": 10.0, "average_daily_turnover_sar": 5e6, "identity_verified": True,
        "factors": [{"factor_id": "F", "value": value, "known_at": AT, "source_id": "s", "rights_status": "x"}],
    }
    row.update(more)
    return row


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_csv_header_must_match_exactly(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("﻿a,b\n1,2\n3,4\n", encoding="utf-8")
    assert files.read_csv(spark, str(good), ["a", "b"]).count() == 2
    twice = tmp_path / "twice.csv"
    twice.write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="duplicate"):
        files.read_csv(spark, str(twice), ["a", "b"])
    with pytest.raises(ValueError, match="differ"):
        files.read_csv(spark, str(good), ["a", "c"])


def test_json_lines_report_keys_and_offsets(spark, tmp_path):
    naive = observation("1001", at="2024-01-10T10:00:00")
    extra = observation("1002", note="x")
    short = observation("1003")
    del short["source_id"]
    path = write(tmp_path / "o.jsonl", [observation("1000"), naive, extra, short, "not json"])
    rows = files.read_observation_lines(spark, path)
    codes = [sorted(r["issue_codes"]) for r in rows.orderBy(F.coalesce("official_code", F.lit("9999"))).collect()]
    assert codes == [[], ["TIMESTAMP_WITHOUT_OFFSET:observed_at"], ["UNKNOWN_KEYS"], ["MISSING_KEYS"], ["JSON_UNREADABLE"]]
    first = R.clean(rows).first()
    assert first["factors"][0]["known_at"] is not None


def test_identity_arrays(spark, tmp_path):
    record = {"security_id": "x", "official_code": "1000", "segment": "MAIN", "valid_from": "2020-01-01", "known_from": AT, "tradable": True}
    (tmp_path / "m.json").write_text(json.dumps([record, record]))
    rows = files.read_identity(spark, str(tmp_path / "m.json")).collect()
    assert len(rows) == 2 and rows[0]["valid_to"] is None and rows[0]["known_from"] is not None


def test_vendor_export(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text(
        "Date,Price,Open,High,Low,Vol.,Change %\n"
        '"Aug 06, 2026",101.000,100.000,102.000,99.000,1.25M,+1.00%\n2026-08-05,100.000,99.000,101.000,98.000,950K,0.00%\n'
        '"Aug 04, 2026",100.000,99.000,90.000,98.000,1.0000001K,0.00%\n')
    manifest = spark.createDataFrame([("AAA.csv", "101", "v", "h")], "file_name string, code string, source_id string, sha256 string")
    rows = files.read_vendor_exports(spark, str(tmp_path), manifest).orderBy(F.desc("trade_date")).collect()
    assert [r["volume"] for r in rows] == [1_250_000, 950_000, None]
    assert rows[0]["issue_codes"] == [] and sorted(rows[2]["issue_codes"]) == ["OHLC_IMPOSSIBLE", "VOLUME_NOT_WHOLE"]
    stored = files.scan_artifacts(spark, str(tmp_path))
    checked = files.read_vendor_exports(spark, str(tmp_path), manifest, stored).collect()
    assert all("FILE_SHA256_MISMATCH" in r["issue_codes"] for r in checked)
    bound = manifest.drop("sha256").join(stored.select(F.col("path").alias("file_name"), "sha256"), "file_name")
    (tmp_path / "AAA.csv").write_text("Date,Price,Open,High,Low,Vol.,Change %\n2026-08-05,100,99,101,98,950,0.00%\n2026-08-06,100,99,101,98,950,0.00%\n")
    again = files.read_vendor_exports(spark, str(tmp_path), bound, files.scan_artifacts(spark, str(tmp_path))).orderBy("trade_date").collect()
    assert [r["issue_codes"] for r in again] == [[], ["ROWS_NOT_NEWEST_FIRST"]]


def test_manifest_audit_finds_every_kind_of_difference(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for name in ("a", "b", "stray"):
        (raw / name).write_text(name)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [("a", digest("a"), 1, "s", now, None), ("b", digest("x"), 2, "nobody", datetime(2025, 1, 1, tzinfo=timezone.utc), None), ("gone", digest("g"), 1, "s", now, None)]
    manifest = spark.createDataFrame(rows, "path string, sha256 string, size_bytes long, source_id string, observed_at timestamp, provider_as_of timestamp")
    sources = spark.createDataFrame([("s",)], "source_id string")
    audit = files.audit_manifest(files.scan_artifacts(spark, str(raw)), manifest, sources, F.lit("2024-06-01").cast("timestamp"))
    got = {r["path"]: sorted(r["issue_codes"]) for r in audit.collect()}
    assert got == {
        "a": [], "gone": ["ARTIFACT_MISSING"], "stray": ["ARTIFACT_NOT_IN_MANIFEST"],
        "b": ["ARTIFACT_HASH_MISMATCH", "ARTIFACT_SIZE_MISMATCH", "OBSERVED_AFTER_CUTOFF", "SOURCE_UNKNOWN"],
    }


def test_html_tables(spark):
    page = "<p>x</p><table><tr><th>Other</th></tr><tr><td>1</td></tr></table><table><tr><th>Sec Code</th><th>Name</th><th>ISIN Code</th></tr>" \
           "<tr><td>101</td><td>ALPHA&nbsp; &amp; SONS</td><td>KW0EQ0000101</td></tr><tr><td>102</td><td>B</td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, "<table><tr><th>Name</th></tr></table>"), (3, "plain")], "page_id long, html string")
    rows, issues = html.read_tables(pages, html.LAYOUTS["identity"])
    assert [(r["page_id"], r["security_code"], r["name"], r["isin"]) for r in rows.collect()] == [(1, "101", "ALPHA & SONS", "KW0EQ0000101")]
    assert sorted((r["row_key"], r["code"]) for r in issues.collect()) == [
        ("1", "SHORT_TABLE_ROW"), ("2", "REQUIRED_TABLE_HEADERS_NOT_FOUND"), ("3", "REQUIRED_TABLE_HEADERS_NOT_FOUND")]


def test_sorted_sink_refuses_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    target = str(tmp_path / "out")
    files.write_sorted(df, ["k", "v"], ["k"], target)
    assert [r["k"] for r in spark.read.csv(target, header=True, schema="k int, v string").collect()] == [1, 2]
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_sorted(df, ["k", "v"], ["k"], target)


def stream_into(spark, folder, tmp_path, name):
    stream = post_open.observation_stream(spark, str(folder), maxFilesPerTrigger="1")
    query = post_open.store_observations(stream, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return post_open.read_stored(spark, str(tmp_path / f"{name}-out"))


def test_stream_does_not_depend_on_files_and_loses_no_line(spark, tmp_path):
    rows = [observation("1000", value=2.0), observation("1000", value=2.0), observation("1001", value=-1.0), observation("9999"),
            observation("1002", average_daily_turnover_sar=1.0), observation("1003", at="2024-01-10T10:00:00"), observation("1001", at="2024-01-10T10:07:00+00:00"),
            "{broken", observation("1002", at="2024-01-10T11:00:00+00:00"), observation("1000", at="2024-01-10T10:01:00+00:00", value=9.0)]
    identity = spark.createDataFrame([("1000",), ("1001",), ("1002",)], "official_code string")
    until = F.lit("2024-01-10 10:30:00").cast("timestamp")
    found = []
    for name, parts in (("one", [rows]), ("ten", [[r] for r in rows])):
        folder = tmp_path / name
        folder.mkdir()
        for i, part in enumerate(parts):
            write(folder / f"{i}.jsonl", part)
        stored = stream_into(spark, folder, tmp_path, name)
        out = post_open.settle(stored, identity, {h: {"F": 1.0} for h in HORIZONS}, until)
        week = out["candidates"].where("horizon = 'WEEK'").orderBy("scan_id", "rank").collect()
        refused = sorted((str(r["official_code"]), r["reason"]) for r in out["refused"].collect())
        assert out["admitted"].count() + len(refused) + out["waiting"].count() == len(rows)
        found.append(([(r["scan_id"], r["official_code"], r["score"]) for r in week], refused, out["waiting"].count()))
    assert found[0] == found[1]
    assert found[0][0] == [("2024-01-10 10:05:00", "1000", 2.0), ("2024-01-10 10:05:00", "1001", -1.0), ("2024-01-10 10:10:00", "1001", 1.0)]
    assert [r for _, r in found[0][1]].count("DUPLICATE_SECURITY_OBSERVATION") == 2 and found[0][2] == 1
    # A line that comes after its slot was settled is refused as late.
    first = out["settled"].collect()
    write(tmp_path / "ten" / "late.jsonl", [observation("1002")])
    stored = stream_into(spark, tmp_path / "ten", tmp_path, "ten")
    again = post_open.settle(stored, identity, {h: {"F": 1.0} for h in HORIZONS}, until, spark.createDataFrame(first))
    assert [r["official_code"] for r in again["refused"].where("reason = 'LATE_OBSERVATION'").collect()] == ["1002"]
    assert sorted(r["official_code"] for r in again["admitted"].collect()) == ["1000", "1001", "1001"]


def test_artifacts_are_hashed_in_chunks_and_stored_below_a_folder(spark, tmp_path):
    sizes = {"a.bin": 0, "deep/b.bin": 10, "deep/er/c.bin": 5000}
    rows = [(p, bytes(range(256)) * (n // 256 + 1)) for p, n in sizes.items()]
    root = str(tmp_path / "store")
    assert files.store_artifacts(spark.createDataFrame([(p, c[:sizes[p]]) for p, c in rows], "path string, content binary"), root) == 3
    want = {(p, sizes[p], hashlib.sha256(c[:sizes[p]]).hexdigest()) for p, c in rows}
    for chunk in (1, 7, 1 << 20):
        assert {tuple(r) for r in files.scan_artifacts(spark, root, chunk).collect()} == want
    assert {tuple(r) for r in files.scan_artifacts(spark, "file://" + root).collect()} == want
    for bad in ("/x", "../x", "a//b", "a/", "", None):
        with pytest.raises(ValueError):
            files.store_artifacts(spark.createDataFrame([(bad, b"")], "path string, content binary"), root)


def test_packets_are_held_against_their_inventory(spark, tmp_path):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    at = datetime(2024, 1, 2, tzinfo=timezone.utc)
    stored = [("good/raw/a", "one"), ("good/raw/b", "two"), ("lost/raw/a", "x"), ("odd/raw/a", "y"), ("odd/raw/stray", "z"), ("many/raw/a", "q"), ("nobody/raw/a", "n")]
    root = str(tmp_path / "packets")
    files.store_artifacts(spark.createDataFrame(stored, "path string, content string"), root)
    manifest = [("good", "raw/a", digest("one"), 3, at), ("good", "raw/b", digest("two"), 3, at), ("lost", "raw/a", digest("x"), 1, at), ("lost", "raw/gone", digest("g"), 1, at),
                ("odd", "raw/a", digest("other"), 9, datetime(2025, 1, 1, tzinfo=timezone.utc)), ("many", "raw/a", digest("q"), 1, at), ("many", "raw/a", digest("q"), 1, at)]
    manifest += [("large", f"raw/{i}", digest(str(i)), 1, at) for i in range(files.PACKET_ARTIFACTS + 1)]
    rows = spark.createDataFrame(manifest, "packet_id string, path string, sha256 string, size_bytes long, observed_at timestamp")
    times = [(p, digest("m"), datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 6, 1, tzinfo=timezone.utc)) for p in ("good", "lost", "odd", "many", "large", "empty")]
    packets = spark.createDataFrame(times + [("back", digest("m"), *times[0][:1:-1])], "packet_id string, manifest_sha256 string, decision_at timestamp, observed_at timestamp")
    checked, found = files.audit_packets(files.scan_artifacts(spark, root), rows, packets)
    codes = {(r.packet_id, r.path): sorted(r.issue_codes) for r in checked.collect() if r.packet_id != "large"}
    assert codes["good", "raw/a"] == codes["good", "raw/b"] == codes["lost", "raw/a"] == []
    assert codes["lost", "raw/gone"] == ["ARTIFACT_MISSING"] and codes["odd", "raw/stray"] == ["ARTIFACT_UNREFERENCED"]
    assert codes["odd", "raw/a"] == ["ARTIFACT_HASH_MISMATCH", "ARTIFACT_OUTSIDE_OUTCOME_TIMES", "ARTIFACT_SIZE_MISMATCH"]
    assert codes["many", "raw/a"] == ["ARTIFACT_PATH_DUPLICATE", "ARTIFACT_SHA256_DUPLICATE"] and codes["nobody", "raw/a"] == ["ARTIFACT_UNREFERENCED", "PACKET_UNKNOWN"]
    got = {r.packet_id: (r.status, r.packet_sha256, r.issue_codes) for r in found.collect()}
    entries = [{"path": "manifest.json", "sha256": digest("m")}] + [{"path": f"raw/{p}", "sha256": digest(t), "size_bytes": 3} for p, t in (("a", "one"), ("b", "two"))]
    assert got["good"] == ("PASS", digest(json.dumps(entries, separators=(",", ":"))), [])
    assert {p: c for p, (_, sha, c) in got.items() if p != "good" and sha is None} == {
        "lost": ["PACKET_INVENTORY_DIFFERS"], "odd": ["PACKET_INVENTORY_DIFFERS"], "many": ["PACKET_INVENTORY_DIFFERS"], "empty": ["PACKET_EMPTY"],
        "back": ["PACKET_TIMES_REVERSED", "PACKET_EMPTY"], "large": ["PACKET_TOO_LARGE", "PACKET_INVENTORY_DIFFERS"]}


def test_slots_settle_inside_the_stream(spark, tmp_path):
    identity = spark.createDataFrame([("1000",), ("1001",), ("1002",)], "official_code string")
    rows = [observation("1000", value=2.0), observation("1000", value=2.0), observation("1001", value=-1.0), observation("9999"),
            observation("1002", average_daily_turnover_sar=1.0), observation("1003", at="2024-01-10T10:00:00"), "{broken",
            observation("1001", at="2024-01-10T10:07:00+00:00"), observation("1000", at="2024-01-10T10:01:00+00:00", value=9.0)]
    later = [observation("1002", at="2024-01-10T11:00:00+00:00"), observation("1002", at="2024-01-10T11:03:00+00:00")]
    found = []
    for name, parts in (("few", [rows]), ("many", [[r] for r in rows])):
        folder, out, checkpoint = tmp_path / f"{name}-slots", str(tmp_path / f"{name}-settled"), str(tmp_path / f"{name}-state")
        folder.mkdir()
        stream = post_open.observation_stream(spark, str(folder), maxFilesPerTrigger="4")
        for wave, lines in enumerate((parts, [later], [[observation("1002")]])):
            for i, part in enumerate(lines):
                write(folder / f"{wave}-{i}.jsonl", part)
            slots.run_available(slots.settle_slots(stream, identity, delay="30 minutes"), out, checkpoint)
        decided = spark.read.parquet(out)
        held = slots.waiting(spark, checkpoint)
        assert decided.count() + held.count() == len(rows) + len(later) + 1
        assert sorted(str(r["observed_at"]) for r in held.collect()) == ["2024-01-10 11:00:00", "2024-01-10 11:03:00"]
        week = slots.candidates(decided, {h: {"F": 1.0} for h in HORIZONS}).where("horizon = 'WEEK'").orderBy("scan_id", "rank").collect()
        found.append(([(r["scan_id"], r["official_code"], r["score"]) for r in week],
                      sorted((str(r["official_code"]), str(r["reason"])) for r in decided.collect())))
    assert found[0] == found[1]
    assert found[0][0] == [("2024-01-10 10:05:00", "1000", 2.0), ("2024-01-10 10:05:00", "1001", -1.0), ("2024-01-10 10:10:00", "1001", 1.0)]
    reasons = [r for _, r in found[0][1]]
    assert reasons.count("DUPLICATE_SECURITY_OBSERVATION") == 2 and reasons.count("LATE_OBSERVATION") == 1 and reasons.count("None") == 3


def test_vendor_exports_are_read_once(spark, tmp_path):
    """Rows of a date are counted beside the check of their order, unreadable dates never as equal ones."""
    line = "{},100,99,101,98,950,0.00%\n"
    (tmp_path / "A.csv").write_text("Date,Price,Open,High,Low,Vol.,Change %\n" + "".join(line.format(d) for d in ("2026-08-05", '"Aug 5, 2026"', "x", "x", '"Aug 04, 2026"')))
    (tmp_path / "B.csv").write_text("Date,Price,Open,High,Low,Vol.,Change %\n" + line.format("2026-08-05"))
    manifest = spark.createDataFrame([(f, "1", "v", "h") for f in ("A.csv", "B.csv")], "file_name string, code string, source_id string, sha256 string")
    rows = files.read_vendor_exports(spark, str(tmp_path), manifest)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [Date") == 1
    got = sorted((r["file_name"], str(r["trade_date"]), *r["issue_codes"]) for r in rows.collect())
    assert got == [("A.csv", "2026-08-04"), *[("A.csv", "2026-08-05", "DATE_DUPLICATE")] * 2, *[("A.csv", "None", "DATE_UNREADABLE")] * 2, ("B.csv", "2026-08-05")]
