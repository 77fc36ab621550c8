"""Source observations of a run, case by case."""

from datetime import datetime, timedelta

import pytest

from tidegauge.operators import observations as ob

T = datetime(2024, 1, 10, 12)
H = [format(n, "x") * 64 for n in range(10)]
ROWS = ("run_id string, row_index int, source_id string, state string, access_mode string, decision_at timestamp, attempted_at timestamp, query_status string, "
        "roles_observed array<string>, qualified_items long, zero_result boolean, raw_sha256s array<string>, data_quality_flags array<string>, enabled_for_run boolean, "
        "activation_id string, activation_evidence_sha256 string, entitlement_id string, entitlement_evidence_sha256 string, stale string")
CLEAN = dict(run_id="r", source_id="open", state="AVAILABLE", access_mode="API", decision_at=T, attempted_at=T - timedelta(hours=1), query_status="QUALIFIED",
             roles_observed=["NEWS"], qualified_items=2, zero_result=False, raw_sha256s=[H[0]], data_quality_flags=None, enabled_for_run=None, activation_id=None,
             activation_evidence_sha256=None, entitlement_id=None, entitlement_evidence_sha256=None, stale="clash")
SENSITIVE = dict(source_id="paid", roles_observed=["EXECUTION_TAPE"], raw_sha256s=[H[1], H[2]], enabled_for_run=True, activation_id="A", activation_evidence_sha256=H[1],
                 entitlement_id="E", entitlement_evidence_sha256=H[2])


@pytest.fixture(scope="module")
def sides(spark):
    catalogue = spark.createDataFrame(
        [("open", "PUBLIC", ["NEWS"], ["API"], True, False), ("paid", "LICENSED", ["EXECUTION_TAPE"], ["API"], False, True), ("tape", "PUBLIC", ["EXECUTION_TAPE"], ["API"], True, False)],
        "source_id string, source_class string, roles array<string>, access_modes array<string>, enabled_by_default boolean, requires_entitlement boolean")
    artifacts = spark.createDataFrame(
        [("r", "open", H[0], "PAGE"), ("r", "open", H[0], "PAGE"), ("r", "open", H[3], "ACCESS_RECEIPT"), ("r", "paid", H[1], "PAGE"), ("r", "paid", H[2], "ACCESS_RECEIPT"),
         ("r", "tape", H[4], None), ("x", "open", H[5], "PAGE")], "run_id string, source_id string, sha256 string, capture_kind string")
    start, change = T - timedelta(days=9), T - timedelta(hours=5)
    trust = spark.createDataFrame(
        [("paid", b, i, "one", start, change) for b, i in (("ACTIVATION", "A"), ("ENTITLEMENT", "E"))]
        + [("paid", b, i, "two", change, None) for b, i in (("ACTIVATION", "A"), ("ENTITLEMENT", "E"))] + [("paid", "ENTITLEMENT", "F", "other", start, None)],
        "source_id string, binding string, binding_id string, entry_id string, valid_from timestamp, valid_to timestamp")
    return catalogue, artifacts, trust


CASES = [
    ({}, []), (dict(query_status="ZERO_RESULT", qualified_items=0, zero_result=True), []),
    (dict(source_id="gone"), ["SOURCE_UNKNOWN", "EVIDENCE_NOT_OF_SOURCE"]), (dict(state=None), ["ACCESS_STATE_UNKNOWN"]),
    (dict(query_status=None), ["QUERY_STATUS_UNKNOWN", "ZERO_RESULT_CONTRADICTS_STATUS", "ITEMS_WITHOUT_QUALIFICATION"]),
    (dict(access_mode="FTP"), ["ACCESS_MODE_OUTSIDE_CONTRACT"]), (dict(attempted_at=None), ["ATTEMPT_TIME_MISSING"]),
    (dict(attempted_at=T + timedelta(hours=1)), ["ATTEMPTED_AFTER_DECISION"]), (dict(roles_observed=None), ["ROLES_MISSING"]),
    (dict(roles_observed=["NEWS", "FORUM"]), ["ROLES_OUTSIDE_CONTRACT"]), (dict(qualified_items=None), ["QUALIFIED_ITEMS_INVALID"]),
    (dict(qualified_items=0), ["QUALIFIED_WITHOUT_ITEMS"]), (dict(zero_result=True), ["ZERO_RESULT_CONTRADICTS_STATUS"]),
    (dict(query_status="ZERO_RESULT", zero_result=True), ["ZERO_RESULT_WITH_ITEMS"]),
    (dict(attempted_at=T - timedelta(hours=37)), ["ITEMS_WITHOUT_QUALIFICATION"]), (dict(attempted_at=T - timedelta(hours=36)), []),
    (dict(raw_sha256s=None), ["EVIDENCE_NOT_OF_SOURCE"]), (dict(raw_sha256s=[H[0], None]), ["EVIDENCE_HASH_MALFORMED", "EVIDENCE_NOT_OF_SOURCE"]),
    (dict(raw_sha256s=[H[0], H[0]]), ["EVIDENCE_HASH_REPEATED"]), (dict(raw_sha256s=[H[5]]), ["EVIDENCE_NOT_OF_SOURCE"]),
    (dict(raw_sha256s=[H[3]]), ["ONLY_ACCESS_RECEIPTS"]), (SENSITIVE, []), (SENSITIVE | dict(enabled_for_run=None), ["ACTIVATION_MISSING"]),
    (SENSITIVE | dict(activation_evidence_sha256=H[0]), ["ACTIVATION_EVIDENCE_UNRESOLVED"]),
    (SENSITIVE | dict(entitlement_evidence_sha256=H[1]), ["ENTITLEMENT_UNRESOLVED"]), (SENSITIVE | dict(activation_id="B"), ["TRUST_NOT_UNIQUE"]),
    (SENSITIVE | dict(entitlement_id="F"), ["TRUST_ENTRIES_DIFFER"]), (SENSITIVE | dict(attempted_at=T - timedelta(hours=6)), ["TRUST_BINDING_CHANGED"]),
    (dict(source_id="tape", roles_observed=["EXECUTION_TAPE"], raw_sha256s=[H[4]]), ["EXECUTION_TAPE_WITHOUT_LICENCE"]),
]


def test_every_rule(spark, sides):
    catalogue, artifacts, trust = sides
    # Each case is the first row of its source in a run of its own, over the same artifacts.
    names = [f.split()[0] for f in ROWS.split(", ")]
    data = [tuple((CLEAN | case | dict(row_index=i, run_id=f"r{i}"))[n] for n in names) for i, (case, _) in enumerate(CASES)]
    runs = spark.range(len(CASES)).selectExpr("concat('r', id) AS run_id")
    stored = artifacts.where("run_id = 'r'").drop("run_id").crossJoin(runs)
    got = ob.check_run_observations(spark.createDataFrame(data, ROWS), catalogue, stored, trust).orderBy("row_index").collect()
    for (case, want), row in zip(CASES, got, strict=True):
        assert row["issue_codes"] == want, case
        assert row["contributes"] == (not want), case
    flagged = spark.createDataFrame([tuple((CLEAN | dict(row_index=i, data_quality_flags=f))[n] for n in names) for i, f in ((1, ["CLOCK"]), (2, []))], ROWS)
    rows = ob.check_run_observations(flagged, catalogue, artifacts).orderBy("row_index").collect()
    assert [(r["issue_codes"], r["contributes"]) for r in rows] == [([], False), (["SOURCE_REPEATED"], False)]
    untrusted = spark.createDataFrame([tuple((CLEAN | SENSITIVE | dict(row_index=1))[n] for n in names)], ROWS)
    assert ob.check_run_observations(untrusted, catalogue, artifacts).first()["issue_codes"] == ["TRUST_NOT_UNIQUE"]
    assert ob.check_run_observations(untrusted.limit(0), catalogue, artifacts, trust).count() == 0


def test_entries_of_other_times_are_not_met(spark, sides, monkeypatch):
    """Of a binding with an entry for every month of thirty years an observation meets those near its two instants only."""
    catalogue, artifacts, _ = sides
    months = [datetime(1995 + i // 12, i % 12 + 1, 1) for i in range(361)]
    trust = spark.createDataFrame(
        [("paid", b, k, f"m{i}", months[i], months[i + 1]) for b, k in (("ACTIVATION", "A"), ("ENTITLEMENT", "E")) for i in range(360)],
        "source_id string, binding string, binding_id string, entry_id string, valid_from timestamp, valid_to timestamp")
    made, join = [], ob.interval_join
    monkeypatch.setattr(ob, "interval_join", lambda *a, **k: made.append(join(*a, **k)) or made[-1])
    rows = [{**CLEAN, **SENSITIVE, "run_id": f"r{i}", "row_index": i} for i in range(50)]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in ROWS.split(", ")) for r in rows], ROWS)
    checked = ob.check_run_observations(df, catalogue, artifacts, trust).collect()
    assert len(checked) == 50 and not any("TRUST_NOT_UNIQUE" in r.issue_codes for r in checked)
    assert made[0].count() <= 50 * 2 * 2 * 2


def exchanged(df):
    """Columns of every shuffle in the plan of ``df``."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found, left = [], [df._jdf.queryExecution().executedPlan()]
        while left:
            node = left.pop()
            left += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange":
                found.append([node.output().apply(i).name() for i in range(node.output().size())])
        return found
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_hashes_are_not_shuffled_as_text(spark, sides):
    """Codes of rows take digests and flags through the shuffles, no hash, no array and no text that is judged with the row."""
    df = spark.createDataFrame([tuple((CLEAN | SENSITIVE | dict(row_index=1))[c.split()[0]] for c in ROWS.split(", "))], ROWS)
    shuffled = exchanged(ob.check_run_observations(df, *sides).select("run_id", "row_index", "issue_codes"))
    large = {"sha256", "raw_sha256s", "activation_evidence_sha256", "entitlement_evidence_sha256", "roles_observed", "data_quality_flags", "_roles", "_modes", "query_status"}
    assert shuffled and not any(large & set(names) for names in shuffled)


def test_a_hash_counts_under_its_own_run_and_source_only(spark, sides):
    """Names that read alike when put together are different places; rows and stored hashes may repeat or lack a name."""
    catalogue, _, trust = sides
    stored = spark.createDataFrame([("r1", "open", H[0], "PAGE"), ("r", "1open", H[1], "PAGE"), (None, "open", H[2], "PAGE"), ("r2", "open", None, "PAGE")],
                                   "run_id string, source_id string, sha256 string, capture_kind string")
    cases = [("r1", 1, "open", [H[0]]), ("r", 2, "open", [H[0]]), ("r1", 3, "open", [H[1]]), (None, 4, "open", [H[2]]), ("r2", 5, "open", [None]), ("r1", 1, "open", [H[0]])]
    rows = [CLEAN | dict(run_id=r, row_index=i, source_id=s, raw_sha256s=h) for r, i, s, h in cases]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in ROWS.split(", ")) for r in rows], ROWS)
    got = sorted((r["row_index"], r["issue_codes"]) for r in ob.check_run_observations(df, catalogue, stored, trust).collect())
    assert got == [(1, []), (1, []), (2, ["EVIDENCE_NOT_OF_SOURCE"]), (3, ["SOURCE_REPEATED", "EVIDENCE_NOT_OF_SOURCE"]), (4, ["EVIDENCE_NOT_OF_SOURCE"]),
                   (5, ["EVIDENCE_HASH_MALFORMED", "EVIDENCE_NOT_OF_SOURCE"])]
