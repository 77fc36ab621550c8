"""Boundary cases of single operators on small hand-made rows."""

import hashlib
import random
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.functions import text as tx
from tidegauge.functions.digest import table_digest
from tidegauge.operators import corporate_actions as ca
from tidegauge.operators import evaluate as ev
from tidegauge.operators import events, foundation, lab, ledger, network, pit, prices, reconcile
from tidegauge.operators.ordering import average_ranks, last_before, positions, with_previous
from tidegauge.plans import views

UTC = timezone.utc
T0 = datetime(2024, 1, 1, tzinfo=UTC)


def ts(hours):
    return T0 + timedelta(hours=hours)


# --- ordering ------------------------------------------------------------------

@pytest.mark.parametrize("parts", [1, 7])
def test_positions_do_not_depend_on_partitioning(spark, parts):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.random(), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, id int").repartition(parts)
    got = {r["id"]: r["position"] for r in positions(df, ["v", "id"], ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])), 1):
            want[r[2]] = n
    assert got == want


def test_few_groups_are_broadcast_to_placed_rows(spark):
    df = spark.createDataFrame([(g, v) for g in (None, "a", "b") for v in range(20)], "g string, v long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = positions(df, ["v"], ["g"])
        assert "SortMergeJoin" not in placed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r["g"], r["v"]): r["position"] for r in placed.collect()} == {(g, v): v + 1 for g in (None, "a", "b") for v in range(20)}


def test_outcomes_read_line_items_once(spark, tmp_path):
    rows = [(10 * c + d, d % 3, d % 2, c, float(1 + d), float(10 * (c + d + 1)), datetime(1995, 1, 1 + d // 2)) for c in range(4) for d in range(8)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, "
                          "l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = views.outcomes(spark, str(tmp_path))
    assert not [f for f in out.inputFiles() if "lineitem" in f]
    price = {(c, d): 10.0 * (c + d + 1) / (1 + d) for c in range(4) for d in range(8)}
    market = {day: sum(price[c, 2 * day + 3] / price[c, 2 * day + 1] - 1 for c in range(4)) / 4 for day in range(3)}
    got = {(r.decision_id, r.code): r.benchmark_exit_value - 1 for r in out.collect()}
    assert got == {(f"1995-01-0{day + 1}", c): pytest.approx(market[day]) for day in range(3) for c in range(4)}


def test_last_before_and_previous_match_a_walk(spark):
    rng = random.Random(9)
    rows = [(rng.choice("xxxy"), i, i if rng.random() < 0.3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, seq int, v int").repartition(6)
    got = {r["seq"]: r["before"] for r in last_before(df, ["seq"], ["g"], "v", "before").collect()}
    previous = {r["seq"]: r["prev_seq"] for r in with_previous(df, ["seq"], ["g"], ["seq"]).collect()}
    last, row = {}, {}
    for g, seq, v in rows:
        assert got[seq] == last.get(g) and previous[seq] == row.get(g)
        last[g] = v if v is not None else last.get(g)
        row[g] = seq


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("d", c, v) for c, v in zip("abcd", (1.0, 2.0, 2.0, 3.0))], "g string, c string, v double")
    assert {r["c"]: r["r"] for r in average_ranks(df, "v", ["g"], "r", ["c"]).collect()} == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0}


# --- rules and text ------------------------------------------------------------

def test_rules_collect_everything_and_unknown_fails(spark):
    df = spark.createDataFrame([("a", 1.0), (None, None), ("b", float("nan"))], "k string, v double")
    got = [r["issue_codes"] for r in R.check(df, R.must("K", R.present("k")), R.must("V", R.finite("v", 0))).collect()]
    assert got == [[], ["K", "V"], ["V"]]
    assert R.clean(R.check(df, R.must("V", R.finite("v")))).count() == 1


def test_timestamps_without_offset_are_refused(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T03:00:00+03:00",), ("2024-01-01T00:00:00",), ("bad+03:00",)], "t string")
    got = [r["u"] for r in df.select(F.unix_micros(R.aware_timestamp("t")).alias("u")).collect()]
    assert got[0] == got[1] == int(T0.timestamp() * 1e6) and got[2:] == [None, None]


def test_url_isin_and_tokens(spark):
    urls = [("https://a.example.com/x?page=1", ""), ("http://a.example.com", "URL_NOT_ABSOLUTE_HTTPS"), ("https://u:p@a.example.com/", "URL_HAS_USERINFO"),
            ("https://a.example.com/#top", "URL_HAS_FRAGMENT"), ("https://a.example.com:8443/", "URL_PORT_NOT_STANDARD"),
            ("https://a.example.com/?X-Amz-Signature=1", "URL_QUERY_SENSITIVE"), ("https://a.example.com/?api-key=1", "URL_QUERY_SENSITIVE")]
    df = spark.createDataFrame(urls, "url string, want string")
    for r in tx.check_url(df).collect():
        assert "|".join(r["issue_codes"]) == r["want"], r["url"]
    isins = spark.createDataFrame([("US0378331005",), ("US0378331006",), ("KW0EQ0100010",), ("bad",), (None,)], "i string")
    assert [r["v"] for r in isins.select(tx.isin_valid(F.col("i")).alias("v")).collect()] == [True, False, True, False, False]
    hosts = spark.createDataFrame([("a.b.com.kw",), ("x.example.org",), ("localhost",)], "h string")
    assert [r["d"] for r in hosts.select(tx.registrable_domain(F.col("h")).alias("d")).collect()] == ["b.com.kw", "example.org", "localhost"]
    t = spark.createDataFrame([("Ｂｉｇ News https://x.y/z BIG أحمد إلى",)], "t string")
    assert t.select(tx.claim_tokens(F.col("t")).alias("k")).first()["k"] == sorted(["big", "news", "احمد", "الي"])


# --- point in time -------------------------------------------------------------

def test_interval_join_equals_the_nested_loop(spark):
    rng = random.Random(3)
    day = lambda n: date(2020, 1, 1) + timedelta(days=n)
    probes = [(i, rng.choice("aab"), day(rng.randrange(900))) for i in range(120)]
    spans = [(i, rng.choice("aab"), day(s := rng.randrange(900)), None if rng.random() < 0.2 else day(s + rng.randrange(400))) for i in range(60)]
    p = spark.createDataFrame(probes, "id int, k string, at date")
    s = spark.createDataFrame(spans, "sid int, k string, lo date, hi date")
    got = sorted((r["id"], r["sid"]) for r in pit.interval_join(p, s, ["k"], "at", "lo", "hi").collect())
    assert got == sorted((a[0], b[0]) for a in probes for b in spans if a[1] == b[1] and b[2] <= a[2] and (b[3] is None or a[2] <= b[3]))
    left = pit.interval_join(p, s, ["k"], "at", "lo", "hi", "left")
    assert left.select("id").distinct().count() == 120


def test_isin_collision_needs_two_owners_on_one_day(spark):
    d = date.fromisoformat
    rows = [("I", 1, d("2024-01-01"), d("2024-01-31")), ("I", 1, d("2024-01-15"), d("2024-02-15")), ("I", 2, d("2024-02-16"), None),
            ("J", 3, d("2024-01-01"), None), ("J", 4, d("2024-06-01"), d("2024-06-01"))]
    df = spark.createDataFrame(rows, "isin string, code int, valid_from date, valid_to date")
    got = pit.overlapping_keys(df, ["isin"], "valid_from", "valid_to", ["code"]).collect()
    assert [(r["isin"], r["first_overlap_day"]) for r in got] == [("J", d("2024-06-01"))]
    assert pit.overlapping_keys(df, ["isin", "code"], "valid_from", "valid_to").count() == 1


def test_session_horizon_reports_gaps_on_the_way(spark):
    d = date.fromisoformat
    cal = pit.build_calendar(spark, d("2024-01-01"), d("2024-01-31"), spark.createDataFrame([(d("2024-01-03"), "H")], "trade_date date, holiday_name string"))
    status = spark.createDataFrame(
        [("a", "TRADING", d("2024-01-01"), None), ("b", "TRADING", d("2024-01-01"), d("2024-01-08")), ("b", "TRADING", d("2024-01-10"), None),
         ("c", "TRADING", d("2024-01-01"), d("2024-01-04")), ("c", "SUSPENDED", d("2024-01-05"), None)],
        "code string, status string, effective_from date, effective_to date")
    dec = spark.createDataFrame([(k, c, d(x), n) for k, c, x, n in [
        (1, "a", "2024-01-01", 3), (2, "b", "2024-01-07", 2), (3, "c", "2024-01-02", 2), (4, "a", "2024-01-05", 1), (5, "c", "2024-01-07", 1), (6, "b", "2024-01-01", 2)]],
        "decision_id int, code string, decision_day date, horizon_sessions int")
    got = {r["decision_id"]: (str(r["due_day"]) if r["due_day"] else None, r["issue_code"]) for r in pit.nth_eligible_session(dec, cal, status).collect()}
    assert got[1] == ("2024-01-07", None)
    assert got[2] == (None, "SECURITY_STATUS_MISSING_OR_AMBIGUOUS")
    assert got[3] == (None, "SESSION_HORIZON_NOT_COVERED")
    assert got[4] == (None, "DECISION_NOT_ON_TRADING_SESSION")
    assert got[5] == (None, "DECISION_SECURITY_STATUS_NOT_TRADING")
    assert got[6] == ("2024-01-04", None)


def test_window_edges_are_inclusive(spark):
    df = spark.createDataFrame([(ts(-72),), (ts(-73),), (ts(-120 * 24),), (ts(-120 * 24 - 1),), (ts(1),)], "t timestamp")
    got = [len(r["g"]) for r in df.select(pit.window_tags(F.col("t"), F.lit(T0).cast("timestamp")).alias("g")).collect()]
    assert got == [4, 3, 1, 0, 0]


# --- prices and corporate actions ----------------------------------------------

def test_liquidity_counts_missing_apart_from_zero(spark):
    rows = [("a", date(2024, 1, i + 1), c, v, t) for i, (c, v, t) in enumerate([(10.0, 5.0, 50.0), (10.0, 0.0, 0.0), (11.0, None, None), (12.1, 7.0, 70.0)])]
    m = prices.liquidity_metrics(spark.createDataFrame(rows, "code string, trade_date date, close double, volume double, turnover double")).first()
    assert (m["sessions"], m["traded_sessions"], m["missing_volume_sessions"], m["zero_volume_sessions"], m["zero_return_sessions"]) == (4, 2, 1, 1, 1)
    assert m["nontrading_ratio"] == 0.5 and m["median_volume"] == 6.0 and m["amihud_illiquidity"] == pytest.approx(0.1 / 70)


TERMS = ("action_id string, action_type string, formula_mode string, previous_close string, cash_per_share string, new_shares_per_old_share string, "
         "rights_new_shares_per_old_share string, subscription_price string, official_reference_price string, official_factor string, "
         "official_position_quantity_multiplier string, fractional_entitlement_policy string")


def test_adjustment_formulas(spark):
    m = "REPRODUCIBLE_MECHANICAL"
    rows = [("cash", "CASH_DIVIDEND_NORMAL", m, "100", "5", None, None, None, None, None, None, "NOT_APPLICABLE"),
            ("bonus", "BONUS_SHARES", m, "100", None, "0.25", None, None, None, None, None, "ROUND_DOWN"),
            ("rights", "RIGHTS_ISSUE", m, "100", None, None, "0.5", "60", None, None, None, "NOT_APPLICABLE"),
            ("split", "REVERSE_SPLIT", m, "100", None, "2", None, None, None, None, None, "NOT_APPLICABLE"),
            ("third", "STOCK_SPLIT", m, "1", None, "3", None, None, None, None, None, "NOT_APPLICABLE"),
            ("wait", "MERGER", "NO_AUTOMATIC_FORMULA", None, None, None, None, None, None, None, None, "UNKNOWN")]
    got = {r["action_id"]: r for r in ca.calculate_adjustments(spark.createDataFrame(rows, TERMS)).collect()}
    assert got["cash"]["theoretical_ex_price"] == 95 and got["cash"]["reference_price_factor"] == Decimal("0.95") and got["cash"]["return_engine_ready"]
    assert got["bonus"]["theoretical_ex_price"] == 80 and got["bonus"]["position_quantity_multiplier"] == Decimal("1.25")
    assert not got["bonus"]["return_engine_ready"] and got["bonus"]["return_price_multiplier"] is None
    assert got["rights"]["theoretical_ex_price"] == Decimal("86.666666666667") and got["rights"]["rights_cash_contribution"] == 30
    assert not got["rights"]["return_engine_ready"]
    assert got["split"]["issue_codes"] == ["REVERSE_SPLIT_NOT_BELOW_ONE"] and got["split"]["theoretical_ex_price"] is None
    assert got["third"]["reference_price_factor"] == Decimal("0.333333333333")
    assert got["wait"]["factor_status"] == "pending" and got["wait"]["return_engine_treatment"] == "BLOCKED_PENDING_OFFICIAL_TERMS"


# --- events --------------------------------------------------------------------

def test_status_fold_refuses_double_days_and_keeps_state_on_bad_moves(spark):
    d = date.fromisoformat
    opening = spark.createDataFrame([("a", "TRADING", "SUSPENDED"), ("b", "TRADING", "TRADING"), ("c", "TRADING", "TRADING")], "code string, status string, current_status string")
    notices = spark.createDataFrame(
        [("a", "n1", d("2024-01-05"), "RESUME"), ("a", "n2", d("2024-01-10"), "SUSPEND"), ("b", "n3", d("2024-01-05"), "SUSPEND"), ("b", "n4", d("2024-01-05"), "RESUME"),
         ("z", "n5", d("2024-01-06"), "SUSPEND")], "code string, notice_id string, effective_date date, event_type string")
    intervals, issues = events.status_intervals(opening, notices, F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))
    got = sorted((r["code"], r["status"], str(r["effective_from"]), str(r["effective_to"])) for r in intervals.collect())
    assert got == [("a", "SUSPENDED", "2024-01-10", "2024-01-31"), ("a", "TRADING", "2024-01-01", "2024-01-09"), ("c", "TRADING", "2024-01-01", "2024-01-31")]
    assert sorted((r["row_key"], r["code"]) for r in issues.collect()) == [
        ("a", "INVALID_STATUS_TRANSITION:TRADING:RESUME:2024-01-05"), ("b", "MULTIPLE_STATUS_EVENTS_SAME_DATE"), ("z", "STATUS_NOTICE_OUTSIDE_IDENTITY")]


def test_exposures_are_bound_to_their_event(spark):
    e = spark.createDataFrame([("e1", "SECURITY", "100", T0, T0, ["h1"], "UNCONFIRMED", "CURRENT"), ("e2", "SECTOR", "BANKS", T0, T0, ["h2"], "CONTESTED", "SUPERSEDED")],
                              "canonical_event_id string, scope string, scope_key string, first_available_at timestamp, decision_at timestamp, evidence_hashes array<string>, factual_status string, correction_status string")
    x = spark.createDataFrame(
        [("x1", "e1", "100", "DIRECT_NAMED", None, T0, T0, True, ["h1"]), ("x2", "e1", "200", "DIRECT_NAMED", None, ts(-1), T0, False, ["h9"]),
         ("x3", "e2", "100", "SECTOR_EXPOSURE", "OIL", T0, T0, True, ["h2"]), ("x4", "gone", "999", "DIRECT_NAMED", None, T0, T0, False, ["h1"])],
        "exposure_id string, canonical_event_id string, code string, exposure_type string, sector_code string, available_at timestamp, decision_at timestamp, factor_eligible boolean, evidence_hashes array<string>")
    u = spark.createDataFrame([("100",), ("200",)], "code string")
    got = {r["exposure_id"]: r["issue_codes"] for r in events.bind_exposures(x, e, u).collect()}
    assert got["x1"] == []
    assert got["x2"] == ["EXPOSURE_PREDATES_EVENT", "EXPOSURE_EVIDENCE_UNBOUND", "DIRECT_NAMED_SCOPE_CONFLICT"]
    assert got["x3"] == ["SECTOR_SCOPE_CONFLICT", "SUPERSEDED_EVENT_NOT_ELIGIBLE", "UNCONFIRMED_EVENT_NOT_ELIGIBLE"]
    assert got["x4"] == ["EXPOSURE_OUTSIDE_DENOMINATOR", "EXPOSURE_EVENT_UNRESOLVED"]


# --- lab -----------------------------------------------------------------------

def corpus(spark, n=400):
    rows = []
    for i in range(n):
        s = ((i % 9) - 4) / 4 or 0.25
        at = ts(24 * i)
        factors = [("F9-SIGNAL", s, at - timedelta(minutes=5), "s", "PUBLIC_RESEARCH_ALLOWED")]
        outcomes = [(h, s * (k + 1) * 0.01, at + timedelta(days=k + 1), "RAW") for k, h in enumerate(lab.HORIZONS)]
        rows.append((f"e{i:04d}", "1010", at, at, at, "PRIMARY" if i < 60 else "PROBE", "EARNINGS", "s", "REGULATORY_EVIDENCE", "PUBLIC_RESEARCH_ALLOWED",
                     factors, outcomes, True, True, True))
    return spark.createDataFrame(rows, lab.EVENT_SCHEMA)


def test_nightly_seals_do_not_depend_on_partitions(spark):
    """The same events in other partitions and another order fit the same weights and seal the same packet, to the last bit."""
    # Many small values and a few large ones: plain sums of doubles would differ with their order.
    uneven = F.when(F.crc32(F.encode("event_id", "UTF-8")) % 7 == 0, 97.3).otherwise(0.1 / 3)
    events = R.clean(lab.check_events(corpus(spark).withColumn("factors", F.transform("factors", lambda f: f.withField("value", f["value"] * uneven)))))
    run_at = F.lit(ts(24 * 500)).cast("timestamp")
    runs = []
    for parts, order in ((1, F.col("event_id")), (8, F.desc("event_id"))):
        run = lab.run_nightly(events.repartition(parts).sortWithinPartitions(order), "r", run_at)
        runs.append((sorted(run["weights"].collect()), run["seal"].collect(), run["vault_seal"].collect(), sorted(lab.score_nightly(run, "r", run_at).collect())))
    assert runs[0] == runs[1]
    values = [0.1 / 3] * 1000 + [97.3e6, -97.3e6]
    sums = {spark.createDataFrame([(v,) for v in values[::step]], "v double").repartition(n).agg(lab.exact_sum(F.col("v"))).first()[0] for step in (1, -1) for n in (1, 8)}
    assert len(sums) == 1


def test_nightly_lab_fits_seals_and_scores(spark):
    run_at = F.lit(ts(24 * 500)).cast("timestamp")
    run = lab.run_nightly(R.clean(lab.check_events(corpus(spark))), "r", run_at)
    w = {r["horizon"]: r for r in run["weights"].collect()}
    assert w["YEAR"]["weight"] == pytest.approx(0.05) and w["INTRADAY"]["base_weight"] == 1.0
    m = {r["horizon"]: r for r in lab.score_nightly(run, "r", run_at).collect()}
    assert m["WEEK"]["mean_absolute_error"] == 0.0 and m["WEEK"]["directional_hit_rate"] == 1.0 and m["WEEK"]["event_count"] == 12 + 68
    changed = {**run, "predictions": run["predictions"].withColumn("score", F.col("score") + 1e-9)}
    with pytest.raises(ValueError, match="PACKET_TAMPERED"):
        lab.score_nightly(changed, "r", run_at)
    opened = {**run, "vault": run["vault"].withColumn("excess_return", F.col("excess_return") * 2)}
    with pytest.raises(ValueError, match="VAULT_TAMPERED"):
        lab.score_nightly(opened, "r", run_at)
    stopped = lab.run_nightly(corpus(spark, 100), "r", run_at)
    assert stopped["gate"].first()["reasons"] == ["PROBE_EVENT_MINIMUM_NOT_MET"] and "weights" not in stopped


def test_leaking_events_are_named(spark):
    bad = corpus(spark, 1).withColumn("prediction_at", F.col("prediction_at") - F.expr("INTERVAL 1 HOUR"))
    assert lab.check_events(bad).first()["issue_codes"] == ["FEATURE_LEAKAGE_AFTER_PREDICTION_CUTOFF"]


# --- evaluation ----------------------------------------------------------------

def test_rank_ic_is_null_without_variance(spark):
    rows = [("d1", "a", 1.0, 1.0), ("d1", "b", 2.0, 2.0), ("d2", "a", 1.0, 1.0), ("d2", "b", 1.0, 2.0), ("d3", "a", 1.0, 1.0)]
    got = {r["decision_id"]: r["rank_ic"] for r in ev.rank_ic(spark.createDataFrame(rows, "decision_id string, code string, s double, o double"), "s", "o").collect()}
    assert got == {"d1": pytest.approx(1.0), "d2": None, "d3": None}


def test_wilson_bounds(spark):
    lo, hi = ev.wilson(F.col("h"), F.col("n"))
    got = spark.createDataFrame([(0, 10), (10, 10), (5, 10), (0, 0)], "h long, n long").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert got[0]["lo"] == 0.0 and got[1]["hi"] == pytest.approx(1.0) and got[2]["lo"] == pytest.approx(0.236593, abs=1e-6) and got[2]["hi"] == pytest.approx(0.763407, abs=1e-6)


# --- ledger and digests --------------------------------------------------------

def chain(n=6):
    rows, prev = [], None
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i in range(1, n + 1):
        p = f"p{i}"
        kind, rev = ("CREATE", 1) if i % 2 else ("AMEND", 2)
        fields = ["L", str(i), kind, f"c{(i + 1) // 2}", str(rev), digest(p), prev or ""]
        h = digest("\0".join(fields))
        rows.append(("L", i, kind, fields[3], rev, ts(i), ts(i), ts(i), p, digest(p), prev, prev if rev == 2 else None, h))
        prev = h
    return rows


LOG = ("ledger_id string, event_seq long, event_type string, claim_id string, revision int, issued_at timestamp, recorded_at timestamp, effective_at timestamp, "
       "payload string, payload_hash string, previous_event_hash string, supersedes_event_hash string, event_hash string")


def test_chain_verification_and_seal(spark):
    rows = chain()
    good = spark.createDataFrame(rows, LOG)
    assert ledger.verify_chain(good).where(F.size("issue_codes") > 0).count() == 0
    bad = [list(r) for r in rows]
    bad[2][8] = "changed"
    del bad[4]
    broken = spark.createDataFrame([tuple(r) for r in bad], LOG)
    codes = {r["event_seq"]: r["issue_codes"] for r in ledger.verify_chain(broken).collect()}
    assert codes[3] == ["PAYLOAD_HASH"] and codes[6] == ["SEQUENCE", "PREVIOUS_HASH", "REVISION", "SUPERSEDES"] and codes[4] == []
    stored = spark.createDataFrame(ledger.seal(good).collect(), ledger.seal(good).schema)
    assert ledger.verify_seals(good, stored).first()["issue_codes"] == []
    assert "SEAL_CONTENT_SHA256" in ledger.verify_seals(broken, stored).first()["issue_codes"]


def test_table_digest_ignores_order_but_not_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    d = lambda df: table_digest(df).first()["table_sha256"]
    assert d(a) == d(a.repartition(3)) and d(a) != d(a.distinct()) and d(a) != d(a.na.fill("x"))


# --- network, reconcile, foundation ---------------------------------------------

def finding(seq, code, source, kind, direction, roles, **more):
    row = dict(seq=seq, finding_id=f"f{seq:03d}", code=code, ticker=more.get("ticker", code), source_id=source, available_at=ts(seq), signal_kind=kind,
               direction=direction, strength=more.get("strength", 1.0), materiality=1.0, origin_id=more.get("origin", f"o{seq}"), event_key=more.get("event", f"e{seq}"),
               claim_text=f"claim number {seq}", evidence_roles=roles)
    return tuple(row.values())


FINDING = ("seq long, finding_id string, code string, ticker string, source_id string, available_at timestamp, signal_kind string, direction string, strength double, "
           "materiality double, origin_id string, event_key string, claim_text string, evidence_roles array<string>")


def test_source_mosaic_rank(spark):
    rows = [finding(1, "A", "s1", "CATALYST", "POSITIVE", ["NEWS_ARCHIVE", "OFFICIAL_EVENT"]), finding(2, "A", "s2", "PRICE_ACTIVITY", "POSITIVE", ["MARKET_DISCOVERY", "PRICE_HISTORY"]),
            finding(3, "A", "s3", "TECHNICAL", "POSITIVE", ["MARKET_DISCOVERY"]), finding(4, "A", "s4", "CATALYST", "POSITIVE", ["NEWS_ARCHIVE", "ISSUER_PRIMARY"]),
            finding(5, "A", "s4", "CATALYST", "POSITIVE", ["NEWS_ARCHIVE"], origin="o4", event="e4", strength=0.1),
            finding(6, "B", "s1", "CATALYST", "NEGATIVE", ["NEWS_ARCHIVE"]), finding(7, "C", "s1", "SENTIMENT", "NEUTRAL", ["NEWS_ARCHIVE"])]
    sources = spark.createDataFrame([(f"s{i}", "PRIMARY_OFFICIAL", f"g{i}") for i in range(1, 5)], "source_id string, source_class string, independence_group string")
    got = {r["code"]: r for r in network.rank_candidates(network.with_sources(spark.createDataFrame(rows, FINDING), sources), network.SHORT_TERM_POLICY).collect()}
    assert got["A"]["decision_status"] == "RESEARCH_CANDIDATE" and got["A"]["selected"] and got["A"]["rank"] == 1
    assert got["A"]["research_score"] == 50 + 50 * (0.25 + 0.25 + 0.15) and got["A"]["reason_codes"] == ["NOT_A_FULL_MARKET_BEST_CLAIM"]
    assert got["B"]["decision_status"] == "ABSTAIN" and "INSUFFICIENT_SOURCE_DIVERSITY" in got["B"]["reason_codes"] and got["B"]["research_score"] == 37.5
    assert got["C"]["research_score"] == 50.0 and not got["C"]["selected"]


def test_two_providers_agree_or_are_quarantined(spark):
    cols = "d string, code string, provider_id string, px double, raw_sha256 string, evidence_classification string, rights_status string"
    rows = [("d", "1", "b", 1.0, "hb", "PARTIAL", "UNKNOWN"), ("d", "1", "a", 1.0, "ha", "PROVEN_REAL_EVIDENCE", "RESTRICTED"),
            ("d", "2", "a", 1.0, "x", "PARTIAL", "UNKNOWN"), ("d", "2", "b", None, "y", "PARTIAL", "UNKNOWN")]
    agreed, bad, support = reconcile.provider_consensus(spark.createDataFrame(rows, cols), ["d", "code"], ["px"])
    one = agreed.collect()
    assert len(one) == 1 and one[0]["provider_id"] == "a" and one[0]["evidence_classification"] == "PARTIAL" and one[0]["rights_status"] == "RESTRICTED"
    assert [r["code"] for r in bad.collect()] == ["2"] and [r["raw_sha256"] for r in support.collect()] == ["hb"]


def test_published_table_recheck(spark):
    now = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    saved = table_digest(now).first()
    assert foundation.recheck_published(now, now, ["k"], saved["table_sha256"], 2).count() == 0
    then = spark.createDataFrame([(1, 2.5), (3, 3.0)], "k int, v double")
    got = sorted((r["row_key"], r["code"]) for r in foundation.recheck_published(then, now, ["k"], saved["table_sha256"], 2).collect())
    assert got == [("*", "SAVED_DIGEST_MISMATCH"), ("1", "RECOMPUTED:v"), ("2", "PUBLISHED_ROW_MISSING"), ("3", "PUBLISHED_ROW_UNEXPECTED")]


def test_replay_rows_and_returns(spark):
    cols = ("decision_at timestamp, identity_available_at timestamp, sector_available_at timestamp, feature_available_at timestamp, score_computed_at timestamp, "
            "outcome_available_at timestamp, entry_price double, exit_price double, market_entry double, market_exit double, sector_entry double, sector_exit double, "
            "adjustment_factor double, cash_return double, cost_return double, selected boolean, abstained boolean")
    good = (T0, ts(-5), ts(-5), ts(-2), ts(-1), ts(5), 10.0, 11.0, 100.0, 101.0, 50.0, 51.0, 1.0, 0.0, 0.01, True, False)
    bad = (T0, ts(1), ts(-5), ts(-1), ts(-2), T0, 0.0, 11.0, 100.0, 101.0, 50.0, 51.0, 1.0, 0.0, -0.01, True, True)
    df = spark.createDataFrame([good, bad], cols)
    codes = [r["issue_codes"] for r in foundation.check_replay_rows(df).collect()]
    assert codes == [[], ["LOOK_AHEAD:identity_available_at", "SCORE_BEFORE_FEATURES", "OUTCOME_NOT_AFTER_DECISION", "PRICE_NOT_POSITIVE", "COST_INVALID", "SELECTED_WHILE_ABSTAINED"]]
    r = foundation.replay_returns(df.limit(1)).first()
    assert r["gross"] == pytest.approx(0.1) and r["market_excess"] == pytest.approx(0.08) and r["sector_excess"] == pytest.approx(0.07)


def test_laboratory_rules_and_sums_are_compiled_and_exact(spark):
    def row(factors_known, outcomes_known):
        factors = None if factors_known is None else [(f"F{i}", 1.0, t, "s", "x") for i, t in enumerate(factors_known)]
        return (factors, [(h, 0.5, t, "RAW") for h, t in zip(lab.HORIZONS, outcomes_known)])

    before, at, after = [datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [row(k, o) for k in (None, [], [before, at], [before, after], [before, None], [None]) for o in ([after] * 5, [after] * 4, [after] * 4 + [at], [after] * 4 + [None], [])]
    frame = spark.createDataFrame(rows, "factors array<struct<factor_id:string,value:double,known_at:timestamp,source_id:string,rights_status:string>>, "
                                        "outcomes array<struct<horizon:string,excess_return:double,known_at:timestamp,price_basis:string>>")
    events = frame.select(F.lit("e").alias("event_id"), F.lit("1000").alias("official_code"), F.lit(at).alias("prediction_at"), F.lit(at).alias("event_at"),
                          F.lit(at).alias("evidence_known_at"), F.lit("PROBE").alias("cohort"), F.lit("s").alias("source_id"), F.lit("OFFICIAL_VERIFICATION").alias("source_role"),
                          F.lit("PUBLIC_RESEARCH_ALLOWED").alias("rights_status"), "*", *[F.lit(True).alias(c) for c in ("denominator_complete", "corporate_actions_reconciled", "identity_verified")])
    plain = {
        "FEATURE_LEAKAGE_AFTER_PREDICTION_CUTOFF": F.forall("factors", lambda f: f["known_at"] <= F.col("prediction_at")),
        "OUTCOME_LEAKAGE_AT_PREDICTION_CUTOFF": F.forall("outcomes", lambda o: o["known_at"] > F.col("prediction_at")),
        "OUTCOME_BEFORE_EVENT": F.forall("outcomes", lambda o: o["known_at"] >= F.col("event_at")),
        "OUTCOME_HORIZONS_INCOMPLETE": F.size("outcomes") == 5,
    }
    checked = lab.check_events(events)
    for code, holds in plain.items():
        assert checked.where(F.array_contains("issue_codes", code) == F.coalesce(holds, F.lit(False))).count() == 0, code
    # A lambda would have the rules, or the sums beside it, interpreted row by row.
    weights = lab.base_weights(events)
    for frame in (checked, weights):
        assert "lambda" not in frame._jdf.queryExecution().optimizedPlan().toString()
    values = [2.5, -1e-15, 1e15 + 0.125, -1e15, 0.1, -0.1, None, float("nan"), 7.0 / 3]
    got = {spark.createDataFrame([(v,) for v in values[::step]], "v double").repartition(n).agg(lab.exact_sum(F.col("v"))).first()[0] for step in (1, -1) for n in (1, 4)}
    assert len(got) == 1 and abs(got.pop() - (2.625 + 7.0 / 3 - 1e-15)) < 1e-15


def test_hyperedges_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    links = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (9, "c")], "node long, link string").mapInArrow(counted, "node long, link string")
    got = {(r["node"], r["label"]) for r in events.connected_components(links, "node", "link").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 9)} and seen.value == 5
