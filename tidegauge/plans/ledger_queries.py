"""Hash-chained logs, factor snapshots, decisions and the remaining contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.digest import table_digest
from tidegauge.operators import contracts as ct
from tidegauge.operators import factors as fx
from tidegauge.operators import lab, ledger
from tidegauge.operators.ordering import last_before, positions
from tidegauge.plans import views
from tidegauge.plans.views import SQL, table, with_views

FIELDS = ("ledger_id", "event_seq", "payload")


def log(spark, sf_dir):
    """The event log as one chained ledger per event type; times and types come from the data as they are."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    seq = positions(e, ["event_id"], ["event_type"], "event_seq")
    rev = positions(seq, ["event_seq"], ["event_type", "k"], "revision")
    h = rev.withColumn("ledger_id", F.col("event_type")).withColumn("payload", F.concat_ws("|", F.col("event_id").cast("string"), "props"))
    h = h.withColumn("event_hash", ledger.event_hash(FIELDS))
    h = last_before(h, ["event_seq"], ["ledger_id"], "event_hash", "previous_event_hash")
    recorded = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 1000000))
    return h.select(
        "ledger_id", "event_seq", F.when(F.col("revision") == 1, "CREATE").otherwise("AMEND").alias("event_type"), F.col("k").alias("claim_id"),
        "revision", F.col("ts").alias("issued_at"), recorded.alias("recorded_at"), recorded.alias("effective_at"), "payload",
        F.sha2("payload", 256).alias("payload_hash"), "previous_event_hash", F.col("previous_event_hash").alias("supersedes_event_hash"), "event_hash")


def chain(spark, sf_dir):
    c = ledger.verify_chain(log(spark, sf_dir), FIELDS)
    return c.groupBy("ledger_id", F.concat_ws("|", "issue_codes").alias("issues")).agg(
        F.count("*").alias("rows"), F.sum("event_seq").alias("seq_checksum"))


def seals(spark, sf_dir):
    s = ledger.seal(log(spark, sf_dir))
    return s.select("ledger_id", "event_count", "first_event_hash", "last_event_hash", F.unix_micros("last_event_recorded_at").alias("last_us"))


def seal_digest(spark, sf_dir):
    """Content digest over the hashed chain, which covers ids, order and payload of every event."""
    return ledger.seal(log(spark, sf_dir), ("event_hash", "event_seq")).select("ledger_id", "event_count", "content_sha256")


def table_digests(spark, sf_dir):
    """Digest of every line item by return flag, each spelled as one canonical text of integers, cents and dates."""
    li = table(spark, sf_dir, "lineitem")

    def cents(c):
        return F.round(F.col(c) * 100).cast("bigint").cast("string")

    line = F.concat_ws(
        "|", *[F.col(c).cast("bigint").cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")],
        *[cents(c) for c in ("l_extendedprice", "l_discount", "l_tax")], "l_returnflag", "l_linestatus", F.to_date("l_shipdate").cast("string"))
    return table_digest(li.select("l_returnflag", line.alias("line")), ["line"], ["l_returnflag"])


def outcome_pairs(spark, sf_dir):
    """Orders as decisions, all their line items as outcomes."""
    d = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("decision_id"), F.col("o_orderdate").alias("issued_at"), F.col("o_orderdate").alias("recorded_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("outcome_due_at"))
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("decision_id"), F.col("l_shipdate").alias("outcome_at"))
    p = ledger.pair_outcomes(d, o)
    return p.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("rows"), F.sum("decision_id").alias("ids"))


def _checkpoints(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("run_id"), F.col("props").alias("step"),
                    F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 1000000)).alias("updated_at"))


def checkpoints(spark, sf_dir):
    c = ledger.check_checkpoints(_checkpoints(spark, sf_dir))
    return c.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("rows"), F.sum("seq").alias("seqs"))


def latest_checkpoint(spark, sf_dir):
    return ledger.latest_checkpoint(_checkpoints(spark, sf_dir)).select("run_id", "seq", "step")


REGISTRY = [("security_trading_status", True, 36), ("momentum", True, 720), ("flow", False, 720), ("quality", False, 720)]


def _factor_tables(spark, sf_dir):
    reg = spark.createDataFrame(REGISTRY, "factor_id string, required boolean, window_hours int")
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    universe = e.select(F.lit("d").alias("decision_id"), F.col("user_id").alias("code"), F.lit("2024-01-31").cast("timestamp").alias("decision_at")).distinct()
    name = F.when(F.col("event_type") == "error", "security_trading_status").when(F.col("event_type") == "click", "momentum").when(
        F.col("event_type") == "view", "flow").when(F.col("event_type") == "signup", "quality").otherwise("unlisted")
    last = e.groupBy("user_id", name.alias("factor_id")).agg(F.max_by(F.struct("value", "ts"), "event_id").alias("x"))
    v = F.col("x.value")
    is_status = F.col("factor_id") == "security_trading_status"
    status = F.when(v < 5, "NOT_APPLICABLE").when(v > 200, "REJECTED").otherwise("OBSERVED")
    inputs = last.select(
        F.lit("d").alias("decision_id"), F.col("user_id").alias("code"), "factor_id", status.alias("status"),
        F.when((status == "OBSERVED") & ~is_status, v).alias("value_num"),
        F.when((status == "OBSERVED") & is_status, F.when(v < 60, "TRADING").otherwise("HALTED")).alias("value_enum"),
        F.col("x.ts").alias("available_at"))
    return universe, inputs, reg


def factor_snapshot(spark, sf_dir):
    u, i, r = _factor_tables(spark, sf_dir)
    return fx.snapshot(u, i, r).select("decision_id", "code", "observed", "missing", "not_applicable", "rejected",
                                       F.round("required_coverage", 6).alias("required_coverage"), "disposition", "reason_code")


def factor_inputs(spark, sf_dir):
    u, i, r = _factor_tables(spark, sf_dir)
    c = fx.check_inputs(i, r, u)
    return c.groupBy("factor_id", F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("rows"), F.sum("code").alias("codes"))


def factor_recheck(spark, sf_dir):
    """A snapshot stored without the quality factor against the full inputs."""
    u, i, r = _factor_tables(spark, sf_dir)
    stored = fx.snapshot(u, i.where("factor_id <> 'quality'"), r)
    c = fx.recheck_snapshot(stored, u, i, r)
    return c.select("code", F.concat_ws("|", "issue_codes").alias("issues"))


def factor_admission(spark, sf_dir):
    reg = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("factor_id"), F.when(F.col("n_regionkey") == 0, "INTERNAL").otherwise("PUBLIC_RESEARCH_ALLOWED").alias("rights_status"),
        (F.col("n_regionkey") < 4).alias("point_in_time_tested"), F.lit("1998-01-01").cast("timestamp").alias("available_from"))
    uses = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("factor_id"), F.col("o_orderdate").alias("known_at"))
    c = fx.admit_factors(uses, reg)
    return c.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("uses"), F.sum("o_orderkey").alias("ids"))


def decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(
        "o_orderkey", *[(F.col("o_orderpriority") != "5-LOW").alias(f"gate_{g}") if g == "identity" else F.lit(True).alias(f"gate_{g}") for g in fx.REQUIRED_GATES],
        (F.col("o_orderstatus") != "P").alias("model_validated"), F.when(F.col("c_acctbal") > 9000, 0.5).alias("probability"),
        F.lit(False).alias("probability_allowed"), F.when(F.col("c_acctbal") > 0, F.col("o_totalprice") / 1e6).alias("expected_net_edge"),
        F.lit(0.1).alias("estimated_cost"), F.when(F.col("c_mktsegment") == "MACHINERY", "DETECTED").otherwise("EXECUTABLE").alias("execution_status"),
        (F.col("o_totalprice") / 500000).alias("volatility_percentile"), F.when(F.col("c_nationkey") < 5, "THIN").otherwise("HIGH").alias("liquidity_bucket"),
        F.lit(False).alias("discontinuity_flag"), (F.col("c_nationkey") / 25).alias("fundamental_quality_score"), F.lit(0.3).alias("balance_sheet_risk"),
        F.lit(0.7).alias("cash_flow_quality"))
    d = fx.classify_decisions(rows, 0.05)
    return d.groupBy("decision_status", F.concat_ws("|", "reason_codes").alias("reasons"), F.concat_ws("|", "profile_classes").alias("profiles")).agg(
        F.count("*").alias("rows"), F.sum("o_orderkey").alias("ids"))


def claims(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("claim_id"), F.coalesce("n", F.lit(0)).alias("evidence_count"), (F.col("o_orderstatus") != "F").alias("denominator_complete"),
        (F.col("o_totalprice") > 2000).alias("point_in_time"), F.lit(True).alias("corporate_actions_reconciled"), (F.col("o_orderpriority") != "5-LOW").alias("authority_verified"))
    a = ct.audit_claims(c)
    return a.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("claims"), F.sum("claim_id").alias("ids"))


def holdings(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 4, "0").alias("official_code"),
        F.when(F.col("s_nationkey") == 3, "USD").otherwise("SAR").alias("currency"), F.col("s_acctbal").alias("quantity"), F.lit(1.0).alias("average_cost"))
    return ct.check_positions(p, r"^[0-9]{4,}$").select("official_code", F.concat_ws("|", "issue_codes").alias("issues"))


def claim_support(spark, sf_dir):
    """Orders as claims citing the suppliers of their line items."""
    facts = F.when(F.col("o_orderpriority") == "1-URGENT", "COMPANY_STATUS").when(F.col("o_orderpriority") == "2-HIGH", "COURT_OUTCOME").when(
        F.col("o_orderpriority") == "5-LOW", "SOCIAL_SENTIMENT").otherwise("PRICE")
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), facts.alias("fact_type"),
                                              F.when(F.col("o_orderstatus") == "F", "FINAL").alias("legal_status"))
    cites = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("source_id"))
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source_id"),
        F.when(F.col("s_nationkey") < 8, F.array(F.lit("OFFICIAL_GAZETTE"))).otherwise(F.array(F.lit("NEWS"))).alias("roles"),
        F.when(F.col("s_nationkey") < 4, "PRIMARY_OFFICIAL").when(F.col("s_nationkey") < 14, "SECONDARY").otherwise("COMMUNITY").alias("tier"))
    r = ct.check_claim_support(c, cites, s)
    return r.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("claims"), F.sum("claim_id").alias("ids"))


def no_event(spark, sf_dir):
    """Orders declare the parts of one return flag as sources; the other lines are receipts."""
    li = table(spark, sf_dir, "lineitem")
    rec = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"),
        F.when(F.col("o_orderstatus") == "F", "EVENTS_FOUND").otherwise("NO_VERIFIED_EVENT_FOUND").alias("coverage_status"))
    declared = li.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("record_id"), F.col("l_suppkey").alias("source_id"))
    receipts = li.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("record_id"), F.col("l_suppkey").alias("source_id"),
        F.lit("COMPLETED").alias("access_status"), (F.col("l_quantity") > 3).alias("query_complete"), F.lit(True).alias("pagination_complete"))
    r = ct.check_no_event(rec, declared, receipts)
    return r.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("records"), F.sum("record_id").alias("ids"))


def payloads(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate").cast("string")
    at = F.concat(day, F.when(F.col("o_orderstatus") == "F", "T10:00:00").otherwise("T10:00:00+03:00"))
    obj = F.struct(
        F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("security_code"), F.lit("p").alias("product_id"), F.lit("r").alias("target_rule"),
        at.alias("decision_at"), F.lit("2001-01-01T10:00:00Z").alias("outcome_due_at"), F.lit(5).alias("horizon_sessions"), F.lit("m").alias("model_version"),
        F.lit("e").alias("entry_rule"), (F.col("o_orderpriority") != "5-LOW").alias("eligible"), (F.col("o_totalprice") > 400000).alias("selected"),
        F.lit(False).alias("abstained"), F.lit("t").alias("thesis_episode_id"), F.when(F.col("o_totalprice") > 20000, F.col("o_totalprice") / 400000).alias("probability"),
        F.struct(F.when(F.col("o_orderpriority") == "2-HIGH", 1.0).alias("future_gain")).alias("notes"))
    c = ct.check_forecast_payload(o.select("o_orderkey", F.to_json(obj).alias("payload")))
    return c.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("ids"))


def schedule(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.to_date("l_shipdate")
    a = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("action_id"), F.col("l_suppkey").alias("code"), F.lit("T").alias("ticker"), F.col("l_linestatus").alias("isin"),
        F.to_date("o_orderdate").alias("cum_date"), day.alias("ex_date"), F.date_add(day, F.col("l_linenumber") - 2).alias("record_date"),
        F.when(F.col("l_tax") > 0.02, F.date_add(day, 3)).alias("payment_date"), F.when(F.col("l_discount") > 0.09, F.lit(0.5)).alias("adjustment_factor"), F.lit("pending").alias("factor_status"))
    ident = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.lit("T").alias("ticker"), F.lit("O").alias("isin"))
    c = ct.check_schedule(a, ident, F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("2000-12-31")))
    return c.select(F.explode("issue_codes").alias("code")).groupBy("code").agg(F.count("*").alias("rows"))


def master(spark, sf_dir):
    i = views.identity(spark, sf_dir)
    rows = i.withColumns({"ticker": F.when(F.col("status") == "DELISTED", "").otherwise("T"), "isin": F.concat(F.lit("KW"), F.lpad(F.col("code").cast("string"), 10, "0")),
                          "valid_to": F.date_sub("valid_to", 30), "raw_sha256": F.sha2(F.col("security_id").cast("string"), 256)})
    manifest = table(spark, sf_dir, "lineitem").select(F.sha2(F.col("l_orderkey").cast("string"), 256).alias("sha256"))
    c = ct.check_master(rows, manifest)
    return c.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("rows"), F.sum("security_id").alias("ids"))


def eod_rows(spark, sf_dir):
    """Bars as end-of-day rows of the customer with the supplier's number, against order statuses."""
    b = views.bars(spark, sf_dir).withColumn("row_id", F.concat_ws("@", F.col("code").cast("string"), F.col("trade_date").cast("string"))).withColumn(
        "trading_state", F.when(F.col("trades") > 2, "TRADED_THEN_SUSPENDED").otherwise("TRADED"))
    c = ct.check_eod_rows(b, views.identity(spark, sf_dir), views.status(spark, sf_dir))
    return c.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("rows"), F.sum("code").alias("codes"))


def purge(spark, sf_dir):
    """Orders before 2000 with their last shipment as training samples, later ones as the held-out set."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"))
    s = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_orderdate").alias("feature_cutoff"), F.col("s").alias("label_start"), F.col("e").alias("label_end"))
    test = F.col("feature_cutoff") >= F.lit("2000-01-01").cast("timestamp")
    r = lab.purge_training(s.where(~test), s.where(test), 10)
    return r.groupBy("kept", F.concat_ws("|", "reasons").alias("reasons")).agg(F.count("*").alias("samples"), F.sum("sample_id").alias("ids"))


QUERIES = {
    "ledger_chain": chain, "ledger_seals": seals, "ledger_seal_digest": seal_digest, "table_digests": table_digests, "ledger_outcome_pairs": outcome_pairs,
    "checkpoints_contract": checkpoints, "checkpoints_latest": latest_checkpoint, "factor_snapshot": factor_snapshot, "factor_inputs_contract": factor_inputs,
    "factor_snapshot_recheck": factor_recheck, "factor_admission": factor_admission, "decision_classes": decisions, "claims_audit": claims,
    "positions_contract": holdings, "claim_support": claim_support, "no_event_admissibility": no_event, "forecast_payload_contract": payloads,
    "actions_schedule_contract": schedule, "identity_master_contract": master, "eod_row_contract": eod_rows, "samples_purge_embargo": purge,
}

SQL["lg"] = """
    SELECT *, epoch_us(ts) AS us, epoch_us(ts) + CAST(floor(value * 1000000) AS BIGINT) AS rec, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq,
           row_number() OVER (PARTITION BY event_type, props ORDER BY event_id) AS rev FROM events"""
SQL["lh"] = """
    SELECT *, sha256(event_type || chr(0) || seq || chr(0) || event_id || '|' || props) AS h FROM lg"""
SQL["fin"] = """
    SELECT *, CASE WHEN v < 5 THEN 'NOT_APPLICABLE' WHEN v > 200 THEN 'REJECTED' ELSE 'OBSERVED' END AS st FROM (
      SELECT user_id AS code, CASE event_type WHEN 'error' THEN 'security_trading_status' WHEN 'click' THEN 'momentum' WHEN 'view' THEN 'flow' WHEN 'signup' THEN 'quality'
        ELSE 'unlisted' END AS f, arg_max(value, event_id) AS v, arg_max(ts, event_id) AS t FROM events GROUP BY 1, 2)"""


def tree_sql(key: str, json: str, source: str, name: str, deepest: int = 4) -> list[str]:
    """CTEs of the Merkle trees of the rows whose JSON is the expression ``json``: ``{name}_0`` holds the roots, ``{name}_all`` all nodes."""
    depth = " + ".join(f"CAST(sum(c) > {1024 * 16**k} AS INT)" for k in range(deepest))
    ctes = [
        f"{name}_c AS (SELECT k, h, count(*) AS c FROM (SELECT {key} AS k, sha256({json}) AS h FROM {source}) GROUP BY 1, 2)",
        f"{name}_d AS (SELECT k, {depth} AS depth FROM {name}_c GROUP BY 1)",
        f"""{name}_l AS (SELECT k, depth AS level, left(h, depth) AS prefix, sum(c) AS n, sha256('leaf|' || string_agg(h || ':' || c, '|' ORDER BY h)) AS h
            FROM {name}_c JOIN {name}_d USING (k) GROUP BY 1, 2, 3)""",
        f"{name}_{deepest} AS (SELECT * FROM {name}_l WHERE level = {deepest})"]
    for level in range(deepest - 1, -1, -1):
        ctes.append(f"""{name}_{level} AS (SELECT * FROM {name}_l WHERE level = {level} UNION ALL
            SELECT k, {level}, left(prefix, {level}) AS p, sum(n), sha256('node|' || string_agg(prefix || ':' || h, '|' ORDER BY prefix)) FROM {name}_{level + 1} GROUP BY 1, 3)""")
    return ctes + [f"{name}_all AS ({' UNION ALL '.join(f'SELECT * FROM {name}_{level}' for level in range(deepest + 1))})"]


def digest_sql(key: str, json: str, source: str, names: tuple[str, str, str], views: str = "") -> str:
    """SQL of a table digest over rows whose JSON is the expression ``json``."""
    ctes = ", ".join(tree_sql(key, json, source, "tree"))
    return f"{views + ', ' if views else 'WITH '}{ctes} SELECT k AS {names[0]}, CAST(n AS BIGINT) AS {names[1]}, h AS {names[2]} FROM tree_0"


SNAP = """SELECT u.code, count(*) FILTER (st = 'OBSERVED') AS observed, 4 - count(st) AS missing, count(*) FILTER (st = 'NOT_APPLICABLE') AS not_applicable,
      count(*) FILTER (st = 'REJECTED') AS rejected, count(*) FILTER (st = 'OBSERVED' AND f IN ('security_trading_status', 'momentum')) AS rq,
      coalesce(bool_or(f = 'security_trading_status' AND st = 'OBSERVED' AND v < 60), FALSE) AS tr
    FROM (SELECT DISTINCT user_id AS code FROM events) u LEFT JOIN (SELECT * FROM fin WHERE f <> 'unlisted' {x}) i ON i.code = u.code GROUP BY 1"""
WHY = "CASE WHEN rejected > 0 THEN 'FACTOR_REJECTED' WHEN rq < 2 THEN 'REQUIRED_FACTOR_MISSING' WHEN NOT tr THEN 'SECURITY_NOT_TRADABLE' ELSE 'DISPOSITION_NOT_SUPPLIED' END"
DISP = "CASE WHEN rejected > 0 THEN 'UNRESOLVED' WHEN rq < 2 THEN 'ABSTAINED' WHEN NOT tr THEN 'REJECTED' ELSE 'UNRESOLVED' END"
ORACLE = {
    "ledger_chain": with_views(["lg"], """
        , w AS (SELECT *, lag(rec) OVER (PARTITION BY event_type ORDER BY seq) AS pr, lag(seq) OVER (PARTITION BY event_type, props ORDER BY seq) AS ps FROM lg)
        SELECT event_type AS ledger_id, concat_ws('|', CASE WHEN rec < pr THEN 'TIME_ORDER' END, CASE WHEN rev > 1 AND ps <> seq - 1 THEN 'SUPERSEDES' END) AS issues,
               count(*) AS rows, CAST(sum(seq) AS BIGINT) AS seq_checksum FROM w GROUP BY 1, 2"""),
    "ledger_seals": with_views(["lg", "lh"], """
        SELECT event_type AS ledger_id, count(*) AS event_count, arg_min(h, seq) AS first_event_hash, arg_max(h, seq) AS last_event_hash, arg_max(rec, seq) AS last_us FROM lh GROUP BY 1"""),
    "ledger_seal_digest": digest_sql(
        "event_type", """'{"event_hash":"' || h0 || '","event_seq":' || seq || '}'""", "(SELECT event_type, seq, h AS h0 FROM lh)",
        ("ledger_id", "event_count", "content_sha256"), with_views(["lg", "lh"], "")),
    "table_digests": digest_sql("l_returnflag", """'{"line":"' || line || '"}'""", """(SELECT l_returnflag, concat_ws('|', CAST(l_orderkey AS BIGINT),
        CAST(l_linenumber AS BIGINT), CAST(l_partkey AS BIGINT), CAST(l_suppkey AS BIGINT), CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
        CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), l_returnflag, l_linestatus, CAST(l_shipdate AS DATE)) AS line FROM lineitem)""",
        ("l_returnflag", "row_count", "table_sha256")),
    "ledger_outcome_pairs": """
        WITH o AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
        SELECT concat_ws('|', CASE WHEN o_orderkey IS NULL THEN 'OUTCOME_WITHOUT_DECISION' END, CASE WHEN n > 1 THEN 'OUTCOME_NOT_UNIQUE' END,
                 CASE WHEN l_shipdate <= o_orderdate THEN 'OUTCOME_BEFORE_DECISION' END, CASE WHEN l_shipdate < o_orderdate + INTERVAL 5 DAY THEN 'OUTCOME_BEFORE_DUE' END) AS issues,
               count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS ids FROM o LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
    "checkpoints_contract": with_views(["lg"], """
        , w AS (SELECT *, lag(rec) OVER (ORDER BY event_id) AS pr, count(*) OVER (PARTITION BY user_id, props) AS n FROM lg)
        SELECT concat_ws('|', CASE WHEN rec < pr THEN 'CHECKPOINT_TIME_NOT_MONOTONIC' END, CASE WHEN n > 1 THEN 'CHECKPOINT_STEP_EXISTS' END) AS issues,
               count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS seqs FROM w GROUP BY 1"""),
    "checkpoints_latest": "SELECT user_id AS run_id, max(event_id) AS seq, arg_max(props, event_id) AS step FROM events GROUP BY 1",
    "factor_snapshot": with_views(["fin"], f""", s AS ({SNAP.format(x='')})
        SELECT 'd' AS decision_id, code, observed, missing, not_applicable, rejected, round(rq / 2.0, 6) AS required_coverage, {DISP} AS disposition, {WHY} AS reason_code FROM s"""),
    "factor_inputs_contract": with_views(["fin"], """
        SELECT f AS factor_id, concat_ws('|', CASE WHEN f = 'unlisted' THEN 'FACTOR_UNKNOWN' END,
                 CASE WHEN f = 'security_trading_status' AND st <> 'REJECTED' AND epoch_us(TIMESTAMP '2024-01-31') - epoch_us(t) > 36 * 3600000000 THEN 'OUTSIDE_REGISTRY_WINDOW' END) AS issues,
               count(*) AS rows, CAST(sum(code) AS BIGINT) AS codes FROM fin GROUP BY 1, 2"""),
    "factor_snapshot_recheck": with_views(["fin"], f""", s AS ({SNAP.format(x='')}), z AS ({SNAP.format(x="AND f <> 'quality'")}),
        a AS (SELECT *, {DISP} AS dp, {WHY} AS wy FROM s), b AS (SELECT *, {DISP} AS dp, {WHY} AS wy FROM z)
        SELECT a.code, concat_ws('|', CASE WHEN a.observed <> b.observed THEN 'RECOUNT:observed' END, CASE WHEN a.missing <> b.missing THEN 'RECOUNT:missing' END,
          CASE WHEN a.not_applicable <> b.not_applicable THEN 'RECOUNT:not_applicable' END, CASE WHEN a.rejected <> b.rejected THEN 'RECOUNT:rejected' END,
          CASE WHEN a.dp <> b.dp THEN 'RECOUNT:disposition' END, CASE WHEN a.wy <> b.wy THEN 'RECOUNT:reason_code' END) AS issues FROM a JOIN b USING (code)"""),
    "factor_admission": """
        SELECT concat_ws('|', CASE WHEN n_regionkey = 0 THEN 'RIGHTS_NOT_ADMITTED' END, CASE WHEN n_regionkey >= 4 THEN 'POINT_IN_TIME_UNTESTED' END,
                 CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'NOT_AVAILABLE_AT_KNOWN_AT' END) AS issues, count(*) AS uses, CAST(sum(o_orderkey) AS BIGINT) AS ids
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""",
    "decision_classes": """
        WITH d AS (SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderpriority = '5-LOW' THEN 'IDENTITY_GATE_FAILED' END, CASE WHEN o_orderstatus = 'P' THEN 'MODEL_NOT_PROSPECTIVELY_VALIDATED' END,
             CASE WHEN c_acctbal > 9000 THEN 'PROBABILITY_NOT_ALLOWED' END, CASE WHEN c_acctbal <= 0 THEN 'EDGE_OR_COST_MISSING' END,
             CASE WHEN c_acctbal > 0 AND o_totalprice / 1e6 <= 0.1::DOUBLE + 0.05::DOUBLE THEN 'EDGE_NOT_ABOVE_COST_AND_MARGIN' END,
             CASE WHEN c_mktsegment = 'MACHINERY' THEN 'EXECUTION_REQUIRED_AND_NOT_PASSED' END) AS reasons,
             CASE WHEN o_totalprice / 500000 >= 0.75 OR c_nationkey < 5 THEN 'SPECULATIVE_PROFILE' END AS sp, CASE WHEN c_nationkey / 25 >= 0.6 THEN 'INVESTMENT_PROFILE' END AS ip
           FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT CASE WHEN reasons = '' THEN 'HIGH_BUY_OPPORTUNITY' WHEN reasons LIKE '%IDENTITY_GATE%' OR reasons LIKE '%MODEL_NOT%' THEN 'WATCH' ELSE 'ABSTAIN' END AS decision_status,
               reasons, CASE WHEN sp IS NULL AND ip IS NULL THEN 'UNCLASSIFIED_PROFILE' ELSE concat_ws('|', sp, ip) END AS profiles, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS ids
        FROM d GROUP BY 1, 2, 3""",
    "claims_audit": """
        SELECT concat_ws('|', CASE WHEN n IS NULL THEN 'NO_EVIDENCE' END, CASE WHEN o_orderstatus = 'F' THEN 'INCOMPLETE_DENOMINATOR' END,
                 CASE WHEN o_totalprice <= 2000 THEN 'POINT_IN_TIME_FAILURE' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'AUTHORITY_UNVERIFIED' END) AS issues,
               count(*) AS claims, CAST(sum(o_orderkey) AS BIGINT) AS ids
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""",
    "positions_contract": """
        SELECT lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS official_code, concat_ws('|', CASE WHEN s_nationkey = 3 THEN 'CURRENCY_MUST_BE_SAR' END,
               CASE WHEN s_acctbal < 0 THEN 'NEGATIVE_POSITION_VALUE' END) AS issues FROM supplier""",
    "claim_support": """
        WITH c AS (SELECT o_orderkey, min(o_orderpriority) AS p, min(o_orderstatus) AS s, count(l_orderkey) AS n, bool_or(s_nationkey < 8) AS gz, bool_or(s_nationkey < 4) AS pr, bool_and(s_nationkey >= 14) AS cm
                   FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
        SELECT concat_ws('|', CASE WHEN n = 0 THEN 'CLAIM_WITHOUT_SOURCE' END, CASE WHEN p = '1-URGENT' AND NOT coalesce(gz, FALSE) THEN 'COMPANY_FACT_NEEDS_REGISTRY' END,
                 CASE WHEN p = '1-URGENT' AND NOT coalesce(pr, FALSE) THEN 'COMPANY_FACT_NEEDS_PRIMARY' END, CASE WHEN p = '2-HIGH' AND NOT coalesce(gz, FALSE) THEN 'LEGAL_FACT_NEEDS_RECORD' END,
                 CASE WHEN p = '2-HIGH' AND s <> 'F' THEN 'LEGAL_FACT_NEEDS_STATUS' END, CASE WHEN p <> '5-LOW' AND cm THEN 'COMMUNITY_CANNOT_ESTABLISH_FACT' END) AS issues,
               count(*) AS claims, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM c GROUP BY 1""",
    "no_event_admissibility": """
        WITH d AS (SELECT l_orderkey AS k, l_suppkey AS s, bool_or(l_returnflag <> 'R') AS d, count(*) FILTER (l_linestatus = 'O') > 0 AS r,
                     bool_and(l_quantity > 3) FILTER (l_linestatus = 'O') AS ok FROM lineitem GROUP BY 1, 2 HAVING d OR r),
        j AS (SELECT k, count(*) FILTER (d) AS nd, count(*) FILTER (r) AS nr, bool_or(d <> r) AS df, bool_and(ok) AS ok FROM d GROUP BY 1)
        SELECT concat_ws('|', CASE WHEN q AND coalesce(nd, 0) = 0 THEN 'NO_DECLARED_SOURCES' END, CASE WHEN q AND coalesce(nr, 0) = 0 THEN 'NO_SEARCH_RECEIPTS' END,
                 CASE WHEN q AND NOT coalesce(ok, TRUE) THEN 'SOURCE_CHECK_INCOMPLETE' END, CASE WHEN q AND df THEN 'RECEIPTS_DO_NOT_COVER_DECLARED' END) AS issues,
               count(*) AS records, CAST(sum(o_orderkey) AS BIGINT) AS ids
        FROM (SELECT o_orderkey, o_orderstatus <> 'F' AS q FROM orders) LEFT JOIN j ON k = o_orderkey GROUP BY 1""",
    "forecast_payload_contract": """
        SELECT concat_ws('|', CASE WHEN o_orderpriority = '2-HIGH' THEN 'FORBIDDEN_OUTCOME_FIELD' END,
                 CASE WHEN o_orderstatus = 'F' OR o_orderdate + INTERVAL 7 HOUR >= TIMESTAMP '2001-01-01 10:00:00' THEN 'OUTCOME_DUE_NOT_AFTER_DECISION' END,
                 CASE WHEN o_totalprice > 400000 AND o_orderpriority = '5-LOW' THEN 'INVALID_SELECTION_FLAGS' END,
                 CASE WHEN o_totalprice <= 20000 THEN 'SCORE_OR_PROBABILITY_REQUIRED' END, CASE WHEN o_totalprice > 400000 THEN 'PROBABILITY_OUT_OF_RANGE' END) AS issues,
               count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders GROUP BY 1""",
    "actions_schedule_contract": """
        WITH a AS (SELECT *, CAST(o_orderdate AS DATE) AS cum, CAST(l_shipdate AS DATE) AS ex, CAST(l_shipdate AS DATE) + l_linenumber - 2 AS rc,
                     CASE WHEN l_tax > 0.02 THEN CAST(l_shipdate AS DATE) + 3 END AS pay, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n
                   FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
        SELECT code, count(*) AS rows FROM (SELECT unnest(list_filter([CASE WHEN n > 1 THEN 'ACTION_ID_DUPLICATE' END, CASE WHEN l_linestatus <> 'O' THEN 'ACTION_IDENTITY_MISMATCH' END,
            CASE WHEN NOT (cum < ex AND ex <= rc) THEN 'ACTION_DATES_OUT_OF_ORDER' END, CASE WHEN pay < rc THEN 'PAYMENT_PRECEDES_RECORD' END,
            CASE WHEN greatest(cum, ex, rc, pay) < DATE '1996-01-01' OR least(cum, ex, rc, pay) > DATE '2000-12-31' THEN 'ACTION_OUTSIDE_WINDOW' END,
            CASE WHEN l_discount > 0.09 THEN 'FACTOR_MUST_BE_PENDING' END], lambda x: x IS NOT NULL)) AS code FROM a) GROUP BY 1""",
    "identity_master_contract": with_views(["ident"], """
        SELECT concat_ws('|', CASE WHEN s = 'F' THEN 'MASTER_KEYS_REQUIRED' END, CASE WHEN valid_to - 30 < valid_from THEN 'VALID_TO_PRECEDES_VALID_FROM' END,
                 CASE WHEN security_id NOT IN (SELECT l_orderkey FROM lineitem) THEN 'RAW_SHA256_UNRESOLVED' END) AS issues,
               count(*) AS rows, CAST(sum(security_id) AS BIGINT) AS ids FROM ident GROUP BY 1"""),
    "eod_row_contract": with_views(["bars", "ident"], """
        SELECT concat_ws('|', CASE WHEN i.code IS NULL THEN 'IDENTITY_NOT_UNIQUE_ON_DATE|STATUS_NOT_UNIQUE_ON_DATE' END,
                 CASE WHEN i.code IS NOT NULL AND NOT ((status = 'TRADING' AND trades <= 2) OR (status = 'SUSPENDED' AND trades > 2)) THEN 'STATE_CONFLICTS_WITH_STATUS' END) AS issues,
               count(*) AS rows, CAST(sum(b.code) AS BIGINT) AS codes
        FROM bars b LEFT JOIN ident i ON i.code = b.code AND b.trade_date >= valid_from AND (valid_to IS NULL OR b.trade_date <= valid_to) GROUP BY 1"""),
    "samples_purge_embargo": """
        WITH s AS (SELECT o_orderkey, o_orderdate AS f, max(l_shipdate) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
        t AS (SELECT min(f) AS a, max(e) AS z FROM s WHERE f >= TIMESTAMP '2000-01-01')
        SELECT e < a AS kept, CASE WHEN e >= a THEN 'NOT_STRICTLY_PRIOR' ELSE '' END AS reasons, count(*) AS samples, CAST(sum(o_orderkey) AS BIGINT) AS ids
        FROM s, t WHERE f < TIMESTAMP '2000-01-01' GROUP BY 1, 2""",
}
