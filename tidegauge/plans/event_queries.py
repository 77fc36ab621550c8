"""Canonical events, windowed features, components, sentiment and status folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import events as ev
from tidegauge.plans.views import SQL, table, with_views
from tidegauge.session import materialise


def source_events(spark, sf_dir):
    """Event log as source events: a view repeats the first event of its user and content key."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    first = e.groupBy("user_id", "k").agg(F.min("event_id").alias("first_id"))
    j = e.join(first, ["user_id", "k"])
    repost = (F.col("event_type") == "view") & (F.col("first_id") < F.col("event_id"))
    return j.select(
        "event_id", F.col("user_id").alias("code"), F.concat(F.lit("s"), F.pmod(F.col("k").cast("int"), F.lit(10)).cast("string")).alias("source_id"),
        F.when(F.col("event_type") == "signup", "OFFICIAL_FILING").when(F.col("event_type") == "purchase", "NEWS_CONTEXT")
        .when(F.col("event_type") == "error", "FINANCIAL_CONTEXT").otherwise("FORUM").alias("source_role"),
        F.upper("event_type").alias("event_type"),
        F.when(F.col("value") > 60, "UP").when(F.col("value") < 20, "BEARISH").otherwise("FLAT").alias("direction"),
        (F.floor(F.least(F.col("value"), F.lit(100.0))) / 100.0).alias("novelty"),
        F.col("ts").alias("event_at"), F.col("ts").alias("published_at"), F.col("ts").alias("first_available_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 1000000)).alias("captured_at"),
        F.sha2("k", 256).alias("content_hash"), F.sha2(F.concat_ws("|", "k", "event_type"), 256).alias("evidence_hash"),
        F.when(repost, "REPUBLISHED").otherwise("STANDALONE").alias("relation_type"),
        F.when(repost, F.col("first_id")).alias("original_event_id"), "k", "value",
    )


def canonical(spark, sf_dir):
    groups, _ = ev.canonicalise(source_events(spark, sf_dir))
    return groups.select("code", "canonical_id", "event_type", "direction", "novelty",
                         F.unix_micros("first_available_at").alias("first_us"), F.unix_micros("last_captured_at").alias("last_us"),
                         "diffusion_count", "source_diversity", "official_fact_seen")


def evidence_union(spark, sf_dir):
    """Union of evidence hashes per canonical event, kept long and counted."""
    _, members = ev.canonicalise(source_events(spark, sf_dir))
    return members.select("code", "canonical_id", "evidence_hash").distinct().groupBy("code").agg(
        F.count("*").alias("hashes"), F.min("evidence_hash").alias("first_hash"))


def _decisions(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("code")).distinct()
    days = F.array(*[F.lit(d).cast("timestamp") for d in ("2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29")])
    return users.withColumn("decision_at", F.explode(days)).withColumn(
        "decision_id", F.concat_ws("@", F.col("code").cast("string"), F.to_date("decision_at").cast("string")))


def features(spark, sf_dir):
    """Every fifth user's windows are proven searched, with or without events."""
    d = _decisions(spark, sf_dir)
    coverage = d.where("code % 5 = 0").select("decision_id", F.sha2("decision_id", 256).alias("evidence_hash"))
    f = ev.event_features(d, source_events(spark, sf_dir), coverage)
    return f.select("decision_id", "official_event_count_30d", "social_diffusion_7d", "source_diversity_30d", "source_availability_state", "evidence_count",
                    *[F.round(c, 6).alias(c) for c in ("official_event_net_30d", "context_event_net_30d", "social_event_net_7d")])


def feature_contract(spark, sf_dir):
    """Raw events as feature rows, one name per type, repeated keys included."""
    e = source_events(spark, sf_dir)
    rows = e.select(
        F.to_date("event_at").cast("string").alias("decision_id"), "code",
        F.when(F.col("event_type") == "SIGNUP", "label_net").otherwise(F.lower("event_type")).alias("feature_name"),
        F.when(F.col("event_type") == "ERROR", "UNKNOWN_NOT_OBSERVED").otherwise("OBSERVED").alias("source_availability_state"),
        F.col("captured_at").alias("available_at"), F.col("published_at"),
        (F.col("event_at") + F.expr("INTERVAL 60 SECONDS")).alias("decision_at"), F.col("value").alias("feature_value"))
    c = ev.check_features(rows)
    return c.select(F.explode("issue_codes").alias("code")).groupBy("code").agg(F.count("*").alias("rows"))


def contract(spark, sf_dir):
    e = source_events(spark, sf_dir).withColumn("captured_at", F.timestamp_micros(F.unix_micros("captured_at") - 30000000))
    c = ev.check_events(e)
    return c.groupBy(F.concat_ws("|", "issue_codes").alias("issues")).agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


def relations(spark, sf_dir):
    """All events; every seventh repost names an original that does not exist."""
    e = source_events(spark, sf_dir)
    lost = F.col("original_event_id") + F.when(F.col("event_id") % 7 == 0, 1000000000000).otherwise(0)
    return ev.relation_issues(e.withColumn("original_event_id", lost))


def tone(spark, sf_dir):
    e = source_events(spark, sf_dir)
    rows = e.select(F.col("event_type").alias("code"), F.col("k").alias("origin_id"), F.col("code").alias("author_id"),
                    F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 45.0) / 100.0)).alias("tone"),
                    (F.lit(1.0) / (F.lit(1.0) + F.floor(F.col("value") / 10))).alias("reliability"), F.col("event_id").alias("seq"))
    s = ev.sentiment(rows)
    return s.select("code", "unique_origins", "independent_authors", "direction",
                    *[F.round(c, 6).alias(c) for c in ("weighted_tone", "strength", "materiality")])


def _context(spark, sf_dir):
    e = source_events(spark, sf_dir)
    return e.withColumns({
        "scope": F.lit("SECURITY"), "scope_key": F.col("code").cast("string"),
        "origin_hash": F.sha2(F.concat_ws("|", F.to_date("event_at").cast("string"), "event_type"), 256),
        "source_group_id": F.col("source_id"), "materiality": F.col("novelty"), "confidence": F.lit(0.5),
        "factual_status": F.when(F.col("event_type") == "SIGNUP", "OFFICIAL_CONFIRMED").when(F.col("value") > 120, "CONTESTED")
        .when(F.col("event_type") == "PURCHASE", "MULTISOURCE_CORROBORATED").otherwise("ROUTING_ONLY"),
        "contradiction_status": F.when(F.col("value") > 120, "CONTESTED").when(F.col("value") > 100, "RESOLVED").otherwise("UNKNOWN"),
        "correction_status": F.when(F.col("value") > 150, "SUPERSEDED").when(F.col("value") > 90, "CORRECTED").otherwise("CURRENT")})


def components(spark, sf_dir):
    return ev.context_components(_context(spark, sf_dir))


def component_groups(spark, sf_dir):
    e = materialise(_context(spark, sf_dir))  # read for the components and for their groups
    g = ev.context_groups(e, ev.context_components(e))
    return g.select("component", "canonical_event_id", "diffusion_count", "independent_source_groups", "factual_status",
                    "contradiction_status", "correction_status", F.concat_ws("|", "issue_codes").alias("issues"))


def notices(spark, sf_dir):
    """One notice per user and day from that day's first event; every twentieth user's notices carry one id."""
    e = table(spark, sf_dir, "events")
    one = e.groupBy(F.col("user_id").alias("code"), F.to_date("ts").alias("effective_date")).agg(
        F.min("event_id").alias("id"), F.min_by("event_type", "event_id").alias("t"))
    move = F.when(F.col("t") == "error", "SUSPEND").when(F.col("t") == "purchase", "RESUME").when(F.col("t") == "signup", "DELIST").otherwise("RELIST")
    own = F.when(F.col("code") % 20 == 1, F.concat(F.lit("U"), F.col("code").cast("string"))).otherwise(F.lpad(F.col("id").cast("string"), 12, "0"))
    return one.select("code", own.alias("notice_id"), "effective_date", move.alias("event_type"),
                      F.sha2(F.concat_ws("|", F.col("code").cast("string"), F.col("effective_date").cast("string")), 256).alias("raw_sha256"))


def _fold(spark, sf_dir):
    """Some users lack an opening or a current state, some have an unknown one."""
    code = F.col("code")
    opening = table(spark, sf_dir, "events").select(F.col("user_id").alias("code")).distinct().withColumns({
        "status": F.when(code % 50 == 7, None).when(code % 50 == 8, "HALTED").otherwise("TRADING"),
        "current_status": F.when(code % 10 == 3, None).when(code % 10 == 4, "UNKNOWN").otherwise("TRADING"),
        "raw_sha256": F.sha2(code.cast("string"), 256)})
    d = lambda s: F.lit(s).cast("date")
    return ev.status_intervals(opening, notices(spark, sf_dir), d("2024-01-01"), d("2024-02-15"))


def status_intervals(spark, sf_dir):
    i, _ = _fold(spark, sf_dir)
    return i.select("code", "status", F.col("effective_from").cast("string").alias("effective_from"),
                    F.col("effective_to").cast("string").alias("effective_to"), "start_notice_id", "end_notice_id",
                    F.size("evidence_hashes").cast("bigint").alias("evidence"))


def status_issues(spark, sf_dir):
    _, p = _fold(spark, sf_dir)
    return p.groupBy("code").agg(F.count("*").alias("issues"), F.sum(F.col("row_key").cast("bigint")).alias("keys"))


QUERIES = {
    "events_contract": contract, "events_relation_issues": relations, "events_canonical": canonical, "events_evidence_union": evidence_union,
    "events_features": features, "events_feature_contract": feature_contract, "events_sentiment": tone,
    "events_context_components": components, "events_context_groups": component_groups,
    "status_intervals": status_intervals, "status_interval_issues": status_issues,
}

SQL["sev"] = """
    SELECT *, CASE WHEN event_type = 'view' AND first_id < event_id THEN first_id END AS orig,
      CASE event_type WHEN 'signup' THEN 'F' WHEN 'purchase' THEN 'N' WHEN 'error' THEN 'N' ELSE 'S' END AS role,
      CASE WHEN value > 60 THEN 'UP' WHEN value < 20 THEN 'BEARISH' ELSE 'FLAT' END AS direction,
      floor(least(value, 100.0)) / 100.0 AS novelty, epoch_us(ts) AS us, epoch_us(ts) + CAST(floor(value * 1000000) AS BIGINT) AS cap,
      's' || (CAST(k AS INT) % 10) AS source_id
    FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, k) AS first_id FROM (SELECT *, props->>'$.k' AS k FROM events))"""
SQL["ctx"] = """
    SELECT *, CAST(ts AS DATE) || '|' || event_type AS ok FROM sev"""
CC = """WITH RECURSIVE sev AS ({sev}), ctx AS ({ctx}),
    ed AS (SELECT DISTINCT a.event_id AS x, b.event_id AS y FROM ctx a JOIN ctx b ON a.user_id = b.user_id AND (a.k = b.k OR a.ok = b.ok)),
    cc(x, c) AS (SELECT event_id, event_id FROM ctx UNION SELECT ed.y, cc.c FROM cc JOIN ed ON ed.x = cc.x AND cc.c < ed.y),
    comp AS (SELECT x AS event_id, min(c) AS component FROM cc GROUP BY 1)""".format(sev=SQL["sev"], ctx=SQL["ctx"])
FOLD = """WITH RECURSIVE n0 AS (SELECT user_id AS code, CAST(ts AS DATE) AS d, min(event_id) AS id, arg_min(event_type, event_id) AS t FROM events GROUP BY 1, 2),
    n AS (SELECT code, d, CASE WHEN code % 20 = 1 THEN 'U' || code ELSE lpad(CAST(id AS VARCHAR), 12, '0') END AS id, CASE t WHEN 'error' THEN 'SUSPEND' WHEN 'purchase' THEN 'RESUME' WHEN 'signup' THEN 'DELIST' ELSE 'RELIST' END AS m,
          row_number() OVER (PARTITION BY code ORDER BY d) AS rn FROM n0),
    f(code, rn, state, moved, d, id, prev, m) AS (
      SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'TRADING', TRUE, DATE '2024-01-01', 'OPENING_STATE', 'TRADING', '' FROM events WHERE user_id % 50 NOT IN (7, 8)
      UNION ALL SELECT f.code, n.rn, coalesce(z.nxt, f.state), z.nxt IS NOT NULL, n.d, n.id, f.state, n.m FROM f JOIN n ON n.code = f.code AND n.rn = f.rn + 1
      LEFT JOIN (VALUES ('TRADING','SUSPEND','SUSPENDED'), ('SUSPENDED','RESUME','TRADING'), ('TRADING','DELIST','DELISTED'),
                        ('SUSPENDED','DELIST','DELISTED'), ('DELISTED','RELIST','TRADING')) z(s, m, nxt) ON z.s = f.state AND z.m = n.m)"""
ORACLE = {
    "events_contract": with_views(["sev"], """
        SELECT CASE WHEN cap - 30000000 < us THEN 'AVAILABLE_AFTER_CAPTURED' ELSE '' END AS issues, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM sev GROUP BY 1"""),
    "events_relation_issues": with_views(["sev"], """
        SELECT 'event_relations' AS operator, CAST(event_id AS VARCHAR) AS row_key, 'MISSING_ORIGINAL_EVENT' AS code, 'ERROR' AS severity
        FROM sev WHERE orig IS NOT NULL AND event_id % 7 = 0"""),
    "events_canonical": with_views(["sev"], """
        , c AS (SELECT *, CASE WHEN orig IS NOT NULL THEN CAST(orig AS VARCHAR) WHEN event_id IN (SELECT orig FROM sev WHERE orig IS NOT NULL)
                  THEN CAST(event_id AS VARCHAR) ELSE sha256(k) END AS canonical_id FROM sev)
        SELECT user_id AS code, canonical_id, upper(arg_min(event_type, (us, event_id))) AS event_type, arg_min(direction, (us, event_id)) AS direction,
               arg_min(novelty, (us, event_id)) AS novelty, min(us) AS first_us, max(cap) AS last_us, count(*) AS diffusion_count,
               count(DISTINCT source_id) AS source_diversity, bool_or(role = 'F') AS official_fact_seen FROM c GROUP BY 1, 2"""),
    "events_evidence_union": with_views(["sev"], """
        , c AS (SELECT DISTINCT user_id AS code, CASE WHEN orig IS NOT NULL THEN CAST(orig AS VARCHAR) WHEN event_id IN (SELECT orig FROM sev WHERE orig IS NOT NULL)
                  THEN CAST(event_id AS VARCHAR) ELSE sha256(k) END AS canonical_id, sha256(k || '|' || event_type) AS h FROM sev)
        SELECT code, count(*) AS hashes, min(h) AS first_hash FROM c GROUP BY 1"""),
    "events_features": with_views(["sev"], """
        , dec AS (SELECT u AS code, d, CAST(u AS VARCHAR) || '@' || CAST(d AS VARCHAR) AS decision_id FROM (SELECT DISTINCT user_id AS u FROM events),
                  (VALUES (DATE '2024-01-08'), (DATE '2024-01-15'), (DATE '2024-01-22'), (DATE '2024-01-29')) t(d)),
        p AS (SELECT decision_id, s.*, us >= epoch_us(CAST(d AS TIMESTAMP)) - 7 * 86400000000 AS wk FROM dec JOIN sev s ON s.user_id = dec.code
              AND us <= epoch_us(CAST(d AS TIMESTAMP)) AND us >= epoch_us(CAST(d AS TIMESTAMP)) - 30 * 86400000000),
        r AS (SELECT DISTINCT decision_id, orig FROM p WHERE orig IS NOT NULL), r7 AS (SELECT DISTINCT decision_id, orig FROM p WHERE orig IS NOT NULL AND wk),
        c AS (SELECT p.*, CASE WHEN p.orig IS NOT NULL THEN CAST(p.orig AS VARCHAR) WHEN r.orig IS NOT NULL THEN CAST(event_id AS VARCHAR) ELSE k END AS cid
              FROM p LEFT JOIN r ON r.decision_id = p.decision_id AND r.orig = event_id),
        c7 AS (SELECT p.*, CASE WHEN p.orig IS NOT NULL THEN CAST(p.orig AS VARCHAR) WHEN r7.orig IS NOT NULL THEN CAST(event_id AS VARCHAR) ELSE 'h' || k END AS cid
              FROM p LEFT JOIN r7 ON r7.decision_id = p.decision_id AND r7.orig = event_id WHERE wk),
        g AS (SELECT decision_id, cid, arg_min(CASE direction WHEN 'UP' THEN 1 WHEN 'BEARISH' THEN -1 ELSE 0 END * novelty, (us, event_id)) AS v,
                bool_or(role = 'F') AS f, bool_or(role = 'N') AS n FROM (SELECT * REPLACE (CASE WHEN cid = k THEN 'h' || k ELSE cid END AS cid) FROM c) GROUP BY 1, 2),
        g7 AS (SELECT decision_id, cid, arg_min(CASE direction WHEN 'UP' THEN 1 WHEN 'BEARISH' THEN -1 ELSE 0 END * novelty, (us, event_id)) AS v, count(*) AS n FROM c7
               GROUP BY 1, 2 HAVING bool_or(role = 'S')),
        a AS (SELECT decision_id, coalesce(sum(v) FILTER (f), 0) AS o, count(*) FILTER (f) AS oc, coalesce(sum(v) FILTER (NOT f AND n), 0) AS x FROM g GROUP BY 1),
        b AS (SELECT decision_id, sum(v) AS s, sum(n) AS sp FROM g7 GROUP BY 1), dv AS (SELECT decision_id, count(DISTINCT source_id) AS dd FROM p GROUP BY 1)
        , ec AS (SELECT decision_id, count(DISTINCT sha256(k || '|' || event_type)) AS e FROM p GROUP BY 1),
        fin AS (SELECT *, oc IS NOT NULL OR code % 5 = 0 AS obs FROM dec LEFT JOIN ec USING (decision_id) LEFT JOIN a USING (decision_id) LEFT JOIN b USING (decision_id) LEFT JOIN dv USING (decision_id))
        SELECT decision_id, CASE WHEN obs THEN coalesce(oc, 0) END AS official_event_count_30d, CASE WHEN obs THEN CAST(coalesce(sp, 0) AS BIGINT) END AS social_diffusion_7d,
               CASE WHEN obs THEN coalesce(dd, 0) END AS source_diversity_30d, CASE WHEN obs THEN 'OBSERVED' ELSE 'UNKNOWN_NOT_OBSERVED' END AS source_availability_state,
               coalesce(e, 0) + CASE WHEN code % 5 = 0 THEN 1 ELSE 0 END AS evidence_count, CASE WHEN obs THEN round(coalesce(o, 0), 6) END AS official_event_net_30d,
               CASE WHEN obs THEN round(coalesce(x, 0), 6) END AS context_event_net_30d, CASE WHEN obs THEN round(coalesce(s, 0), 6) END AS social_event_net_7d FROM fin"""
        .replace("ELSE k END AS cid\n", "ELSE 'h' || k END AS cid\n")
        .replace("(SELECT * REPLACE (CASE WHEN cid = k THEN 'h' || k ELSE cid END AS cid) FROM c)", "c")),
    "events_feature_contract": with_views(["sev"], """
        , r AS (SELECT *, count(*) OVER (PARTITION BY CAST(ts AS DATE), user_id, event_type) AS n FROM sev)
        SELECT code, count(*) AS rows FROM (SELECT unnest(list_filter([CASE WHEN n > 1 THEN 'FEATURE_KEY_DUPLICATE' END,
            CASE WHEN event_type = 'signup' THEN 'LABEL_LIKE_FEATURE_NAME' END,
            CASE WHEN event_type <> 'error' AND cap > us + 60000000 THEN 'LOOK_AHEAD_AVAILABILITY' END,
            CASE WHEN event_type = 'error' THEN 'UNKNOWN_ENCODED_AS_VALUE' END], lambda x: x IS NOT NULL)) AS code FROM r) GROUP BY 1"""),
    "events_sentiment": with_views(["sev"], """
        , t AS (SELECT upper(event_type) AS code, k, user_id, greatest(-1.0, least(1.0, (value - 45) / 100)) AS tone, 1 / (1 + floor(value / 10)) AS rel, event_id FROM sev),
        b AS (SELECT *, row_number() OVER (PARTITION BY code, k ORDER BY rel DESC, event_id) AS rn FROM t),
        a AS (SELECT code, count(*) AS o, count(DISTINCT user_id) AS n, sum(tone * rel) / sum(rel) AS w FROM b WHERE rn = 1 GROUP BY 1)
        SELECT code, o AS unique_origins, n AS independent_authors, CASE WHEN n >= 2 AND w > 0.10 THEN 'POSITIVE' WHEN n >= 2 AND w < -0.10 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS direction,
               round(w, 6) AS weighted_tone, round(CASE WHEN n >= 2 THEN least(1.0, abs(w) / 0.75) ELSE 0 END, 6) AS strength, round(least(0.5, n / 10), 6) AS materiality FROM a"""),
    "events_context_components": CC + " SELECT event_id, component FROM comp",
    "events_context_groups": CC + """, j AS (SELECT c.*, component, CASE WHEN event_type = 'signup' THEN 'O' WHEN value > 120 THEN 'C' WHEN event_type = 'purchase' THEN 'M' ELSE 'R' END AS fs
            FROM ctx c JOIN comp USING (event_id))
        SELECT component, 'ctx-' || substr(sha256('SECURITY|' || CAST(arg_min(user_id, (us, event_id)) AS VARCHAR) || '|' || arg_min(sha256(ok_up), (us, event_id)) || '|' || arg_min(sha256(k), (us, event_id))), 1, 24) AS canonical_event_id,
               count(*) AS diffusion_count, count(DISTINCT source_id) AS independent_source_groups,
               CASE WHEN bool_or(fs = 'C') THEN 'CONTESTED' WHEN bool_or(fs = 'O') THEN 'OFFICIAL_CONFIRMED' WHEN count(DISTINCT source_id) >= 2 AND bool_or(fs = 'M') THEN 'MULTISOURCE_CORROBORATED'
                    WHEN bool_and(fs = 'R') THEN 'ROUTING_ONLY' ELSE 'UNCONFIRMED' END AS factual_status,
               CASE WHEN bool_or(fs = 'C') OR bool_or(value > 120) THEN 'CONTESTED' WHEN bool_or(value > 100) THEN 'RESOLVED' ELSE 'UNKNOWN' END AS contradiction_status,
               CASE WHEN bool_or(value > 150) THEN 'SUPERSEDED' WHEN bool_or(value > 90) THEN 'CORRECTED' ELSE 'CURRENT' END AS correction_status,
               concat_ws('|', CASE WHEN count(DISTINCT event_type || direction) > 1 THEN 'DUPLICATE_HAS_CONFLICTING_SEMANTICS' END,
                         CASE WHEN count(DISTINCT novelty) > 1 THEN 'DUPLICATE_HAS_CONFLICTING_VALUES' END) AS issues
        FROM (SELECT *, CAST(ts AS DATE) || '|' || upper(event_type) AS ok_up FROM j) GROUP BY 1""",
    "status_intervals": FOLD + """
        SELECT code, state AS status, CAST(d AS VARCHAR) AS effective_from, CAST(coalesce(nd - 1, DATE '2024-02-15') AS VARCHAR) AS effective_to,
               id AS start_notice_id, coalesce(nid, 'CURRENT_SNAPSHOT') AS end_notice_id, i + CASE WHEN nid IS NULL THEN 0 ELSE 1 END AS evidence
        FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY rn) AS i, lead(d) OVER (PARTITION BY code ORDER BY rn) AS nd, lead(id) OVER (PARTITION BY code ORDER BY rn) AS nid FROM f WHERE moved)
        WHERE coalesce(nd - 1, DATE '2024-02-15') >= d""",
    "status_interval_issues": FOLD + """
        SELECT issue AS code, count(*) AS issues, CAST(sum(code) AS BIGINT) AS keys FROM (
          SELECT code, 'INVALID_STATUS_TRANSITION:' || prev || ':' || m || ':' || CAST(d AS VARCHAR) AS issue FROM f WHERE NOT moved
          UNION ALL SELECT code, 'MISSING_CURRENT_STATUS' FROM (SELECT DISTINCT code FROM f) WHERE code % 10 IN (3, 4)
          UNION ALL SELECT code, 'CURRENT_STATUS_RECONCILIATION:' || arg_max(state, rn) || ':TRADING' FROM f WHERE code % 10 NOT IN (3, 4)
            GROUP BY code HAVING arg_max(state, rn) <> 'TRADING'
          UNION ALL SELECT code, 'DUPLICATE_STATUS_NOTICE_ID' FROM n WHERE code % 20 = 1 GROUP BY code HAVING count(*) > 1
          UNION ALL SELECT DISTINCT user_id, CASE user_id % 50 WHEN 7 THEN 'MISSING_OPENING_STATE' ELSE 'INVALID_OPENING_STATE' END FROM events WHERE user_id % 50 IN (7, 8)) GROUP BY 1""",
}
