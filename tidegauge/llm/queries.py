"""Thin queries: the given tables as source events and back.

A document is a source event (``doc_id`` as ``event_id``, ``text`` as ``raw_text``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm import disclosure, hosts, language, licences, lines, ngrams, packing, prefixes, repeats, seeds, simhash, vectors, whitening
from tidegauge.plans.views import table


def source_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("raw_text"), *columns)


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures; ``labels`` of the same number are the outcomes: accepted when of quality and not toxic."""
    outcomes = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("ok"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url").join(outcomes, "page_id", "left")
    captures = pages.select(F.col("page_id").alias("capture_id"), F.col("url").alias("source_url"), (F.col("ok") == 1).alias("accepted"))
    found = hosts.judge(captures, RULES)
    return found.select(
        F.col("capture_id").alias("page_id"), "host", "path", "rule", "verdict", F.round("refused_share", 6).alias("refused_share"),
        F.round("refused_bound", 6).alias("refused_bound"))


def hashed_apart(doc_id: Column, parts: int) -> Column:
    """True for the documents that are held out: remainder 1 of the id's checksum."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts == 1


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = source_events(spark, sf_dir)
    model = ngrams.fit(spark, events.where(~hashed_apart(F.col("event_id"), 5)), order=2)
    return ngrams.score(events, model).select(
        F.col("event_id").alias("doc_id"), hashed_apart(F.col("event_id"), 5).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def byte_vocabulary() -> dict[str, str]:
    """The byte-level vocabulary of the packed windows, where the tokenizer package is installed."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(source_events(spark, sf_dir), shingle=3, radius=3)
    return found.select(F.col("event_id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.sanitise(source_events(spark, sf_dir))

    def joined(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("event_id").alias("doc_id"), *map(number, disclosure.KINDS), F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "documents").where(~hashed_apart(F.col("doc_id"), 3)).select(
        F.col("doc_id").alias("event_id"), F.col("text").alias("raw_text"), F.col("lang").alias("language"))
    found = language.predict(source_events(spark, sf_dir), language.fit(labelled))
    doc_id = F.col("record.event_id")
    return found.select(
        doc_id.alias("doc_id"), hashed_apart(doc_id, 3).alias("held_out"),
        F.col("predicted_language").alias("lang_pred"), F.col("margin").alias("score"), "rejected")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(source_events(spark, sf_dir), **byte_vocabulary(), end_id=0, window=1024)
    return found.withColumnRenamed("event_id", "doc_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = source_events(spark, sf_dir)
    kept = lines.apply_bitmaps(events, lines.keep_bitmaps(events, min_chars=20, min_events=3))
    return kept.select(F.col("record.event_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector"))
    return vectors.groups(vecs, min_cosine=0.95).withColumnRenamed("vector_id", "vec_id")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below source, language and thousand; every tenth is a licence file of one of the three."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    folders = [F.col("source"), F.col("lang"), F.floor(i / 1000).cast("string")]
    depth = F.when(i % 10 != 0, 3).otherwise(F.floor(i / 10) % 3 + 1)
    name = F.concat(F.when(i % 10 == 0, "LICENSE-").otherwise("doc-"), i.cast("string"))
    path = F.concat_ws("/", F.slice(F.array(*folders), F.lit(1), depth.cast("int")), F.array(name))
    found = licences.scan(d.select(path.alias("artifact_path"), F.col("text").alias("raw_text")))
    number = F.regexp_extract("artifact_path", "-([0-9]+)$", 1).cast("long")
    return found.select(number.alias("doc_id"), "artifact_path", "licence", F.round("similarity", 6).alias("similarity"), "basis", "licence_path")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    holdout = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("holdout_id"), F.col("text").alias("raw_text"))
    found = seeds.overlaps(source_events(spark, sf_dir), holdout)
    return found.withColumnsRenamed({"event_id": "doc_id", "holdout_id": "item_id"})


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as routes, turns as attempts; each takes its first turns from the conversation of its hundred."""
    turns = table(spark, sf_dir, "conversations").where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = turns.select("conv_id", "role", "text", F.row_number().over(order).alias("place"))
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), borrowed.alias("h"))
    base = placed.where("place <= 5").withColumnRenamed("conv_id", "base")
    heads = ids.join(base, "base").where("place <= h").select("conv_id", "role", "text", "place")
    rebuilt = placed.where(F.col("place") > borrowed).unionByName(heads).select(
        F.col("conv_id").alias("route_id"), F.col("place").alias("event_seq"), F.col("role").alias("strategy_id"), F.col("text").alias("requested_url"))
    found = prefixes.trie(rebuilt, ids.select(F.col("conv_id").alias("route_id")))
    return found.select(
        F.col("route_id").alias("conv_id"), "depth", F.col("parent_route_id").alias("parent_conv_id"), F.col("n_routes").alias("n_convs"),
        "n_children", "n_leaves", F.col("saved_chars").alias("saved_tokens"), "ends_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as snapshots of factor values in 1024ths, moved by 100,000."""
    entries = F.col("embedding").cast("array<double>")
    scaled = F.transform(entries, lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.floor(c * 1024) + 100_000).cast("long"))
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("security_code"), scaled.alias("factor_values")), components=8)
    return found.withColumnRenamed("security_code", "vec_id").withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(source_events(spark, sf_dir), length=100)
    return found.select(F.col("event_id").alias("doc_id"), "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


QUERIES = {
    "op1_host_reputation": op1_host_reputation,
    "op2_lm_score": op2_lm_score,
    "op3_simhash": op3_simhash,
    "op4_personal_data": op4_personal_data,
    "op5_language": op5_language,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_embeddings": op8_embeddings,
    "op9_licences": op9_licences,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_repeats": op13_repeats,
}

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _level(name: str, groups: str, parent: str) -> str:
    """SQL of one level of host reputations: moments, the prior's weight, shrunk shares."""
    return f"""
        {name}_m AS (SELECT sum((k - n * prior) ** 2 - n * prior * (1 - prior)) AS excess, sum(n * (n - 1) * prior * (1 - prior)) AS scale
                     FROM {groups} JOIN {parent}),
        {name}_w AS (SELECT CASE WHEN scale = 0 OR scale IS NULL OR excess <= 0 THEN 1000.0
                                 ELSE least(1000.0, greatest(2.0, scale / excess - 1)) END AS w FROM {name}_m)"""


ORACLE = {
    "op1_host_reputation": rf"""
        WITH o AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS ok FROM labels GROUP BY doc_id),
        c AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {LETTERS}) AS host,
                     regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, ok FROM pages LEFT JOIN o USING (page_id)),
        h AS (SELECT host, count(ok) AS n, count(*) FILTER (WHERE ok = 0) AS k,
                     CASE WHEN host LIKE '%.%' THEN regexp_extract(host, '[^.]+\.[^.]+$') ELSE host END AS domain FROM c GROUP BY host),
        d0 AS (SELECT domain, CASE WHEN domain LIKE '%.%' THEN substr(domain, strpos(domain, '.') + 1) ELSE '' END AS suffix,
                      sum(n) AS n, sum(k) AS k FROM h GROUP BY domain),
        s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d0 GROUP BY suffix),
        t AS (SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 1) AS prior FROM s0),
        {_level("s", "s0", "t ON true")},
        s AS (SELECT suffix, (k + w * prior) / (n + w) AS prior FROM s0 JOIN t ON true JOIN s_w ON true),
        {_level("d", "d0", "s USING (suffix)")},
        d AS (SELECT domain, (k + w * prior) / (n + w) AS prior FROM d0 JOIN s USING (suffix) JOIN d_w ON true),
        {_level("h", "h", "d USING (domain)")},
        r AS (SELECT host, n + w AS size, (k + w * prior) / (n + w) AS share FROM h JOIN d USING (domain) JOIN h_w ON true),
        b AS (SELECT host, share, greatest(0.0, share - 1.645 * sqrt(share * (1 - share) / (size + 1))) AS bound FROM r),
        f AS (SELECT page_id, host, path, share, bound, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM c JOIN b USING (host))
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                    WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
               round(share, 6) AS refused_share, round(bound, 6) AS refused_bound FROM f""",
    "op7_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
        k AS (SELECT *, translate(trim(line, {BLANKS}), {LETTERS}) AS key FROM l),
        f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id <> top) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE top IS NULL OR doc_id = top), '')) AS kept_sha256
        FROM k LEFT JOIN f USING (key) GROUP BY doc_id""",
    # Every pair of equal tokens on a diagonal, not only those under a seed.
    "op10_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark),
        dw AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS word_at FROM d),
        bw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS own_at FROM b WHERE len(ws) >= 5),
        eq AS (SELECT doc_id, item_id, n, own_at, count(*) OVER (
                   PARTITION BY doc_id, item_id, word_at - own_at ORDER BY own_at RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS equal_tokens
               FROM dw JOIN bw USING (w))
        SELECT doc_id, item_id, CAST(least(12, n) AS INTEGER) AS window_tokens, max(equal_tokens) AS equal_tokens,
               max(equal_tokens) / least(12, n) AS similarity
        FROM eq WHERE equal_tokens >= CASE WHEN n < 12 THEN n ELSE 10 END GROUP BY doc_id, item_id, n
        UNION ALL SELECT doc_id, item_id, CAST(len(ws) AS INTEGER), len(ws), 1.0 FROM d JOIN b USING (ws) WHERE len(ws) BETWEEN 1 AND 4""",
}
