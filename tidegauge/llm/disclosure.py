"""Sanitised captures: personal data, and the words that would give it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Removing them is not enough when the words around
one occur hardly anywhere else: who knows the word knows the number. So the corpus tells how strongly a term reveals a
protected value, by pointwise mutual information: with ``n`` texts in all, ``f`` of them holding the value, ``g`` the term and
``h`` both, the term discloses the share ``log(h n / (f g)) / log(n / f)`` of what the value is worth knowing; 1 means
that the term is never met without it. Terms at or above the threshold are sanitised in the texts that hold the value,
wherever they stand: numbers and capitalised words are generalised to their class, others removed.

DataFrame functions only. Positions are code points and come from the lengths of the pieces that a pattern cuts a text
into, one row per match. Since ``h`` is at most ``f``, a share of ``t`` needs ``g <= f ** t * n ** (1 - t)``: a term that is
met more often than that for all values of a text is left out before it meets them, so what is paired are rare terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.lines import body_of
from tidegauge.session import broadcast_if_small, materialise

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 2
THRESHOLD = 0.9

# Possessive runs: the same matches as the plain patterns, without deep recursion or a second look at a run that failed
# once. ``\G`` lets a match start where the last one ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9\x20-](?<![\x20-][\x20-]))+(?<=[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"[\p{L}\p{N}]+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    ordered = F.transform(F.split(F.reverse(_digits(value)), "(?!$)"), lambda d, i: F.struct(d.try_cast("int").alias("d"), i.alias("i")))
    doubled = F.transform(ordered, lambda x: F.when(x["i"] % 2 == 0, x["d"]).when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    small = F.forall(
        F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "")),
        lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == "email", True).when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(13, 19), _luhn(value)).otherwise(False)).otherwise(n.between(9, 15)))


def _cut(kind: Column | str, text: Column, pattern: Column) -> Column:
    """Matches of a pattern in order, each with the length of the piece before it."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.when(F.size(found) > 0, F.split(text, pattern, -1))
    # Bound to variables, so that a text is cut once.
    both = F.array(F.struct(found.alias("found"), pieces.alias("pieces")))
    return F.flatten(F.transform(both, lambda x: F.transform(x["found"], lambda value, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("number"), value.alias("value"), F.length(F.get(x["pieces"], i)).alias("before")))))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))


def _placed(matches: DataFrame, *keys: str) -> DataFrame:
    """Adds ``start`` and ``stop`` to rows of one pattern per key."""
    order = Window.partitionBy(*keys).orderBy("number")
    gone = F.sum(F.col("before") + F.length("value")).over(order)
    return matches.withColumn("stop", gone.cast("long")).withColumn("start", F.col("stop") - F.length("value"))


def _cut_texts(events: DataFrame) -> DataFrame:
    """``(event_id, body, raw_text, matches, words)`` of the texts in which some pattern matches, each text once."""
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    matches = F.concat(*(_cut(kind, text, F.lit(pattern)) for kind, pattern in PATTERNS.items()))
    # Matches are bound to a variable and come out of a generator: made once, and words only where something matches.
    both = F.explode(F.transform(F.array(matches), lambda m: F.struct(m.alias("matches"), F.when(F.size(m) > 0, _words(text)).alias("words"))))
    cut = events.select("event_id", body_of(F.col("raw_text")).alias("body"), "raw_text", both.alias("c")).where(F.size("c.matches") > 0)
    return cut.select("event_id", "body", "raw_text", "c.*").dropDuplicates(["event_id", "body"])


def protected_spans(cut: DataFrame) -> DataFrame:
    """Base spans ``(event_id, body, kind, start, stop, value)`` of cut texts.

    Per kind the leftmost matches that do not overlap; a match that fails its kind's test (parts up to 255, Luhn over 13
    to 19 digits, 9 to 15 digits) is dropped and what it covered not searched again.
    """
    matches = cut.select("event_id", "body", F.explode("matches").alias("match")).select("event_id", "body", "match.*")
    return _placed(matches, "event_id", "body", "kind").where(_valid(F.col("kind"), F.col("value"))).drop("number", "before")


def _entity(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def disclosing_terms(events: DataFrame, cut: DataFrame, spans: DataFrame, threshold: float = THRESHOLD, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Terms to sanitise, ``(event_id, body, term)``: those of a text that reveal a protected value in it.

    ``min_support`` texts must hold the pair. In a text alone with its value each word that is met nowhere else has the
    share 1, whatever it means; only meeting again is evidence of a tie. A value that every text holds reveals nothing
    and is not protected against other terms. Rows that repeat an event id and its text count once everywhere.
    """
    entities = materialise(spans.select("event_id", "body", _entity(F.col("kind"), F.col("value")).alias("entity")).distinct())
    held = materialise(entities.groupBy("entity").agg(F.count("*").alias("f")))
    texts = events.select("event_id", body_of(F.col("raw_text")).alias("body"), "raw_text")
    copies = materialise(texts.groupBy("event_id", "body").agg(F.count("*").alias("copies")))
    n = copies.count()
    # Few rows repeat an id and text, as a rule: their keys go to the texts, which then need no shuffle.
    repeated = broadcast_if_small(copies.where("copies > 1"))
    most = held.agg(F.max("f")).first()[0]
    if not most or most < min_support:
        return cut.select("event_id", "body", F.lit("").alias("term")).limit(0)

    def bound(f: Column) -> Column:
        return F.pow(f, threshold) * float(n) ** (1 - threshold) * (1 + 1e-9)

    hashes = F.transform(_words(F.coalesce("raw_text", F.lit(""))), lambda w: F.xxhash64(w)).alias("hashes")
    rows = texts.alias("t").join(
        repeated.alias("r"), F.col("t.event_id").eqNullSafe(F.col("r.event_id")) & (F.col("t.body") == F.col("r.body")), "left")
    met = rows.select((1 / F.coalesce("copies", F.lit(1))).alias("part"), F.explode(hashes).alias("hashed"))
    rare = met.groupBy("hashed").agg(F.round(F.sum("part")).cast("bigint").alias("g")).where(
        (F.col("g") >= min_support) & (F.col("g") <= bound(F.lit(float(most)))))

    of_text = lambda l, r: F.col(f"{l}.event_id").eqNullSafe(F.col(f"{r}.event_id")) & (F.col(f"{l}.body") == F.col(f"{r}.body"))
    known = materialise(entities.join(held.where(F.col("f") >= min_support), "entity").where(F.col("f") < n))
    bounds = known.groupBy("event_id", "body").agg(F.max("f").alias("most"))
    terms = cut.alias("c").join(bounds.alias("b"), of_text("c", "b")).select("c.event_id", "c.body", "most", F.explode("words").alias("term"))
    candidates = materialise(terms.withColumn("hashed", F.xxhash64("term")).join(rare, "hashed").where(
        F.col("g") <= bound(F.col("most"))).select("event_id", "body", "term", "g"))
    pairs = candidates.alias("c").join(known.alias("k"), of_text("c", "k")).where(F.col("g") <= bound(F.col("f"))).select(
        "c.event_id", "c.body", "entity", "term", "f", "g")
    share = F.log2(F.col("h") * F.lit(float(n)) / (F.col("f") * F.col("g"))) / F.log2(F.lit(float(max(n, 1))) / F.col("f"))
    telling = pairs.groupBy("entity", "term").agg(F.count("*").alias("h"), F.first("f").alias("f"), F.first("g").alias("g")).where(
        (F.col("h") >= min_support) & (share >= threshold - 1e-12)).select("entity", "term")
    return pairs.select("event_id", "body", "entity", "term").join(telling, ["entity", "term"]).select("event_id", "body", "term").distinct()


def _term_spans(cut: DataFrame, terms: DataFrame) -> DataFrame:
    """Whole-word occurrences of each event's terms anywhere in its text; only cut texts have terms."""
    listed = terms.groupBy("event_id", "body").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    met = cut.alias("t").join(
        listed.alias("l"), F.col("t.event_id").eqNullSafe(F.col("l.event_id")) & (F.col("t.body") == F.col("l.body"))
    ).select("t.event_id", "t.body", "raw_text", F.concat(
        F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])")).alias("pattern"))
    found = met.select("event_id", "body", F.explode(_cut("term", F.col("raw_text"), F.col("pattern"))).alias("match")).select(
        "event_id", "body", "match.*")
    return _placed(found, "event_id", "body").select("event_id", "body", "kind", "start", "stop", "value")


def _replacement(kind: Column, value: Column) -> Column:
    return (
        F.when(kind != "term", F.concat(F.lit("["), F.upper(kind), F.lit("]")))
        .when(value.rlike(r"^\p{N}+$"), "[NUMBER]").when(value.rlike(r"^\p{Lu}"), "[NAME]").otherwise(""))


def _sanitised(text: Column, spans: Column) -> Column:
    start = F.struct(F.lit(1).cast("long").alias("at"), F.expr("CAST(array() AS array<string>)").alias("parts"))
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["stop"], s["kind"], s["value"])))

    def step(done: Column, s: Column) -> Column:
        fresh = s["stop"] >= done["at"]
        kept = F.substr(text, done["at"].cast("int"), F.greatest(s["start"] + 1 - done["at"], F.lit(0)).cast("int"))
        hidden = F.when(s["start"] + 1 >= done["at"], _replacement(s["kind"], s["value"])).otherwise("")
        return F.struct(
            F.greatest(done["at"], s["stop"] + 1).alias("at"),
            F.when(fresh, F.concat(done["parts"], F.array(kept, hidden))).otherwise(done["parts"]).alias("parts"))

    # Pieces are joined once, so the work does not grow with the square of the text.
    return F.aggregate(by_place, start, step, lambda done: F.concat(F.array_join(done["parts"], ""), F.substr(text, done["at"].cast("int"))))


def sanitise(events: DataFrame, threshold: float = THRESHOLD, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Spans to hide and the sanitised text of every row of ``events(event_id, raw_text, ...)``.

    Returns ``event_id, spans, sanitised_text``. ``spans`` is an array of ``(kind, start, stop, value)``, code points,
    end exclusive, base kinds in the order of ``KINDS``, then ``term``, each by start; a term span never overlaps a base
    span. In the text base spans become ``[KIND]``; where base spans of two kinds overlap, what they cover together is
    hidden under the first. Terms become ``[NUMBER]``, ``[NAME]`` or nothing. A null or empty text has no spans and an
    empty sanitised text. Rows that repeat an id and text share their spans, and count once where pairs are counted.
    Null ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    cut = materialise(_cut_texts(events))
    base = materialise(protected_spans(cut))
    terms = _term_spans(cut, disclosing_terms(events, cut, base, threshold, min_support))
    every = base.select("event_id", "body", "kind", "start", "stop", "value").unionByName(terms)
    rank = F.array_position(F.array(*(F.lit(k) for k in (*KINDS, "term"))), F.col("kind"))
    gathered = every.groupBy("event_id", "body").agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "stop", "kind", "value"))).alias("every"))
    is_base = lambda s: s["kind"] != "term"
    kept = gathered.withColumn("base", F.filter("every", is_base)).select("event_id", "body", F.transform(
        F.filter("every", lambda s: is_base(s) | ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"))).alias("spans"))
    wide = events.select("event_id", body_of(F.col("raw_text")).alias("body"), F.coalesce("raw_text", F.lit("")).alias("raw_text"))
    joined = wide.alias("e").join(
        kept.alias("k"), F.col("e.event_id").eqNullSafe(F.col("k.event_id")) & (F.col("e.body") == F.col("k.body")), "left")
    none = F.expr("CAST(array() AS array<struct<kind: string, start: bigint, stop: bigint, value: string>>)")
    spans = F.coalesce("spans", none)
    return joined.select("e.event_id", spans.alias("spans"), _sanitised(F.col("raw_text"), spans).alias("sanitised_text"))
