"""Source URLs filtered by rules and by the reputation of their hosts, learned from labelled captures.

Empirical Bayes over three levels. The share of refused captures of a suffix is shrunk to the share over all, that of a
registered domain to its suffix, that of a host to its domain; each level is beta-binomial, and how strongly it shrinks
(the prior's weight in captures) is estimated from how much its groups differ beyond chance. A host is blocked when even
the lower bound of its posterior share of refused captures exceeds the tolerated share, so that a host with few or no
labelled captures is blocked only if its relatives leave little doubt.

DataFrame functions only; the driver sees four sums per level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.text import registrable_domain
from tidegauge.session import materialise

Z = 1.645  # one-sided 95 %
MAX_REFUSED = 0.5
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0


def url_host(source_url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(source_url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(source_url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(source_url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null where none does.

    A rule is ``(action, host/path)``; it fits its host and all subdomains when the path starts with the rule's.
    """
    which, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tried first
        at = text.index("/")
        fits = ((host == text[:at]) | F.endswith(host, F.lit("." + text[:at]))) & F.startswith(path, F.lit(text[at:]))
        which, action = F.when(fits, text).otherwise(which), F.when(fits, verdict).otherwise(action)
    return which, action


def _weight(groups: DataFrame) -> float:
    """The prior's weight at one level, by moments, from ``groups(n, k, prior)``."""
    p = F.col("prior")
    row = groups.agg(
        F.sum((F.col("k") - F.col("n") * p) ** 2 - F.col("n") * p * (1 - p)).alias("excess"),
        F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p)).alias("scale")).first()
    if not row.scale:
        return MOST_WEIGHT
    alike = row.excess / row.scale  # correlation of two captures of one group
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / alike - 1)) if alike > 0 else MOST_WEIGHT


def _shrunk(groups: DataFrame, weight: float) -> Column:
    return (F.col("k") + weight * F.col("prior")) / (F.col("n") + weight)


def reputations(captures: DataFrame) -> DataFrame:
    """A row per host of ``captures(host, accepted)``: ``host, n_labelled, n_refused, refused_share, refused_bound``.

    ``accepted`` is true, false or null (not labelled). Without any label every host has the same share, one half.
    """
    hosts = materialise(
        captures.groupBy("host").agg(F.count("accepted").alias("n"), F.count_if(~F.col("accepted")).alias("k"))
        .withColumn("domain", F.coalesce(registrable_domain(F.col("host")), F.lit("")))
        .withColumn("suffix", F.when(F.instr("domain", ".") > 0, F.expr("substr(domain, instr(domain, '.') + 1)")).otherwise("")))
    domains = materialise(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    total = domains.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    overall = (total.k + 0.5) / (total.n + 1)

    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("prior", F.lit(overall))
    suffixes = suffixes.select("suffix", _shrunk(suffixes, _weight(suffixes)).alias("prior"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.select("domain", _shrunk(domains, _weight(domains)).alias("prior"))
    hosts = hosts.join(domains, "domain")
    weight = _weight(hosts)
    share, size = _shrunk(hosts, weight), F.col("n") + weight
    bound = F.greatest(F.lit(0.0), share - Z * F.sqrt(share * (1 - share) / (size + 1)))
    return hosts.select(
        "host", F.col("n").alias("n_labelled"), F.col("k").alias("n_refused"), share.alias("refused_share"), bound.alias("refused_bound"))


def judge(captures: DataFrame, rules: Sequence[tuple[str, str]], max_refused: float = MAX_REFUSED) -> DataFrame:
    """Verdict on every row of ``captures(capture_id, source_url, accepted, ...)``.

    Returns one row per input row: ``capture_id, host, path, rule`` (null where none fits), ``verdict`` (``allow`` or
    ``block``: the rule's, else block when the host's ``refused_bound`` exceeds ``max_refused``), ``refused_share`` and
    ``refused_bound``. A null URL or one without ``://`` has an empty host and path; all of these are one host.
    Repeated rows are judged, and count as outcomes, as often as they occur; other columns are ignored; an empty table
    gives an empty result.
    """
    parts = captures.select("capture_id", url_host(F.col("source_url")).alias("host"), url_path(F.col("source_url")).alias("path"), "accepted")
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    known = reputations(parts.select("host", "accepted")).select("host", "refused_share", "refused_bound")
    learned = F.when(F.col("refused_bound") > max_refused, "block").otherwise("allow")
    return parts.join(known, "host").select(
        "capture_id", "host", "path", rule.alias("rule"), F.coalesce(action, learned).alias("verdict"), "refused_share", "refused_bound")
