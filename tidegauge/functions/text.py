"""Text and identifier columns: claim tokens, URLs, registrable domains, ISIN."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
SENSITIVE_QUERY_KEYS = (
    "access_token", "api_key", "apikey", "auth", "authorization", "awsaccesskeyid", "bearer", "client_secret", "code", "cookie",
    "googleaccessid", "jwt", "oauth_token", "passwd", "password", "session", "sessionid", "sig", "signature", "token",
)
CAPTCHA_MARKERS = (
    'class="g-recaptcha"', "class='g-recaptcha'", "hcaptcha", "cf-chl-", "challenge-platform", "verify you are human", "/recaptcha/",
)
PAYWALL_MARKERS = (
    'id="paywall"', "id='paywall'", 'class="paywall"', "class='paywall'", "subscribe to continue", "subscription required",
    "purchase a subscription",
)
LOGIN_MARKERS = (
    'type="password"', "type='password'", "authentication required", "login required", "sign in required", "<title>sign in",
    "<title>login",
)
MULTI_LABEL_SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "com.ae", "com.au", "com.bh", "com.cn", "com.kw", "com.om", "com.qa", "com.sa", "com.tr",
    "edu.kw", "gov.kw", "net.kw", "org.kw", "org.uk",
)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no built-in for it."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def claim_tokens(text: Column) -> Column:
    """Sorted distinct tokens of three characters or more, Arabic forms folded, links removed."""
    t = F.lower(nfkc(text))
    t = F.regexp_replace(t, r"https?://\S+", " ")
    t = F.regexp_replace(t, "[ً-ٰٟـ]", "")
    t = F.translate(t, "أإآى", "اااي")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?U)([\w؀-ۿ]{3,})"), F.lit(1))))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def url_part(url: str | Column, part: str) -> Column:
    return F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit(part))


def sensitive_query(url: str) -> Column:
    """True when any query key could carry a credential or a signed-URL proof."""
    keys = F.transform(
        F.split(F.coalesce(url_part(url, "QUERY"), F.lit("")), "&"),
        lambda kv: F.regexp_replace(F.lower(F.trim(F.coalesce(F.try_url_decode(F.split(kv, "=")[0]), F.split(kv, "=")[0]))), "-", "_"),
    )
    flat = {k.replace("_", "") for k in SENSITIVE_QUERY_KEYS}
    return F.exists(
        keys,
        lambda k: k.isin(*SENSITIVE_QUERY_KEYS)
        | F.regexp_replace(k, "_", "").isin(*sorted(flat))
        | k.rlike(r"^(x_?amz|x_?goog)|(_token|_secret|_credential|_signature)$|access_token|client_secret"),
    )


def check_url(df: DataFrame, url: str = "url") -> DataFrame:
    """HTTPS URL contract."""
    from tidegauge.functions import rules as R

    port = F.regexp_extract(F.coalesce(url_part(url, "AUTHORITY"), F.lit("")), r":([0-9]+)$", 1)
    return R.check(
        df,
        R.must("URL_NOT_ABSOLUTE_HTTPS", (F.lower(url_part(url, "PROTOCOL")) == "https") & R.present(url_part(url, "HOST"))),
        R.never("URL_HAS_USERINFO", url_part(url, "USERINFO").isNotNull()),
        R.never("URL_HAS_FRAGMENT", url_part(url, "REF").isNotNull() & (url_part(url, "REF") != "")),
        R.never("URL_PORT_NOT_STANDARD", (port != "") & (port != "443")),
        R.never("URL_QUERY_SENSITIVE", sensitive_query(url)),
    )


@F.pandas_udf(StringType())
def idna_host(s: pd.Series) -> pd.Series:
    """ASCII form of international host names; NULL where there is none."""

    def ascii_form(host):
        try:
            return None if host is None else host.strip(".").encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return s.map(ascii_form)


def registrable_domain(host: Column) -> Column:
    """Last two labels, or three under a known multi-label suffix; an IP address is returned whole.

    Dots around the name are dropped. International names are compared as they
    are; :func:`idna_host` gives their ASCII form first.
    """
    name = F.trim(F.lower(host), F.lit("."))
    labels = F.split(name, r"\.")
    last_two = F.concat_ws(".", F.slice(labels, -2, 2))
    address = name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|:")
    return (
        F.when(host.isNull(), None)
        .when(address | (F.size(labels) < 2), name)
        .when((F.size(labels) >= 3) & last_two.isin(*MULTI_LABEL_SUFFIXES), F.concat_ws(".", F.slice(labels, -3, 3)))
        .otherwise(last_two)
    )


def check_host(df: DataFrame, host: str = "host") -> DataFrame:
    """A host that a domain can be counted for: present, qualified, no empty label."""
    from tidegauge.functions import rules as R

    name = F.trim(F.col(host), F.lit("."))
    return R.check(
        df,
        R.must("HOST_REQUIRED", R.present(host)),
        R.never("HOST_NOT_QUALIFIED", R.present(host) & ~F.contains(name, F.lit(".")) & ~F.contains(name, F.lit(":"))),
        R.never("HOST_LABEL_EMPTY", F.contains(name, F.lit(".."))),
    )


def access_blocker(html: Column) -> Column:
    """CAPTCHA, PAYWALL or LOGIN when the whole page carries such a marker, else NULL."""
    page = F.lower(html)

    def any_of(markers):
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.contains(page, F.lit(m))
        return hit

    return (
        F.when(any_of(CAPTCHA_MARKERS), "CAPTCHA").when(any_of(PAYWALL_MARKERS), "PAYWALL").when(any_of(LOGIN_MARKERS), "LOGIN")
    )


def isin_valid(isin: Column) -> Column:
    """Shape and Luhn check digit, letters expanded to two digits, no UDF."""
    shape = F.upper(isin).rlike(r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$")
    digits = F.flatten(
        F.transform(
            F.filter(F.split(F.upper(isin), ""), lambda c: c != ""),
            lambda c: F.filter(F.split((F.conv(c, 36, 10)), ""), lambda d: d != ""),
        )
    )
    ordered = F.transform(F.reverse(digits), lambda d, i: F.struct(d.try_cast("int").alias("d"), i.alias("i")))
    total = F.aggregate(
        ordered, F.lit(0),
        lambda acc, x: acc
        + F.when(x["i"] % 2 == 0, x["d"]).when(x["d"] * 2 > 9, x["d"] * 2 - 9).otherwise(x["d"] * 2),
    )
    return F.coalesce(shape & (total % 10 == 0), F.lit(False))
