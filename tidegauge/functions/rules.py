"""Row contracts: collect every violated rule of a row, drop nothing.

A rule is ``code -> predicate``. ``must`` fails when its predicate is false or
unknown, ``never`` fails only when its predicate is true. ``check`` adds one
``issue_codes`` array; ``clean`` and ``issues`` read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE_COLUMNS = ("operator", "row_key", "code", "severity")

# Fixed patterns.
SHA256_PATTERN = r"^[0-9a-f]{64}$"
PLACEHOLDER_PATTERN = r"\{\{|\$\{|<%"
OFFSET_PATTERN = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def must(code: str, predicate: Column) -> Column:
    return F.when(~F.coalesce(predicate, F.lit(False)), F.lit(code))


def never(code: str, predicate: Column) -> Column:
    return F.when(F.coalesce(predicate, F.lit(False)), F.lit(code))


_BETWEEN = "\u001f"  # in no code


def joined(*rules: Column) -> Column:
    """The codes of the violated rules in one text, itself a rule for ``code_array`` or ``check``."""
    return F.concat_ws(_BETWEEN, *rules)


def code_array(*rules: Column) -> Column:
    """The codes of the violated rules in their order.

    By text functions, which Spark compiles together with the rules; ``array_compact`` takes a lambda, and all that stands
    inside it is interpreted row by row.
    """
    return F.array_remove(F.split(joined(*rules), _BETWEEN), "")


def check(df: DataFrame, *rules: Column) -> DataFrame:
    """Add ``issue_codes``, evaluated once per row.

    The array is produced by a generator, because a later filter on a projected
    array would be pushed down and would evaluate every rule a second time.
    """
    return df.select("*", F.explode_outer(F.array(code_array(*rules))).alias("issue_codes"))


def clean(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("issue_codes") == 0).drop("issue_codes")


def issues(checked: DataFrame, operator: str, *key: str, severity: str = "ERROR") -> DataFrame:
    return checked.where(F.size("issue_codes") > 0).select(
        F.lit(operator).alias("operator"),
        F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).alias("row_key"),
        F.explode("issue_codes").alias("code"),
        F.lit(severity).alias("severity"),
    )


# --- single-column predicates -------------------------------------------------

def present(col: str | Column) -> Column:
    text = F.trim((F.col(col) if isinstance(col, str) else col).cast("string"))
    return F.coalesce(text != "", F.lit(False))


def in_set(col: str | Column, values) -> Column:
    return (F.col(col) if isinstance(col, str) else col).isin(*sorted(values))


def is_sha256(col: str | Column) -> Column:
    return F.lower(F.col(col) if isinstance(col, str) else col).rlike(SHA256_PATTERN)


def has_placeholder(*cols: str) -> Column:
    bad = F.lit(False)
    for col in cols:
        bad = bad | F.coalesce(F.col(col).cast("string").rlike(PLACEHOLDER_PATTERN), F.lit(False))
    return bad


def finite(col: str | Column, minimum: float | None = None, maximum: float | None = None) -> Column:
    """True for a real number inside the bounds; text is parsed, booleans and NaN are refused."""
    value = F.col(col) if isinstance(col, str) else col
    number = value.try_cast("double")
    good = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    if minimum is not None:
        good = good & (number >= minimum)
    if maximum is not None:
        good = good & (number <= maximum)
    return good


def aware_timestamp(text: str | Column) -> Column:
    """Parse ISO text to an instant; text without an offset becomes NULL, never session time."""
    value = F.col(text) if isinstance(text, str) else text
    return F.when(value.rlike(OFFSET_PATTERN), value.try_cast("timestamp"))


def strict_bool(text: str | Column) -> Column:
    value = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    return F.when(value == "true", True).when(value == "false", False)
