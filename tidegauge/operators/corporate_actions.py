"""Corporate-action terms to adjustment factors, as decimal column expressions.

Inputs are narrowed to DECIMAL(12,6) so that every quotient below keeps at least
twelve exact decimals; results are DECIMAL(38,12), rounded half up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rules as R

# Fixed values.
CASH = ("CASH_DIVIDEND_NORMAL", "CASH_DIVIDEND_SPECIAL")
SPLITS = ("STOCK_SPLIT", "REVERSE_SPLIT")
SHARES = ("BONUS_SHARES",) + SPLITS
ACTION_TYPES = CASH + SHARES + ("RIGHTS_ISSUE", "CAPITAL_REDUCTION", "MERGER", "PAR_VALUE_CHANGE", "OTHER")
FORMULA_MODES = ("OFFICIAL_FACTOR", "OFFICIAL_REFERENCE_PRICE", "REPRODUCIBLE_MECHANICAL", "NO_AUTOMATIC_FORMULA")
FRACTIONAL_POLICIES = ("NOT_APPLICABLE", "UNKNOWN", "ROUND_DOWN", "CASH_IN_LIEU", "EXACT_FRACTIONAL_ENTITLEMENT")
EXACT_POLICIES = ("NOT_APPLICABLE", "EXACT_FRACTIONAL_ENTITLEMENT")
NARROW, RESULT = "decimal(12,6)", "decimal(38,12)"
TERMS = ("action_type", "formula_mode", "fractional_entitlement_policy", "previous_close", "cash_per_share", "new_shares_per_old_share",
         "rights_new_shares_per_old_share", "subscription_price", "official_reference_price", "official_factor", "official_position_quantity_multiplier")


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def _result(value: Column) -> Column:
    return F.round(value, 12).cast(RESULT)


def calculate_adjustments(terms: DataFrame) -> DataFrame:
    """Theoretical ex-price, factors, multipliers, treatment and readiness per action row."""
    narrow = terms
    inputs = {
        "close": "previous_close", "cash": "cash_per_share", "fresh": "new_shares_per_old_share",
        "ratio": "rights_new_shares_per_old_share", "sub": "subscription_price",
        "ref": "official_reference_price", "fac": "official_factor", "mult": "official_position_quantity_multiplier",
    }
    for short, name in inputs.items():
        narrow = narrow.withColumn(f"_{short}", F.col(name).try_cast(NARROW))
    close, cash, fresh, ratio, sub, ref, fac, mult = [F.col(f"_{s}") for s in inputs]
    action, mode = F.col("action_type"), F.col("formula_mode")
    is_cash, is_share, is_split = action.isin(*CASH), action.isin(*SHARES), action.isin(*SPLITS)
    bonus, rights = action == "BONUS_SHARES", action == "RIGHTS_ISSUE"
    official, reference = mode == "OFFICIAL_FACTOR", mode == "OFFICIAL_REFERENCE_PRICE"
    mechanical, pending = mode == "REPRODUCIBLE_MECHANICAL", mode == "NO_AUTOMATIC_FORMULA"
    one = F.lit(1).cast(NARROW)
    grown = (one + fresh).cast(NARROW)
    righted = (one + ratio).cast(NARROW)
    raised = close + ratio * sub
    exact = F.col("fractional_entitlement_policy").isin(*EXACT_POLICIES)

    positive = {"previous_close": close, "new_shares_per_old_share": fresh, "rights_new_shares_per_old_share": ratio,
                "official_reference_price": ref, "official_factor": fac,
                "official_position_quantity_multiplier": mult}
    bad_sign = F.lit(False)
    for value in positive.values():
        bad_sign = bad_sign | F.coalesce(value <= 0, F.lit(False))
    bad_sign = bad_sign | F.coalesce(cash < 0, F.lit(False)) | F.coalesce(sub < 0, F.lit(False))
    too_wide = F.lit(False)
    for short, name in inputs.items():
        too_wide = too_wide | (F.col(name).isNotNull() & F.col(f"_{short}").isNull())

    checked = R.check(
        narrow,
        R.must("ACTION_TYPE_UNSUPPORTED", R.in_set("action_type", ACTION_TYPES)),
        R.must("FORMULA_MODE_UNSUPPORTED", R.in_set("formula_mode", FORMULA_MODES)),
        R.must("FRACTIONAL_POLICY_UNSUPPORTED", R.in_set("fractional_entitlement_policy", FRACTIONAL_POLICIES)),
        R.never("TERM_NOT_A_SMALL_DECIMAL", too_wide),
        R.never("TERM_SIGN_INVALID", bad_sign),
        R.never("PENDING_CARRIES_OFFICIAL_VALUES", pending & (ref.isNotNull() | fac.isNotNull() | mult.isNotNull())),
        R.never("OFFICIAL_FACTOR_MISSING", official & fac.isNull()),
        R.never("OFFICIAL_REFERENCE_MISSING", reference & (close.isNull() | ref.isNull())),
        R.never("PREVIOUS_CLOSE_MISSING", mechanical & close.isNull()),
        R.never("CASH_NOT_BELOW_CLOSE",
                mechanical & is_cash & ~F.coalesce((cash > 0) & (cash < close), F.lit(False))),
        R.never("NEW_SHARES_MISSING", mechanical & is_share & fresh.isNull()),
        R.never("STOCK_SPLIT_NOT_ABOVE_ONE", mechanical & (action == "STOCK_SPLIT") & (fresh <= 1)),
        R.never("REVERSE_SPLIT_NOT_BELOW_ONE", mechanical & (action == "REVERSE_SPLIT") & (fresh >= 1)),
        R.never("RIGHTS_TERMS_MISSING", mechanical & rights & (ratio.isNull() | sub.isNull())),
        R.never("MECHANICAL_NOT_PERMITTED", mechanical & ~(is_cash | is_share | rights)),
    )
    ok = F.size("issue_codes") == 0

    theoretical = (
        F.when(official, _result(close * fac))
        .when(reference, _result(ref))
        .when(mechanical & is_cash, _result(close - cash))
        .when(mechanical & bonus, _result(_ratio(close, grown)))
        .when(mechanical & is_split, _result(_ratio(close, fresh)))
        .when(mechanical & rights, _result(_ratio(raised, righted)))
    )
    factor = (
        F.when(official, _result(fac))
        .when(reference, _result(_ratio(ref, close)))
        .when(mechanical & is_cash, _result(_ratio((close - cash).cast(NARROW), close)))
        .when(mechanical & bonus, _result(_ratio(one, grown)))
        .when(mechanical & is_split, _result(_ratio(one, fresh)))
        .when(mechanical & rights, _result(_ratio(raised, righted * close)))
    )
    quantity = (
        F.when(official | reference, _result(mult))
        .when(mechanical & is_cash, _result(one))
        .when(mechanical & bonus, _result(grown))
        .when(mechanical & is_split, _result(fresh))
        .when(mechanical & rights, _result(righted))
    )
    ready = (
        F.when((official | reference) & is_cash, cash.isNotNull())
        .when((official | reference) & is_share, mult.isNotNull())
        .when(mechanical & is_cash, F.lit(True))
        .when(mechanical & is_share, exact)
        .otherwise(False)
    )
    treatment = (
        F.when(pending, "BLOCKED_PENDING_OFFICIAL_TERMS")
        .when(is_cash & (official | ready), "RAW_PRICE_PLUS_CASH_COMPONENT")
        .when(reference & is_cash, "BLOCKED_MISSING_CASH_COMPONENT")
        .when(is_share & ready, "RAW_PRICE_TIMES_QUANTITY_MULTIPLIER")
        .when(reference & is_share, "BLOCKED_MISSING_QUANTITY_MULTIPLIER")
        .when(mechanical & is_share, "BLOCKED_FRACTIONAL_ENTITLEMENT_POLICY")
        .when(mechanical & rights, "BLOCKED_RIGHTS_EXERCISE_OR_SALE_POLICY")
        .otherwise("BLOCKED_ACTION_SPECIFIC_RETURN_POLICY")
    )
    multiplier = (
        F.when(is_cash & (official | mechanical | (reference & ready)), _result(one))
        .when(is_share & ready, quantity)
    )
    use = (
        F.when(pending, "UNRESOLVED")
        .when(action == "CASH_DIVIDEND_NORMAL", "DISPLAY_AND_TOTAL_RETURN_INDEX_ONLY")
        .when(action == "CASH_DIVIDEND_SPECIAL", "TRADING_REFERENCE_AND_INDEX")
        .otherwise("CORPORATE_ACTION_REFERENCE")
    )
    return checked.select(
        *[F.col(c) for c in terms.columns], "issue_codes",
        F.when(ok, F.when(pending, "pending").when(mechanical, "reproducible").otherwise("official")).alias("factor_status"),
        F.when(ok, theoretical).alias("theoretical_ex_price"),
        F.when(ok, factor).alias("reference_price_factor"),
        F.when(ok, quantity).alias("position_quantity_multiplier"),
        F.when(ok, multiplier).alias("return_price_multiplier"),
        F.when(ok & (pending | official | reference | is_cash), _result(cash)).alias("cash_distribution"),
        F.when(ok & mechanical & rights, _result(ratio * sub)).alias("rights_cash_contribution"),
        F.when(ok, treatment).alias("return_engine_treatment"),
        F.when(ok, ready).otherwise(False).alias("return_engine_ready"),
        F.when(ok, use).alias("reference_price_use"),
    )


def build_factor_ledger(schedule: DataFrame, disclosure: DataFrame, price_reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schedule joined to reviewed disclosure and price reference, with factors.

    Returns the ledger rows and the policy queue of rows that a return engine
    may not use yet. ``disclosure`` and ``price_reference`` hold at most one row
    per action; repeats surface as DISCLOSURE_AMBIGUOUS.
    """
    spark = disclosure.sparkSession
    # Terms are judged where they are read, so of a disclosure only what is asked for is shuffled, once, by its action.
    told = set(TERMS) <= set(disclosure.columns)
    needs_price = F.col("formula_mode").isin("OFFICIAL_REFERENCE_PRICE", "REPRODUCIBLE_MECHANICAL")
    terms = disclosure.where("action_id IS NOT NULL").withColumns({
        "_unaccepted": F.col("review_status") != "ACCEPTED",
        "_absent": ~phrase_present(F.col("evidence_text"), F.col("evidence_excerpt"))})
    if told:
        terms = calculate_adjustments(terms.withColumns({"_priced": needs_price, "_close": F.when(needs_price, F.col("previous_close"))}))
    held = [c for c in terms.columns if c != "action_id"]
    # No row is combined before the shuffle: nearly all actions have one disclosure.
    single = terms.repartition("action_id").groupBy("action_id").agg(F.count("*").alias("_disclosures"), *[F.first(c).alias(c) for c in held])
    only = F.coalesce(F.col("_disclosures") == 1, F.lit(False))
    joined = schedule.join(single, "action_id", "left").withColumns({c: F.when(only, F.col(c)) for c in held})
    joined = joined.join(price_reference, "action_id", "left")
    if told:
        blank = spark.range(1).select(*[F.lit(None).cast(disclosure.schema[c].dataType).alias(c) for c in TERMS])
        none = F.lit(calculate_adjustments(blank).first()["issue_codes"])
        joined = joined.withColumns({"issue_codes": F.coalesce("issue_codes", none), "return_engine_ready": F.coalesce("return_engine_ready", F.lit(False))})
    else:
        joined = joined.withColumns({"_priced": needs_price, "_close": F.col("previous_close")})
    codes = R.code_array(
        R.must("DISCLOSURE_NOT_FOUND", F.col("_disclosures").isNotNull()),
        R.never("DISCLOSURE_AMBIGUOUS", F.col("_disclosures") > 1),
        R.never("DISCLOSURE_NOT_ACCEPTED", F.col("_unaccepted")),
        R.never("PRICE_REFERENCE_MISSING", F.col("_priced") & F.col("reference_date").isNull()),
        R.never("PRICE_REFERENCE_NOT_BEFORE_EX_DATE", F.col("reference_date") >= F.col("ex_date")),
        R.never("PRICE_REFERENCE_DIFFERS", F.col("_priced") & (F.col("reference_close") != F.col("_close"))),
        R.never("EVIDENCE_PHRASE_ABSENT", F.col("_absent")),
    )
    judged = joined.withColumn("ledger_codes", codes).drop("_disclosures", "_unaccepted", "_absent", "_priced", "_close")
    if not told:
        judged = calculate_adjustments(judged)
    judged = judged.withColumn("ledger_codes", F.concat("ledger_codes", F.col("issue_codes")))
    given = [c for side in (schedule, disclosure, price_reference) for c in side.columns if c != "action_id"]
    judged = judged.select("action_id", *given, "ledger_codes", *[c for c in judged.columns if c not in ("action_id", "ledger_codes", "issue_codes", *given)])
    usable = (F.size("ledger_codes") == 0) & F.col("return_engine_ready")
    return judged, judged.where(~usable)


def ledger_status(ledger: DataFrame) -> DataFrame:
    """Run status and counts of a factor ledger."""
    return ledger.agg(
        F.count("*").alias("actions"),
        F.count_if(F.size("ledger_codes") > 0).alias("blocked"),
        F.count_if((F.size("ledger_codes") == 0) & F.col("return_engine_ready")).alias("ready"),
    ).withColumn(
        "status",
        F.when(F.col("blocked") > 0, "BLOCKED").when(F.col("ready") < F.col("actions"), "PARTIAL").otherwise("PASS"),
    )


def phrase_present(text: Column, phrase: Column) -> Column:
    """Case-insensitive containment with runs of space collapsed, over the whole text."""
    def norm(c):
        return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))

    return F.contains(norm(text), norm(phrase))
