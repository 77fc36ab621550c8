"""Factor ledger: schedule, disclosures and prices case by case, and what of them is shuffled."""

from datetime import date
from decimal import Decimal

from test_observations import exchanged

from tidegauge.operators import corporate_actions as ca

DISCLOSURE = ("action_id string, action_type string, formula_mode string, fractional_entitlement_policy string, previous_close decimal(20,6), cash_per_share decimal(20,6), "
              "new_shares_per_old_share decimal(20,6), rights_new_shares_per_old_share decimal(20,6), subscription_price decimal(20,6), official_reference_price decimal(20,6), "
              "official_factor decimal(20,6), official_position_quantity_multiplier decimal(20,6), review_status string, evidence_text string, evidence_excerpt string")
DAY = date(2024, 3, 4)


def told(action_id, action="CASH_DIVIDEND_NORMAL", mode="REPRODUCIBLE_MECHANICAL", close=10, cash=1, status="ACCEPTED", excerpt="cash  of ONE"):
    terms = [None if v is None else Decimal(v) for v in (close, cash, None, None, None, None, None, None)]
    return (action_id, action, mode, "NOT_APPLICABLE", *terms, status, "Notice: Cash of one a share", excerpt)


def sides(spark):
    ids = ["good", "good", "none", "twice", "price", "late", "phrase", "dear", "odd", None]
    schedule = spark.createDataFrame([(i, 7, DAY) for i in ids], "action_id string, code long, ex_date date")
    disclosure = spark.createDataFrame(
        [told("good"), told("twice"), told("twice"), told("price", close=11, status="PENDING"), told("late"), told("phrase", excerpt="two"), told("dear", cash=20),
         told("odd", action="GIFT", mode="OFFICIAL_FACTOR"), told(None), told("unasked")], DISCLOSURE)
    prices = [("good", 1), ("good", 2), ("twice", 3), ("price", 3), ("late", 4), ("dear", 3), (None, 3)]
    reference = spark.createDataFrame([(i, date(2024, 3, d), Decimal(10)) for i, d in prices], "action_id string, reference_date date, reference_close decimal(20,6)")
    return schedule, disclosure, reference


def test_every_code(spark):
    schedule, disclosure, reference = sides(spark)
    ledger, queue = ca.build_factor_ledger(schedule, disclosure, reference)
    got = {}
    for r in ledger.collect():
        got.setdefault(r["action_id"], []).append((r["ledger_codes"], r["return_engine_ready"]))
    unknown = ["ACTION_TYPE_UNSUPPORTED", "FORMULA_MODE_UNSUPPORTED", "FRACTIONAL_POLICY_UNSUPPORTED"]
    assert got == {
        "good": [([], True)] * 4, "none": [(["DISCLOSURE_NOT_FOUND", *unknown], False)], "twice": [(["DISCLOSURE_AMBIGUOUS", *unknown], False)],
        "price": [(["DISCLOSURE_NOT_ACCEPTED", "PRICE_REFERENCE_DIFFERS"], True)], "late": [(["PRICE_REFERENCE_NOT_BEFORE_EX_DATE"], True)],
        "phrase": [(["PRICE_REFERENCE_MISSING", "EVIDENCE_PHRASE_ABSENT"], True)], "dear": [(["CASH_NOT_BELOW_CLOSE"], False)],
        "odd": [(["ACTION_TYPE_UNSUPPORTED", "OFFICIAL_FACTOR_MISSING"], False)], None: [(["DISCLOSURE_NOT_FOUND", *unknown], False)]}
    assert queue.count() == 8
    rows = {r["action_id"]: r for r in ledger.collect()}
    assert (rows["good"]["theoretical_ex_price"], rows["good"]["action_type"], rows["good"]["return_engine_treatment"]) == (9, "CASH_DIVIDEND_NORMAL", "RAW_PRICE_PLUS_CASH_COMPONENT")
    assert rows["twice"]["action_type"] is None and rows["twice"]["return_engine_treatment"] is None
    status = ca.ledger_status(ledger).first()
    assert (status["actions"], status["blocked"], status["ready"], status["status"]) == (12, 8, 4, "BLOCKED")


def test_terms_of_another_side(spark):
    """Terms that do not come with the disclosure are judged after the join."""
    schedule, disclosure, reference = sides(spark)
    moved = ["action_type", "formula_mode"]
    late, _ = ca.build_factor_ledger(schedule.join(disclosure.dropDuplicates(["action_id"]).select("action_id", *moved), "action_id", "left"), disclosure.drop(*moved), reference)
    assert {tuple(r["ledger_codes"]) for r in late.where("action_id IN ('good', 'price', 'dear')").collect()} == {
        (), ("DISCLOSURE_NOT_ACCEPTED", "PRICE_REFERENCE_DIFFERS"), ("CASH_NOT_BELOW_CLOSE",)}


def test_terms_are_not_shuffled(spark):
    """A disclosure goes through one shuffle, and of its terms only the close that is compared."""
    schedule, disclosure, reference = sides(spark)
    shuffled = exchanged(ca.build_factor_ledger(schedule, disclosure, reference)[0].select("ledger_codes", "return_engine_ready"))
    assert not any({"cash_per_share", "evidence_text", "evidence_excerpt", "review_status", "formula_mode", "action_type"} & set(names) for names in shuffled)
    assert len(shuffled) <= 3
