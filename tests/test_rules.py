"""Truth tables of the business rules: every branch once, and the NULL row."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bazaarledger.codes import Codes
from bazaarledger.functions import order_rules as rules
from bazaarledger.functions import payment_rules as money
from bazaarledger.functions import report_rules as rep

T0 = dt.datetime(2024, 1, 1, 10)
SCHEMA = (
    "order_type int, order_state int, booking_state string, final_state string, cancel_msg string, metadata string,"
    " created_time timestamp, ord_new_time timestamp, pre_accepted_time timestamp, pre_expired_time timestamp,"
    " pre_cancelled_time timestamp, ord_order_in_prepare_time timestamp, ord_completed_time timestamp, logged boolean"
)
BLANK = dict(order_type=1, order_state=5, booking_state=None, final_state="", cancel_msg=None, metadata=None, created_time=T0,
             ord_new_time=T0, pre_accepted_time=None, pre_expired_time=None, pre_cancelled_time=None,
             ord_order_in_prepare_time=None, ord_completed_time=None, logged=False)


def evaluate(spark, column, **order):
    row = {**BLANK, **order}
    df = spark.createDataFrame([tuple(row.values())], SCHEMA)
    df = df.withColumns({
        "has_metadata": F.col("metadata") != "", "accepted_by": F.from_json("metadata", "FPTAcceptedBy string")["FPTAcceptedBy"],
    })
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("order, expected", [
    (dict(order_state=11, final_state="CANCELLED"), "COMPLETED"),
    (dict(pre_expired_time=T0, pre_cancelled_time=T0), "MAX_IGNORE"),
    (dict(pre_cancelled_time=T0), "PAX_REQUEST_CANCEL"),
    (dict(booking_state="UNALLOCATED", pre_expired_time=T0), "UNALLOCATED"),
    (dict(final_state="CANCELLED_OPERATOR"), "CANCELLED_OPERATOR"),
    (dict(), None), (dict(final_state=None, order_state=None), None),
])
def test_final_state(spark, order, expected):
    assert evaluate(spark, rules.final_state(), **order) == expected


@pytest.mark.parametrize("order, expected", [
    (dict(ord_completed_time=T0), "pay"), (dict(pre_accepted_time=T0, ord_completed_time=T0), "pay"),
    (dict(pre_accepted_time=T0, final_state="UNALLOCATED", logged=True), "no pay"),
    (dict(pre_accepted_time=T0, final_state="UNALLOCATED", logged=False), "pay"),
    (dict(pre_accepted_time=T0, final_state="REALLOCATION_FAILED", logged=True), "pay"),
    (dict(pre_accepted_time=T0, booking_state="UNALLOCATED", logged=True), "no pay"),
    (dict(pre_accepted_time=T0), "pay"), (dict(), "no pay"),
])
def test_pay_status(spark, order, expected):
    assert evaluate(spark, rules.pay_status(F.col("logged")), **order) == expected
    assert evaluate(spark, rules.pay_status_v1(F.col("logged")), **order) == expected


def test_out_of_stock_is_unpaid_only_in_the_earlier_rule(spark):
    order = dict(pre_accepted_time=T0, final_state="CANCELLED_OPERATOR", cancel_msg="Food is out of stock")
    assert evaluate(spark, rules.pay_status_v1(F.col("logged")), **order) == "no pay"
    assert evaluate(spark, rules.pay_status(F.col("logged")), **order) == "pay"


@pytest.mark.parametrize("as_of, delay, logged, order_type, expected", [
    ("2024-03-26", 30, False, 1, False),  # 85 days: the log decides
    ("2024-03-26", 0, True, 1, True),
    ("2024-03-27", 30, False, 1, True),  # 86 days: any delay counts
    ("2024-03-27", 0, True, 1, False),
    ("2024-03-27", 30, True, 2, None),
])
def test_auto_accept_falls_back_after_log_retention(spark, as_of, delay, logged, order_type, expected):
    order = dict(pre_accepted_time=T0 + dt.timedelta(seconds=delay), logged=logged, order_type=order_type)
    assert evaluate(spark, rules.auto_accepted(F.col("logged"), as_of), **order) is expected


@pytest.mark.parametrize("order, auto, expected", [
    (dict(metadata='{"FPTAcceptedBy":"3"}'), False, (None, "auto-accept", "mex_auto_accept", "mex_accept")),
    (dict(metadata='{"FPTAcceptedBy":"1"}', pre_accepted_time=T0), False, ("mex_auto_accept", None, None, "mex_accept")),
    (dict(metadata="{}"), True, (None, "auto-accept", "mex_auto_accept", "mex_accept")),
    (dict(metadata="{}"), None, (None, None, None, None)),
    (dict(metadata="", ord_order_in_prepare_time=T0), True, ("mex_auto_accept", "manual-accept", None, "mex_accept")),
    (dict(metadata=None, pre_accepted_time=T0), False, ("mex_auto_accept", "manual-accept", None, "mex_accept")),
    (dict(metadata=None), True, (None, None, None, None)),
    (dict(metadata="broken", pre_accepted_time=T0), False, ("mex_auto_accept", None, None, "mex_accept")),
])
def test_accept_labels(spark, order, auto, expected):
    labels = rules.accept_labels(F.lit(auto).cast("boolean"))
    assert tuple(evaluate(spark, label, **order) for label in labels.values()) == expected


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(value, kind="double"):
    return F.lit(value).cast(kind)


def test_kitchen_flags(spark):
    codes = Codes()
    for kind, both in ((codes.kitchen_mixed, (True, True)), (codes.kitchen_single, (True, False)), (None, (False, False))):
        flags = rules.kitchen_flags(lit(kind, "string"), codes)
        assert (one(spark, flags["is_kitchen"]), one(spark, flags["is_kitchen_mixed"])) == both


def test_payout_filter(spark):
    cases = [("SGD", 60, True), ("SGD", 56, False), ("THB", 56, True), ("THB", 59, False), ("PHP", 60, False)]
    for currency, kind, expected in cases:
        assert one(spark, money.payout_filter(F.lit(currency), F.lit(kind))) is expected


def test_source_precedence_and_step_up(spark):
    assert one(spark, money.prefer(lit(None), lit(2.0), lit(3.0))) == 2.0
    assert one(spark, money.net_of_step_up([lit(None), lit(5.0)], [lit(1.0), lit(9.0)])) == 4.0
    assert one(spark, money.net_payable(lit(10.0), lit(1.0), lit(None), lit(2.0))) == 9.0


def test_refund_rules(spark):
    assert one(spark, rep.refund_status(lit(10.001), lit(10.0))) == "Full Refund"
    assert one(spark, rep.refund_status(lit(10.01), lit(10.0))) == "Partial Refund"
    assert one(spark, rep.refund_status(lit(None), lit(10.0))) == "Partial Refund"
    keys = [("Case", lit(None, "string")), ("Request", lit("r", "string"))]
    assert one(spark, rep.refund_source(keys)) == "Request"
    assert one(spark, rep.captured_amount([lit(None), lit(None)])) == 0.0


def test_settlement_rules(spark):
    assert [one(spark, rep.adjustment_route(lit(v))) for v in (0.0, 2.0, None)] == ["plain", "adjusted", None]
    assert one(spark, rep.adjustment_indicator(lit(0.0), F.lit("orders"), "ORDERS")) is None
    assert one(spark, rep.adjustment_indicator(lit(0.0), F.lit("other"), "ORDERS")) == "MPA Involved"
    assert one(spark, rep.cashout_status(lit(0.1 + 0.2), lit(0.3), F.lit("DONE"), "OK")) == "OK"
    assert one(spark, rep.cashout_status(lit(None), lit(0.3), F.lit("DONE"), "OK")) == "DONE"


@pytest.mark.parametrize("kind, expected", [(1, 5.0), (1000, 5.0), (1099, 5.0), (1100, 0.0), (2, 0.0)])
def test_promo_amount_by_type(spark, kind, expected):
    assert one(spark, rep.promo_amount(F.lit(kind), F.lit("500"))) == expected


def test_booking_type(spark):
    assert [one(spark, rep.booking_type(lit(m, "int"))) for m in (2, 3, None)] == ["Cash", "Cashless", "Cashless"]
