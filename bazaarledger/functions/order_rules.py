"""Rules on the order snapshot: state, payability, acceptance, integration flags.

All functions read order-snapshot column names. `logged` is the test "an auto-accept log event exists for the order".
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codes import (
    AUTO_ACCEPT_FLAG,
    COMPLETED_STATE,
    INTEGRATED_ORDER_TYPE,
    LOG_RETENTION_DAYS,
    OUT_OF_STOCK_MESSAGE,
    Codes,
)
from .dates import day_literal

c = F.col


def final_state() -> Column:
    """Completed code wins; a blank state falls back to expiry, cancellation, then the booking's state."""
    blank = c("final_state") == ""
    unbooked = blank & c("booking_state").isNull()
    return (
        F.when(c("order_state") == COMPLETED_STATE, "COMPLETED")
        .when(unbooked & c("pre_expired_time").isNotNull(), "MAX_IGNORE")
        .when(unbooked & c("pre_cancelled_time").isNotNull(), "PAX_REQUEST_CANCEL")
        .when(blank, c("booking_state"))
        .otherwise(c("final_state"))
    )


def accept_delay_seconds() -> Column:
    """Whole seconds from order to acceptance, for integrated orders only."""
    delay = F.timestamp_diff("SECOND", c("ord_new_time"), c("pre_accepted_time"))
    return F.when(c("order_type") == INTEGRATED_ORDER_TYPE, delay)


def auto_accepted(logged: Column, as_of: date | str, retention_days: int = LOG_RETENTION_DAYS) -> Column:
    """While logs are retained trust them; for older orders any non-zero acceptance delay counts."""
    age = F.datediff(day_literal(as_of), F.to_date("created_time"))
    return F.when(age <= retention_days, logged).otherwise(accept_delay_seconds() != 0)


def _pay_rules(auto: Column, extra_no_pay: Column | None) -> Column:
    accepted = c("pre_accepted_time").isNotNull()
    unallocated = (c("final_state") == "UNALLOCATED") | (
        (c("final_state") == "") & (c("booking_state") == "UNALLOCATED")
    )
    rule = F.when(c("ord_completed_time").isNotNull(), "pay").when(accepted & auto & unallocated, "no pay")
    if extra_no_pay is not None:
        rule = rule.when(accepted & extra_no_pay, "no pay")
    return rule.when(accepted, "pay").otherwise("no pay")


def pay_status(auto: Column) -> Column:
    """Pay when completed or accepted, except auto-accepted orders that never found a driver."""
    return _pay_rules(auto, None)


def pay_status_v1(logged: Column) -> Column:
    """Earlier rule: log events only, and operator cancellations for lack of stock are not paid.

    The stock rule never overrides an auto-accepted order whose reallocation failed, since the states are exclusive.
    """
    out_of_stock = (c("final_state") == "CANCELLED_OPERATOR") & (c("cancel_msg") == OUT_OF_STOCK_MESSAGE)
    return _pay_rules(logged, out_of_stock)


def _accepted() -> Column:
    return F.coalesce("pre_accepted_time", "ord_order_in_prepare_time").isNotNull()


def metadata_fields(meta: Column) -> dict[str, Column]:
    """The values of a parsed metadata document that the rules read, as flat columns."""
    return {
        "accepted_by": meta["FPTAcceptedBy"], "pos_code": meta["qsrCode"],
        "partner_submit_time": meta["partnerOrderSubmitTime"], "pay_merchant": meta["payMerchant"],
    }


def _flagged() -> Column:
    return F.coalesce(c("accepted_by") == AUTO_ACCEPT_FLAG, F.lit(False))


def accept_labels(auto: Column) -> dict[str, Column]:
    """Acceptance labels. Orders with metadata count as automatic only by flag or `auto`; without, accepted = manual."""
    documented = c("has_metadata")
    automatic = _flagged() | auto
    return {
        "merchant_accept": F.when(_accepted(), "mex_auto_accept"),
        "merchant_auto_accept": F.when(documented, F.when(automatic, "auto-accept")).when(_accepted(), "manual-accept"),
        "auto_accept_flag": F.when(documented, F.when(automatic, "mex_auto_accept")),
        "accept_flag": F.when(documented, F.when(automatic | _accepted(), "mex_accept")).when(_accepted(), "mex_accept"),
    }


def accept_labels_v1(logged: Column) -> dict[str, Column]:
    return {
        "merchant_auto_accept": F.when(_flagged() | logged, "auto-accept"),
        "merchant_auto_accept_status": F.when(logged, "mex_auto_accept"),
    }


def pos_flags(codes: Codes, with_payer: bool = True) -> dict[str, Column]:
    """Point-of-sale integration read from the metadata document."""
    flags = {
        "pos_flag": F.when(c("pos_code") == codes.pos_partner, "QSR POS Integrated"),
        "pos_integration_type": c("pos_code"),
        "pos_is_submitted": c("partner_submit_time").isNotNull().cast("int"),
    }
    if with_payer:
        flags["pos_pay_merchant"] = c("pay_merchant").isNotNull().cast("int")
    return flags


def kitchen_flags(merchant_type: Column, codes: Codes) -> dict[str, Column]:
    known = F.coalesce(merchant_type, F.lit(""))
    return {
        "is_kitchen": known.isin(codes.kitchen_mixed, codes.kitchen_single),
        "is_kitchen_mixed": known == codes.kitchen_mixed,
    }
