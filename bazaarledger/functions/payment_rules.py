"""Money rules of the merchant payment reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codes import PAYOUT_TYPES_BY_CURRENCY
from .predicates import contains_ci
from .scalars import minor_to_major, number, number_or_zero


def order_values(document: Column) -> dict[str, Column]:
    """Price split on the tax flow: a tax-inclusive price has tax taken out, otherwise it is added."""
    quote = document["cartWithQuote"]["foodQuoteInMin"]
    price = number(quote["priceInMinorUnit"])
    tax = number_or_zero(quote["inclTaxInMin"])
    inclusive = document["newTaxFlow"] == "true"
    return {
        "order_value_pre_tax": F.when(inclusive, price - tax).otherwise(price) / F.lit(100.0),
        "order_value_with_tax": F.when(inclusive, price).otherwise(price + tax) / F.lit(100.0),
        "tax_value": tax / F.lit(100.0),
    }


def quoted_pre_tax(quote: Column) -> Column:
    """Pre-tax value as the quote itself states it."""
    return minor_to_major(quote["priceExcludeTaxInMinorUnit"])


def commissions(quote: Column, info: Column, rate_default: float | None = None) -> dict[str, Column]:
    """Base and kitchen commission with their step-up parts, as amounts and as rates.

    Amounts and total rates treat a missing part as zero; single rates stay NULL unless `rate_default` says otherwise.
    """
    base, kitchen = number_or_zero(quote["mexCommission"]), number_or_zero(quote["gkCommission"])
    extra = quote["additionalCommissions"]
    base_up, kitchen_up = number_or_zero(extra["stepUpCommission"]), number_or_zero(extra["stepUpGKCommission"])
    rates = info["additionalCommissionRates"]
    parts = {
        "commission_rate_base": info["commission"],
        "commission_rate_kitchen": info["gkCommissionRate"],
        "commission_rate_base_step_up": rates["stepUpCommissionRate"],
        "commission_rate_kitchen_step_up": rates["stepUpGKCommissionRate"],
    }
    single = {
        name: number(rate) if rate_default is None else F.coalesce(number(rate), F.lit(rate_default))
        for name, rate in parts.items()
    }
    return {
        "commission_value": (base + kitchen) / F.lit(100.0),
        "commission_value_base": base / F.lit(100.0),
        "commission_value_kitchen": kitchen / F.lit(100.0),
        "commission_value_step_up": (base_up + kitchen_up) / F.lit(100.0),
        "commission_value_base_step_up": base_up / F.lit(100.0),
        "commission_value_kitchen_step_up": kitchen_up / F.lit(100.0),
        "commission_rate": number_or_zero(info["commission"]) + number_or_zero(info["gkCommissionRate"]),
        "commission_rate_step_up": number_or_zero(rates["stepUpCommissionRate"])
        + number_or_zero(rates["stepUpGKCommissionRate"]),
        **single,
    }


def net_payable(pre_tax: Column, tax: Column, funded_discount: Column, commission: Column) -> Column:
    return F.round(pre_tax + tax - F.coalesce(funded_discount, F.lit(0.0)) - commission, 2)


def net_payable_v1(pre_tax: Column, tax: Column, commission: Column) -> Column:
    return F.round(pre_tax - commission + tax, 2)


def net_payable_sub_merchant(pre_tax: Column, commission: Column) -> Column:
    """Sub-merchants carry no tax or discount term."""
    return pre_tax - commission


def prefer(*sources: Column) -> Column:
    """First source that has a value: ledger, then sub-merchant breakdown, then order snapshot."""
    return F.coalesce(*sources)


def net_of_step_up(amounts: Sequence[Column], step_ups: Sequence[Column]) -> Column:
    """Preferred commission less the preferred step-up; the two are chosen independently."""
    return prefer(*amounts) - prefer(*step_ups)


def payout_filter(
    currency: Column, tx_type: Column, types: Mapping[str, Sequence[int]] = PAYOUT_TYPES_BY_CURRENCY
) -> Column:
    """Which wallet transactions count as payouts, per currency."""
    test = F.lit(False)
    for code, kinds in types.items():
        test = test | ((currency == code) & tx_type.isin(list(kinds)))
    return test


def promo_override(merchant_name: Column, pattern: str, order_value: Column, mart_value: Column) -> Column:
    """Some brands' promos are only right in the order document."""
    return F.when(contains_ci(merchant_name, pattern), order_value).otherwise(mart_value)
