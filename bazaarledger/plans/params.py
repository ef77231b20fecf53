"""Typed report parameters. `None` or an empty tuple means unset: the matching filter is left out."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from enum import Enum

from ..codes import EARLY_PAYMENT_COUNTRIES, LOG_RETENTION_DAYS, Codes
from ..functions.dates import Grain

Day = date | str
Ids = tuple[int, ...]
Names = tuple[str, ...]


class Delivery(str, Enum):
    ALL = "all"
    TAKEAWAY = "takeaway"
    DELIVERY = "delivery"


class Completion(str, Enum):
    ALL = "all"
    COMPLETED_ONLY = "completed_only"
    EXCLUDE_COMPLETED = "exclude_completed_orders"


class YesNo(str, Enum):
    ALL = "all"
    YES = "yes"
    NO = "no"


class BusinessLine(str, Enum):
    ALL = "all"
    MARKET = "market"
    KITCHEN = "kitchen"
    KITCHEN_SINGLE = "kitchen_single"
    KITCHEN_MIXED = "kitchen_mixed"


class Dimension(str, Enum):
    MERCHANT = "merchant"
    BRAND = "brand"


class RefundGrain(str, Enum):
    ORDER = "order"
    ITEM = "item"
    SUB_ITEM = "sub_item"


class RefundSource(str, Enum):
    REQUEST = "request"
    CASE = "case"


@dataclass(frozen=True, kw_only=True)
class CashParams:
    start: Day | None = None
    end: Day | None = None
    merchants: Names = ()
    currencies: Names = ()


@dataclass(frozen=True, kw_only=True)
class RatingsParams:
    grain: Grain
    start: Day | None = None
    end: Day | None = None
    countries: Ids = ()
    cities: Ids = ()
    merchants: Names = ()
    by_merchant: bool = True
    completed_only: bool = False
    include_orders: bool = False
    codes: Codes = field(default_factory=Codes)


@dataclass(frozen=True, kw_only=True)
class PnlParams:
    start: Day
    end: Day
    grain: Grain = Grain.TOTAL
    dimension: Dimension = Dimension.MERCHANT
    countries: Ids = ()
    cities: Ids = ()
    merchants: Names = ()
    business_types: Names = ()
    verticals: Names = ()
    unit_economics: bool = False


@dataclass(frozen=True, kw_only=True)
class PromoParams:
    regions: Names
    start: Day | None = None
    end: Day | None = None
    country_names: Names = ()
    countries: Ids = ()
    cities: Ids = ()
    reward_ids: Names = ()
    keep_unmatched: bool = False
    hot_rows: int | None = None  # rows of one order id that a task may take; unset: a plain full join


@dataclass(frozen=True, kw_only=True)
class SettlementParams:
    start: Day | None = None
    end: Day | None = None
    updated_start: Day | None = None
    updated_end: Day | None = None
    currencies: Names = ()
    statuses: Names = ()
    settlement_ids: Names = ()
    merchant_info: Names = ()
    search_merchant: bool = False
    own_partner_only: bool = True
    order_window_days: int = 2
    utc_offset_hours: int = 8
    codes: Codes = field(default_factory=Codes)


@dataclass(frozen=True, kw_only=True)
class EarlyPaymentParams:
    start: Day | None = None
    end: Day | None = None
    delivered_start: Day | None = None
    delivered_end: Day | None = None
    countries: Ids = ()
    cities: Ids = ()
    merchants: Names = ()
    chains: Names = ()
    fixed_countries: Ids = EARLY_PAYMENT_COUNTRIES
    bank_details: bool = False
    payout_details: bool = False
    hot_merchant_rows: int | None = None  # rows of one merchant that a task may take; unset: adaptive execution splits
    codes: Codes = field(default_factory=Codes)


@dataclass(frozen=True, kw_only=True)
class PaymentParams:
    start: Day
    end: Day
    as_of: Day
    delivered_start: Day | None = None
    delivered_end: Day | None = None
    countries: Ids = ()
    cities: Ids = ()
    merchants: Names = ()
    chains: Names = ()
    order_ids: Names = ()
    mart_range_days: int = 0
    delivery: Delivery = Delivery.ALL
    completion: Completion = Completion.ALL
    pos_integrated: YesNo = YesNo.ALL
    business_line: BusinessLine = BusinessLine.ALL
    auto_accept: YesNo = YesNo.ALL
    bank_details: bool = False
    payout_details: bool = False
    hot_merchant_rows: int | None = None  # rows of one merchant that a task may take; unset: adaptive execution splits
    retention_days: int = LOG_RETENTION_DAYS
    codes: Codes = field(default_factory=Codes)


@dataclass(frozen=True, kw_only=True)
class RefundParams:
    sources: frozenset[RefundSource]
    grain: RefundGrain = RefundGrain.ORDER
    start: Day | None = None
    end: Day | None = None
    countries: Ids = ()
    cities: Ids = ()
    merchants: Names = ()
    history: bool = False
    history_start: Day | None = None
    history_end: Day | None = None
    codes: Codes = field(default_factory=Codes)
