"""Code values found in the input data.

Values that belong to one data provider (partner names, kitchen types, service names) default to neutral text and are
meant to be replaced: ``Codes(partner_orders="...")``.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: numeric codes, labels and patterns the reports depend on. -----------------------------------
COMPLETED_STATE = 11
INTEGRATED_ORDER_TYPE = 1
AUTO_ACCEPT_FLAG = "3"
LOG_RETENTION_DAYS = 85
CASHIER_DRIVER_USER = 2
CASHIER_TX_ORDER = 1
CASHIER_TX_MERCHANT = 2
CASHIER_TX_ADJUSTMENT = 14
CASHIER_TX_PROMO_FROM = 1000
CASHIER_TX_PROMO_BELOW = 1100
CASH_ORDER_MODE_MAX = 2
REFUND_PLACEHOLDER_DRIVER = -999
REFUND_IGNORED_ACTION = 4
MAIN_COUNTRY_MAX_ID = 6
EARLY_PAYMENT_COUNTRIES = (1, 4)
PAYOUT_TYPES_BY_CURRENCY = {"SGD": (60,), "MYR": (60,), "THB": (56, 60)}
EARLY_PAYOUT_CURRENCIES = ("SGD", "MYR")
EARLY_PAYOUT_TYPE = 60
CASHIER_CURRENCIES = ("SGD", "MYR")
SETTLEMENT_TX_TYPES = (59, 60)
ADJUSTMENT_MARK = "ADJUSTMENT"
OUT_OF_STOCK_MESSAGE = "Food is out of stock"
TICKET_PREFIX = "zendesk:"
TEXT_GUARD = "`"
# ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Codes:
    """Provider-specific text values, with neutral defaults."""

    partner_orders: str = "ORDERS"
    partner_multi: str = "MULTIBUSINESSLINE"
    partner_lending: str = "LENDING"
    kitchen_mixed: str = "KITCHENMIXMATCH"
    kitchen_single: str = "KITCHENNORMAL"
    vertical: str = "Food"
    service_name: str = "Food"
    ticket_service: str = "food"
    refund_category: str = "FOOD"
    case_category: str = "FoodMissingWrongItem"
    case_ticket_state: str = "GET_ZENDESK_TICKET_DETAILS"
    case_policy_state: str = "CHECK_FOOD_POLICY_ENGINE"
    case_payout_target: str = "PAX_WALLET"
    case_source_label: str = "Case"
    request_source_label: str = "Request"
    accept_log: str = "order-log"
    accept_operation: str = "order.auto.accept"
    accept_label: str = "AA Order"
    pos_partner: str = "pos-a"
    promo_name_pattern: str = "brand"
    cashout_success: str = "CASHOUT_SUCCESS"
    settlement_started: str = "SETTLE_INITIATED"
    settlement_done: str = "SETTLED"
