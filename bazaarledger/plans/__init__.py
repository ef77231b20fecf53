from .cash import cash_report
from .payments_early import early_payment_report
from .payments_single import single_payment_report
from .payments_split import split_payment_report
from .pnl import pnl_report
from .promo import promo_report
from .ratings import ratings_report
from .refunds import refund_report
from .settlement import settlement_report

__all__ = [
    "cash_report", "early_payment_report", "pnl_report", "promo_report", "ratings_report", "refund_report",
    "settlement_report", "single_payment_report", "split_payment_report",
]
