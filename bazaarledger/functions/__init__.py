from . import dates, order_rules, payment_rules, predicates, report_rules, scalars

__all__ = ["dates", "order_rules", "payment_rules", "predicates", "report_rules", "scalars"]
