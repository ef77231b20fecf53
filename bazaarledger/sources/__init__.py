from .documents import ORDER_DOCUMENT, ORDER_METADATA
from .logs import log_events
from .partitions import CompactDate, DateText, YearMonthDay, partition_between
from .tables import Tables, union_tables

__all__ = [
    "CompactDate", "DateText", "ORDER_DOCUMENT", "ORDER_METADATA", "Tables", "YearMonthDay", "log_events",
    "partition_between", "union_tables",
]
