"""Small column helpers over built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codes import TEXT_GUARD


def number(text: Column) -> Column:
    """Text (or numeric) to double; unreadable text gives NULL."""
    return text.try_cast("double")


def number_or_zero(text: Column) -> Column:
    return F.coalesce(number(text), F.lit(0.0))


def minor_to_major(amount: Column, exponent: Column | None = None) -> Column:
    """Minor currency units to major units: / 100, or / 10^exponent when the currency states its exponent."""
    if exponent is None:
        return number(amount) / F.lit(100.0)
    return number(amount) / F.pow(F.lit(10.0), number(exponent))


def minor_to_major_whole(amount: Column) -> Column:
    """Integer division by 100, truncating toward zero."""
    return F.call_function("div", amount.try_cast("bigint"), F.lit(100))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double ratio; zero or NULL denominator gives NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def same_amount(left: Column, right: Column) -> Column:
    """Equality of money to the cent, whatever numeric types the inputs have."""
    return left.cast("decimal(18,2)") == right.cast("decimal(18,2)")


def decode_nested_json(text: Column) -> Column:
    """Undo one level of JSON-in-a-JSON-string: drop backslashes, unquote objects."""
    plain = F.replace(text, F.lit("\\"), F.lit(""))
    opened = F.replace(plain, F.lit('"{'), F.lit("{"))
    return F.replace(opened, F.lit('}"'), F.lit("}"))


def local_time(ts: Column, zone: Column) -> Column:
    """UTC wall clock to the wall clock of a zone held in a column."""
    return F.from_utc_timestamp(ts, zone)


def local_date(ts: Column, zone: Column) -> Column:
    return F.to_date(local_time(ts, zone))


def shift_hours(ts: Column, hours: int) -> Column:
    return ts + F.expr(f"INTERVAL '{int(hours)}' HOUR")


def iso_time(text: Column) -> Column:
    """ISO-8601 text, with or without zone, to a timestamp; unreadable text gives NULL."""
    return text.try_cast("timestamp")


def text_guard(text: Column) -> Column:
    """Prefix that keeps a spreadsheet from reading digits as a number."""
    return F.concat(F.lit(TEXT_GUARD), text)


def typed_null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def never_matching(key: Column, tiebreak: Column) -> Column:
    """Join key in which NULL becomes a distinct value per row that equals no real key.

    A NULL key matches nothing either way, but all NULLs hash to one partition; this spreads them.
    """
    return F.coalesce(key, F.concat(F.lit("\x00"), tiebreak.cast("string")))
