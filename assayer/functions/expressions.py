"""Small Column helpers shared by all operators."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.specs import SpecError


def pct(part: Column, whole: Column) -> Column:
    """part / whole * 100, and 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100.0).otherwise(F.lit(0.0))


def count_rows() -> Column:
    return F.count(F.lit(1))


def zero_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0).cast("bigint"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def text_list(values: list[str]) -> str:
    return ",".join(values)


def column_type(df: DataFrame, name: str) -> T.DataType:
    """Type of a (possibly qualified) column; the analyzer rejects missing or ambiguous names."""
    found = [f.dataType for f in df.schema if f.name == name]
    if len(found) == 1:
        return found[0]
    return df.select(F.col(name)).schema[0].dataType


def number_literal(value, data_type: T.DataType) -> Column:
    """A number to compare with a numeric column, without rounding either side."""
    if isinstance(data_type, (T.IntegralType, T.DecimalType)):
        exact = Decimal(str(value))
        if exact.is_finite():
            return _decimal(exact)
    return F.lit(float(value))


def _decimal(exact: Decimal) -> Column:
    """A literal with the digits it has, so that comparing widens the column instead of rounding the value."""
    _, digits, exponent = exact.as_tuple()
    scale = max(0, -exponent)
    precision = max(len(digits) + max(0, exponent), scale, 1)
    if precision > 38:
        raise SpecError(f"number {exact} has more than 38 digits")
    return F.lit(format(exact, "f")).cast(f"decimal({precision},{scale})")


def typed_literal(value, data_type: T.DataType) -> Column:
    """A literal of the column's type, rejected here when the value does not convert.

    Numbers compared with numeric columns stay as they are, so 2.5 against an integer
    column is not truncated.
    """
    if value is None:
        return F.lit(None).cast(data_type)
    if isinstance(data_type, T.StringType):
        return F.lit(value if isinstance(value, str) else _plain(value))
    if not isinstance(value, str):
        if isinstance(value, (dt.date, dt.datetime)) or isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return _moment(str(value), data_type)
        if isinstance(value, float) and isinstance(data_type, T.DecimalType):
            return number_literal(value, data_type)
        return F.lit(value)
    text = value.strip()
    try:
        if isinstance(data_type, T.IntegralType):
            number = int(text)
            if abs(number) >= 2**63:
                raise ValueError(text)
            return F.lit(number)
        if isinstance(data_type, T.DecimalType):
            return _decimal(Decimal(text))
        if isinstance(data_type, T.FractionalType):
            Decimal(text)
        elif isinstance(data_type, T.BooleanType):
            if text.lower() not in ("true", "false", "t", "f", "1", "0", "y", "n", "yes", "no"):
                raise ValueError(text)
        elif isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return _moment(text, data_type)
    except (ValueError, InvalidOperation) as exc:
        raise SpecError(f"value {value!r} is not a {data_type.simpleString()}") from exc
    return F.lit(text).cast(data_type)


def _moment(text: str, data_type: T.DataType) -> Column:
    """A date or timestamp literal that keeps its time of day and its offset.

    Against a date column a value with a time of day stays a timestamp, and the column widens.
    Zone-free columns are UTC, so a value with an offset is moved to UTC first.
    """
    moment = dt.datetime.fromisoformat(text)
    if isinstance(data_type, T.TimestampType):
        return F.lit(text).cast("timestamp")
    if moment.tzinfo is not None:
        moment = moment.astimezone(dt.timezone.utc).replace(tzinfo=None)
    whole_day = moment.time() == dt.time()
    return F.lit(str(moment)).cast("date" if isinstance(data_type, T.DateType) and whole_day else "timestamp_ntz")


def _plain(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def _ntz_epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_micros(col: Column, data_type: T.DataType) -> Column:
    """Microseconds since 1970 in UTC; values without zone count as UTC."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(col)
    return F.timestamp_diff("MICROSECOND", _ntz_epoch(), col.cast("timestamp_ntz"))


def as_instant(col: Column, data_type: T.DataType) -> Column:
    """A date or timestamp as an instant, whatever the session's time zone."""
    return col if isinstance(data_type, T.TimestampType) else F.timestamp_micros(epoch_micros(col, data_type))


def utc_instant(col: Column, data_type: T.DataType) -> Column:
    """A date or timestamp as a zone-free UTC value, whatever the session's time zone."""
    if not isinstance(data_type, T.TimestampType):
        return col.cast("timestamp_ntz")
    seconds = F.unix_micros(col).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")
    zero = F.lit(0)
    return _ntz_epoch() + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def utc_now(as_of: str | None) -> Column:
    if as_of:
        return F.lit(as_of).cast("timestamp_ntz")
    return utc_instant(F.current_timestamp(), T.TimestampType())


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end).cast("double") / F.lit(3.6e9)
