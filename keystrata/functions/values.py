"""Comparison of values by their string forms and by byte order of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: How a missing value prints where parity with string comparison is asked for.
NIL = "<nil>"


def text_form(c: Column, nil: bool = False) -> Column:
    """A value's string form; nulls stay null, so that SQL's logic holds, unless ``nil`` asks for their printed form."""
    out = c.cast("string")
    return F.coalesce(out, F.lit(NIL)) if nil else out


def equals(c: Column, value: int | str, nil: bool = False) -> Column:
    """Equality of string forms: 30 matches '30', and 1 matches '1' but not '01'."""
    return text_form(c, nil) == F.lit(str(value))


def column_equals(df: DataFrame, name: str, value: int | str, nil: bool = False) -> Column:
    """``equals`` by the column's own type where both agree, so that the filter reaches the scan."""
    kind = df.schema[name].dataType
    if isinstance(kind, IntegralType):
        if isinstance(value, int):
            return F.col(name) == F.lit(value)
        if value.removeprefix("-").isdigit() and str(int(value)) == value and abs(int(value)) < 2**31:
            return F.col(name) == F.lit(int(value))
    return equals(F.col(name), value, nil)


def column_between(df: DataFrame, name: str, low: int | str, high: int | str, nil: bool = False) -> Column:
    """Both ends included; numeric if the column and both bounds are integers, else by bytes of the string forms."""
    if isinstance(df.schema[name].dataType, IntegralType) and isinstance(low, int) and isinstance(high, int):
        return F.col(name).between(low, high)
    return text_form(F.col(name), nil).between(str(low), str(high))


def in_range(key: Column, start: str, end: str) -> Column:
    """Half-open range of string keys; an empty end is open."""
    inside = key >= F.lit(start)
    return inside & (key < F.lit(end)) if end else inside


def hlc_pack(ms: Column, counter: Column) -> Column:
    """A hybrid logical timestamp: 48 bits of milliseconds, 16 of a counter that carries into them when it overflows."""
    return F.shiftleft(ms.cast("bigint"), 16) + counter.cast("bigint")


def hlc_ms(stamp: Column) -> Column:
    return F.shiftright(stamp, 16)
