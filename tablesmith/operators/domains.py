"""Domains of key types: how many values a type has, and each value's number.

``value`` turns a number (0 .. size-1) into a value and ``number`` turns it back (null where a value is none of the domain), both as column
expressions. With them the keys of any type are numbers, so that free ones are found by one anti join, and a domain that is too small is known before
anything runs. Positive numbers come first, as 1, 2, 3, then zero and the negative ones.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablesmith.functions import generators as G
from tablesmith.spec import FRACTIONS, NUMBERS, ColumnSpec

#: Largest values of whole-number types.
TOPS = {"smallint": (1 << 15) - 1, "int2": (1 << 15) - 1, "smallserial": (1 << 15) - 1, "mediumint": (1 << 23) - 1, "bigint": (1 << 63) - 1, "int8": (1 << 63) - 1, "bigserial": (1 << 63) - 1}
#: Types of at least so many values go on after the largest key while they can; of smaller ones the free values are looked for.
OPEN = 1 << 31
#: Base-36 digits of a short text key.
DIGITS = 8


@dataclass(frozen=True)
class Domain:
    kind: str
    size: int
    value: Callable[[Column], Column]
    number: Callable[[Column], Column]


def div(a: Column, b: int) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, F.lit(b))


def whole(top: int, bottom: int) -> Domain:
    """1 .. top, then 0, -1 .. bottom."""
    size = min(top - bottom + 1, (1 << 63) - 1)
    return Domain("whole", size, lambda i: F.when(i < top, i + 1).otherwise(F.lit(top) - i), lambda v: F.when(v > 0, v.cast("long") - 1).otherwise(F.lit(top) - v.cast("long")))


def span(low: int, high: int) -> Domain:
    return Domain("whole", max(0, high - low + 1), lambda i: i + low, lambda v: v.cast("long") - low)


def listed(values: list[str]) -> Domain:
    array = F.array(*[F.lit(v) for v in values])
    return Domain("listed", len(values), lambda i: F.element_at(array, (i + 1).cast("int")), lambda v: F.array_position(array, v.cast("string")).cast("long") - 1)


def fixed_point(precision: int, scale: int) -> Domain:
    """All values of numeric(precision, scale): whole ones first, then the other positive ones, then zero and the negative ones."""
    unit, ones, positive = 10**scale, 10 ** (precision - scale) - 1, 10**precision - 1

    def value(i: Column) -> Column:
        rest = i - ones
        between = div(rest, unit - 1) * unit + rest % (unit - 1) + 1 if scale else i + 1
        digits = F.when(i < ones, (i + 1) * unit).when(i < positive, between).otherwise(F.lit(positive) - i)
        return (digits.cast("decimal(19,0)") * F.lit(f"1e-{scale}").cast(f"decimal({scale + 1},{scale})")).cast(f"decimal({precision},{scale})")

    def number(v: Column) -> Column:
        digits = (v.cast(f"decimal({precision},{scale})") * F.lit(unit).cast("decimal(19,0)")).cast("long")
        between = div(digits, unit) * (unit - 1) + digits % unit - 1 + ones if scale else digits - 1
        return F.when((digits > 0) & (digits % unit == 0), div(digits, unit) - 1).when(digits > 0, between).otherwise(F.lit(positive) - digits)

    return Domain("whole", 2 * positive + 1, value, number)


def short_text(digits: int) -> Domain:
    """Base-36 numbers of a fixed width."""
    return Domain("text", 36**digits, lambda i: F.lpad(F.lower(F.conv(i.cast("string"), 10, 36)), digits, "0"), lambda v: F.when(v.cast("string").rlike(f"^[0-9a-z]{{{digits}}}$"), F.conv(v.cast("string"), 36, 10).cast("long")))


def _clock_number(v: Column) -> Column:
    return F.unix_timestamp(F.concat(F.lit("1970-01-01 "), v.cast("string"))) - F.unix_timestamp(F.lit("1970-01-01 00:00:00"))


def temporal(kind: str, end: dt.date) -> Domain | None:
    """The days (or the seconds of a day, or all seconds) from 2000 to ``end``."""
    days = (end - G.START).days + 1
    if kind == "date":
        return Domain("temporal", days, G.day, lambda v: F.datediff(v, F.lit(G.START)).cast("long"))
    if kind == "datetime" or kind.startswith("timestamp"):
        return Domain("temporal", days * 86_400, G.instant, lambda v: F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"), v.cast("timestamp_ntz")))
    return Domain("temporal", 86_400, G.clock, _clock_number) if kind.startswith("time") else None


def of(c: ColumnSpec, end: dt.date) -> Domain | None:
    """The domain of a key column without a parent; none where it has no practical bound (uuids, long texts, wide numbers)."""
    kind = c.type.lower()
    if c.check_values:
        return listed(c.check_values)
    if kind in ("bool", "boolean", "bit", "tinyint"):
        return Domain("listed", 2, lambda i: i == 1, lambda v: v.cast("boolean").cast("long"))
    if kind in NUMBERS and c.check_min is not None and c.check_max is not None:
        return span(c.check_min, c.check_max)
    if kind in NUMBERS:
        top = TOPS.get(kind, (1 << 31) - 1)
        return whole(top, -top - 1)
    if kind == "year":
        return span(1901, 2155)
    if kind in ("decimal", "numeric", "money"):
        precision, scale = (19, 2) if kind == "money" else c.precision()
        return fixed_point(precision, scale) if precision <= 18 and scale <= precision else None
    if kind in ("real", "float4"):
        return whole(1 << 24, -(1 << 24))  # the whole numbers that four bytes hold exactly
    if kind in FRACTIONS:
        return None
    if (found := temporal(kind, end)) is not None:
        return found
    n = c.length()
    return short_text(min(n, DIGITS)) if n and n < 32 else None
