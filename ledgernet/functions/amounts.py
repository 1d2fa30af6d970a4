"""Amount and number expressions."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgernet.schema import MONEY

#: Units of an amount, and the bits of the lower half of their number.
_UNITS, _HALF = float(10**MONEY.scale), 24
_BLANKS = " \t\n\r\f\v"
# Letters of "NaN", "inf", hexadecimal and type suffixes, which casts accept; not e.
_NO_NUMBER = "[A-DF-Za-df-z]"


def parse_amount(raw: Column) -> Column:
    """Text amount to double. Blank and null give 0.0; text that is no number gives null.

    With both marks present the dots group thousands and the comma is the decimal
    point; a lone comma is the decimal point. So wherever there is a comma, dots go
    and the comma becomes the point.
    """
    text = F.btrim(raw.cast("string"), F.lit(_BLANKS))
    plain = F.when(F.contains(text, F.lit(",")), F.translate(text, ",.", ".")).otherwise(text)
    return F.when(text.isNull() | (text == ""), F.lit(0.0)).when(~text.rlike(_NO_NUMBER), plain.try_cast("double"))


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def lenient_number(value: Column) -> Column:
    """Anything to a finite double, 0.0 where that fails."""
    return F.coalesce(finite(value.try_cast("double")), F.lit(0.0))


def first_given(first: Column, second: Column) -> Column:
    """The first of two text amounts unless it is absent or empty; a text of blanks or "0" is given."""
    return F.when(first != "", first).otherwise(second)


def edge_weight(valor: Column) -> Column:
    """Weight of an edge: its amount, 1.0 when it has none."""
    return F.coalesce(valor, F.lit(1.0))


def money(value: Column) -> Column:
    return value.cast(MONEY.simpleString())


def _units(value: Column) -> tuple[Column, Column]:
    """The ten-thousandths of an amount, and whether they are the same number and below 2**47."""
    units = F.rint(value * _UNITS)
    return units, (F.abs(value) < F.lit(1e10)) & (units / _UNITS == value)


def rounded_money(value: Column) -> Column:
    """The double ``value`` with the digits that amounts have."""
    return F.when(_units(value)[1], value).otherwise(money(value).cast("double"))


def money_sum(value: Column) -> Column:
    """Exact sum of amounts, as a double; null without any.

    An amount below ten billion that is the double of a whole number of ten-thousandths is
    added as this number, in two halves that no sum of 2**39 rows overflows. That costs less
    than decimals, which take the others.
    """
    units, plain = _units(value)
    whole = F.when(plain, units.cast("long"))
    low = F.sum(whole.bitwiseAND(F.lit((1 << _HALF) - 1))).cast("decimal(20,0)")
    high = F.sum(F.shiftright(whole, _HALF)).cast("decimal(20,0)")
    unit = F.lit(Decimal(1).scaleb(-MONEY.scale))
    added = (high * F.lit(Decimal(1 << _HALF)) + low) * unit
    others = F.sum(F.when(~plain, money(value)))
    return F.coalesce(added + others, added, others).cast("double")
