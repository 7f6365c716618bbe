"""Numeric expressions. Money is integer cents or decimal, never double."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F


def dec(col: Column, precision: int = 20, scale: int = 0) -> Column:
    return col.cast(f"decimal({precision},{scale})")


def ratio(num: Column, den: Column, scale: int = 2) -> Column:
    """num / den rounded half-up to ``scale`` digits; NULL for a zero divisor."""
    return F.round(F.try_divide(dec(num, 20, 4), dec(den, 20, 4)), scale).cast(f"decimal(20,{scale})")


def int_div(num: Column, den) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", num, den if isinstance(den, Column) else F.lit(den))


def round_div(num: list, den: list, minus: list | None = None) -> Column:
    """(product of ``num`` - product of ``minus``) / product of ``den``, rounded half-up to an integer.

    Exact: products are 38-digit decimals and no intermediate quotient is rounded. Factors are integer
    columns or numbers. NULL for a zero divisor. One short expression on purpose: a second path for small
    numbers made the generated code too long to be compiled.
    """
    product = lambda factors: reduce(mul, [dec(f if isinstance(f, Column) else F.lit(f)) for f in factors])
    n = product(num) - product(minus) if minus else product(num)
    d = F.nullif(product(den), F.lit(0))
    return F.signum(n).cast("bigint") * int_div(2 * F.abs(n) + d, 2 * d)


def cents(col: Column) -> Column:
    """Euro decimal as integer cents."""
    return (dec(col, 16, 2) * 100).cast("bigint")


def euro(cent_col: Column) -> Column:
    """Integer cents as euro with two digits."""
    return (dec(cent_col, 15) * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")
