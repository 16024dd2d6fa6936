"""List markers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuskit.functions.text import _c

# Fixed values.
ROMAN_UNITS = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")


def roman(number: Column | str) -> Column:
    """Lower-case roman numeral: tens by repetition, units by table."""
    number = _c(number)
    units = F.array(*[F.lit(u) for u in ROMAN_UNITS])
    tens = F.repeat(F.lit("x"), F.floor(number / 10).cast("int"))
    return F.concat(tens, F.get(units, (number % 10).cast("int")))


def list_marker(style: Column | str, index: Column | str, depth: Column | str) -> Column:
    """Marker of the item at 0-based `index`. Lists without a known style count
    in digits at the top level and in roman numerals below it."""
    style, index, depth = _c(style), _c(index), _c(depth)
    digits = (index + 1).cast("string")
    return (
        F.when(style == "alpha", F.char(F.lit(97) + index))
        .when(style == "numbered", digits)
        .when(depth > 0, roman(index + 1))
        .otherwise(digits)
    )
