"""Number parsing with coerce-to-zero semantics, ANSI-safe (no raising casts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, unicode_trim

# A plain decimal literal. try_cast alone would accept 'NaN', 'Infinity' and
# Java suffixes such as '5d'; the gate keeps only what is really a number.
_DECIMAL = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# pt-BR thousands without decimals: 1.234 or 1.234.567
_THOUSANDS = r"^[+-]?[0-9]{1,3}([.][0-9]{3})+$"


def _gated_double(text: Column) -> Column:
    return F.when(text.rlike(_DECIMAL), text.try_cast("double"))


def to_number_or_zero(c) -> Column:
    """Coerce to double; anything that is not a number becomes 0."""
    return number_of_text(unicode_trim(col_of(c).cast("string")))


def number_of_text(text: Column) -> Column:
    """``to_number_or_zero`` of a text that is trimmed already."""
    return F.coalesce(_gated_double(text), F.lit(0.0))


def parse_number_br(c) -> Column:
    """pt-BR number text ('1.234,5', '1.234', '1,5') to double; bad -> 0.

    Dots are read as thousands separators only when the value has a comma or
    is a pure thousands pattern, so a plain '10.5' stays 10.5.
    """
    return number_of_br_text(unicode_trim(col_of(c).cast("string")))


def number_of_br_text(text: Column) -> Column:
    """``parse_number_br`` of a text that is trimmed already."""
    br_style = text.contains(",") | text.rlike(_THOUSANDS)
    normalised = F.when(
        br_style, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    ).otherwise(text)
    return F.coalesce(_gated_double(normalised), F.lit(0.0))
