"""Text helpers: Unicode-aware trimming, header normalisation, operator names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import UNKNOWN_OPERATOR

# Every character Python's str.strip() removes (str.isspace): ASCII blanks
# and controls, U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000. Spark's one-argument trim() only removes ' '.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parsed_once(df: DataFrame) -> DataFrame:
    """``df`` behind a step that no filter is pushed through.

    A filter on a parsed value would otherwise be moved below the projection
    that parses it, with a copy of the whole parser, and the text would be
    parsed for the filter and again for the result. The rows pass as one-item
    arrays of structs; only the columns that are used are built.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]))))


def unicode_trim(c) -> Column:
    """Strip leading and trailing whitespace as Python's str.strip() does
    (a plain character-set trim, no regular expression)."""
    return F.trim(col_of(c), F.lit(WHITESPACE))


def blank_to_null(c) -> Column:
    """Blank or whitespace-only text becomes null (merged-cell gaps)."""
    c = col_of(c)
    return F.when(unicode_trim(c) == "", F.lit(None).cast("string")).otherwise(c)


def clean_operator(c) -> Column:
    """Null operator -> the 'unknown' label, then a Unicode trim."""
    return unicode_trim(F.coalesce(col_of(c).cast("string"), F.lit(UNKNOWN_OPERATOR)))


def normalize_header(name: str) -> str:
    """Header as matched by the audit module: stripped and upper-cased."""
    return name.strip().upper()
