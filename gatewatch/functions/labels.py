"""pt-BR display labels: '1.234.567', '12,50%', '1,5'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import UNKNOWN_OPERATOR
from .text import col_of


def label_int(c) -> Column:
    """Whole number with '.' as thousands separator."""
    return F.translate(F.format_number(col_of(c).cast("double"), 0), ",", ".")


def label_pct(c) -> Column:
    """Two decimals with a decimal comma and a percent sign."""
    return F.concat(F.translate(F.format_string("%.2f", col_of(c).cast("double")), ".", ","),
                    F.lit("%"))


def label_decimal1(c) -> Column:
    """One decimal with a decimal comma ('1,5')."""
    return F.translate(F.format_string("%.1f", col_of(c).cast("double")), ".", ",")


def report_line(operator, flights, routes) -> Column:
    """'<operator> - <flights> voos - <routes> rotas' report line."""
    return F.format_string("%s - %s voos - %s rotas", F.coalesce(col_of(operator), F.lit(UNKNOWN_OPERATOR)),
                           col_of(flights).cast("string"), col_of(routes).cast("string"))
