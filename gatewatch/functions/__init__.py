"""Column expressions (all JVM-side, no Python UDFs)."""

from .classify import DEFAULT_RULES, category_of, rules_sql_case
from .dates import format_date_br, parse_date_br, parse_date_robust
from .labels import label_decimal1, label_int, label_pct, report_line
from .numbers import parse_number_br, to_number_or_zero
from .rates import axis_limit, rate_band, ratio_1dp, retention_rate, round_ratio_half_up
from .text import blank_to_null, clean_operator, normalize_header, unicode_trim

__all__ = [
    "DEFAULT_RULES", "category_of", "rules_sql_case",
    "format_date_br", "parse_date_br", "parse_date_robust",
    "label_decimal1", "label_int", "label_pct", "report_line",
    "parse_number_br", "to_number_or_zero",
    "axis_limit", "rate_band", "ratio_1dp", "retention_rate", "round_ratio_half_up",
    "blank_to_null", "clean_operator", "normalize_header", "unicode_trim",
]
