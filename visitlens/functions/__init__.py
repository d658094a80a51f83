"""Column expressions."""

from visitlens.functions.dates import (format_date, month_name_es, month_number_es,
                                       parse_date_flexible)
from visitlens.functions.similarity import lcs, lcs_length, ratio_from_lcs
from visitlens.functions.text import (collapse_whitespace, contains_ci, non_blank_tokens,
                                      normalize_text, split_literal, split_tokens, strip,
                                      strip_accents, strip_point_zero, token_sort)
from visitlens.functions.values import (custom_order_key, export_url, n_pct_label,
                                        parse_bool_flexible, pct, round1, short_label)

__all__ = [
    "strip", "collapse_whitespace", "strip_accents", "normalize_text", "split_literal",
    "split_tokens", "non_blank_tokens", "contains_ci", "token_sort", "strip_point_zero",
    "parse_date_flexible", "month_name_es", "month_number_es", "format_date",
    "parse_bool_flexible", "round1", "pct", "n_pct_label", "short_label",
    "custom_order_key", "export_url",
    "lcs", "lcs_length", "ratio_from_lcs",
]
