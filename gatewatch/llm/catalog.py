"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .conversations import op13_conversation_repair
from .lines import op11_line_dedup
from .mixing import op8_mixture
from .negatives import op12_hard_negatives
from .neighbours import op2_neighbours
from .oracles import ORACLES
from .packing import op1_packing
from .quality import op7_line_quality
from .secrets import op5_secrets
from .simhash import op4_simhash
from .substrings import op10_substrings
from .tokens import op3_token_counts
from .url_filter import op6_url_filter
from .warc import op9_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_neighbours": op2_neighbours,
    "op3_token_counts": op3_token_counts,
    "op4_simhash": op4_simhash,
    "op5_secrets": op5_secrets,
    "op6_url_filter": op6_url_filter,
    "op7_line_quality": op7_line_quality,
    "op8_mixture": op8_mixture,
    "op9_warc": op9_warc,
    "op10_substrings": op10_substrings,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

__all__ = ["ORACLES", "QUERIES"]
