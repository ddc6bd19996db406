"""Rule-based classification of free-text notes.

A note gets the first category (in rule order) having a keyword that is a
substring of the upper-cased note; no word boundaries. The note is upper-cased
once and each category is one pattern of all its keywords, which passes over
the note once, however many keywords there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of

Rules = Sequence[tuple[str, Sequence[str]]]

# Default categories and keywords, in priority order.
DEFAULT_RULES: Rules = (
    ("🌧️ Chuva/Vento", ("CHUVA", "VENTO", "CLIMA", "TEMPO", "NEBLINA")),
    ("🔧 Problema Técnico", ("TÉCNICO", "TECNICO", "ZOOM", "CÂMERA", "CAMERA", "AERONAVE",
                           "APP", "CALIBRAGEM", "HÉLICE", "HELICE")),
    ("👷 Operacional/RH", ("FALTA", "ATRASO", "MÉDICO", "MEDICO", "PASSO MAL", "DDS")),
    ("⚠️ Outros", ("FOGOS", "INTERROMPIDO", "VIRADA")),
)


def keyword_pattern(keywords: Iterable[str]) -> str:
    """One pattern that finds any of the keywords, each taken literally.

    Keywords are merged into a tree by their beginnings, so that a place in the
    text is given up at the first character that begins none of them.
    """
    tree: dict = {}
    for word in keywords:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        if "" in at:  # a keyword ends here; longer ones add nothing to a match
            return ""
        if len(at) == 1:
            (c, below), = at.items()
            return re.escape(c) + pattern(below)
        return "(?:" + "|".join(re.escape(c) + pattern(below) for c, below in at.items()) + ")"

    found = pattern(tree)
    if not found or len(tree) == 1:
        return found
    return f"(?=[{''.join(map(re.escape, tree))}]){found}"


def category_of(text, rules: Rules = DEFAULT_RULES) -> Column:
    """Category of the first matching rule, or null."""
    rules = [(c, kws) for c, kws in rules if kws]
    if not rules:
        return F.lit(None).cast("string")

    def first(upper: Column) -> Column:
        expr = None
        for category, keywords in rules:
            hit = upper.rlike(keyword_pattern(kw.upper() for kw in keywords))
            expr = F.when(hit, F.lit(category)) if expr is None else expr.when(hit, F.lit(category))
        return expr

    # a lambda binds the upper-cased note once for all conditions
    return F.element_at(F.transform(F.array(F.upper(col_of(text))), first), 1)


def rules_sql_case(text_sql: str, rules: Rules = DEFAULT_RULES) -> str:
    """The same classification as an ANSI CASE expression (oracle side)."""
    parts = []
    for category, keywords in rules:
        if not keywords:
            continue
        cond = " OR ".join(
            f"contains(upper({text_sql}), '{kw.upper()}')" for kw in keywords)
        cat = category.replace("'", "''")
        parts.append(f"WHEN {cond} THEN '{cat}'")
    if not parts:
        return "CAST(NULL AS VARCHAR)"
    return "CASE " + " ".join(parts) + " END"
