"""Scores of readings, and the choices that rest on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PRIMARY_FIELDS, RATE_FIELDS, is_number
from .text import clean_spaces, is_clean_placeholder, replaced

# Fields that are read again, and the scores below which they are.
RETRIED = ["article", "unit", "foreign_value_rs", "indian_value_rs", "total_value"]
RETRY_BELOW = {"article": 2.2, "foreign_value_rs": 2.5, "indian_value_rs": 2.5, "total_value": 2.5}


def count_of(text: Column, pattern: str) -> Column:
    """How often a pattern stands in a text. [AGG19]"""
    return F.regexp_count(text, F.lit(pattern))


def field_type(field: str) -> str | None:
    """text, numeric or neither. [SCR3]"""
    return "text" if field == "article" else "numeric" if is_number(field) else None


def _when(test: Column, amount: float | Column) -> Column:
    return F.when(test, amount).otherwise(F.lit(0.0))


def score(field: str, text: Column, confidence: Column | None = None) -> Column:
    """How well a reading suits its field; -10 for a blank one. [SCR1]"""
    return score_clean(field, clean_spaces(text), confidence)


def score_clean(field: str, t: Column, confidence: Column | None = None) -> Column:
    """``score`` of a text whose white space is clean."""
    # All weights and limits below.
    total = F.lit(0.0) if confidence is None else F.coalesce(confidence.cast("double"), F.lit(0.0))
    if is_number(field):
        n = replaced(t, (" ", ""))
        total = total + _when(n.rlike(r"\A[-0-9.,;:]+\z"), 1.5) - _when(n.rlike(r"\p{L}"), 1.5)
        grouped = _when(n.rlike(r"\A-?\d{1,3}(,\d{3})+[.;:]?\z"), 0.8) - _when(n.rlike(r"\A-?\d{1,3}(\.\d{3})+[.;:]?\z"), 0.4)
        grouped = grouped - _when(n.rlike(r"\A-?0[,.]\d{3}[.;:]?\z"), 1.2)
        total = total + _when(n.rlike(r"\p{Nd}"), F.least(count_of(n, r"\p{Nd}"), F.lit(8)) * F.lit(0.04) + grouped)
    elif field in RATE_FIELDS:
        total = total + _when(t.rlike(r"(?i)do\.?|cent|per|ann|as\.?|a\.|p\.|rs\.?"), 1.0) - _when(count_of(t, r"\p{L}") < 2, 0.6)
    elif field == "article":
        n_words, n_chars = count_of(t, "[A-Za-z]+"), F.length(t)
        total = total + F.least(count_of(t, r"\p{L}"), F.lit(20)) * F.lit(0.04) + _when(t.rlike("[A-Za-z]{3,}"), 0.8)
        total = total + F.least(count_of(t, r"(?U)\b[A-Z][a-z]{2,}\b"), F.lit(3)) * F.lit(0.25)
        total = total + F.when(t.rlike(r"\A[A-Z]"), 0.15).when(t.rlike(r"\A[a-z]"), -0.2).otherwise(0.0) - _when(t.rlike(r"\A[^A-Za-z]"), 0.35)
        total = total - F.least(count_of(t, r"[|~{}\[\]<>_=+]") * F.lit(0.2), F.lit(1.0)) - _when(t.rlike(r"[^\x00-\x7F]"), 0.15)
        total = total - _when(t.rlike(r"\A[|.,]"), 0.4)
        total = total - _when(n_words > 5, F.least((n_words - 5) * F.lit(0.35), F.lit(2.0))) - _when(n_chars > 40, F.least((n_chars - 40) * F.lit(0.04), F.lit(2.0)))
    else:
        total = total + _when(t.rlike(r"\A[A-Za-z0-9 .,';:()-]+\z"), 0.3)
    return F.when(is_clean_placeholder(t), -10.0).otherwise(total)


def score_of(field: Column, text: Column, confidence: Column | None = None) -> Column:
    """``score`` where the field is a column."""
    return score_of_clean(field, clean_spaces(text), confidence)


def score_of_clean(field: Column, t: Column, confidence: Column | None = None) -> Column:
    """``score_of`` of a text whose white space is clean. Bind it to a column first, as it is named often."""
    from ..schema import LEFT_FIELDS, RIGHT_FIELDS

    kinds: dict[str, list[str]] = {}
    for name in ["row_no", *LEFT_FIELDS, *RIGHT_FIELDS]:
        kind = "article" if name == "article" else "number" if is_number(name) else "rate" if name in RATE_FIELDS else "other"
        kinds.setdefault(kind, []).append(name)
    out = score_clean("remarks", t, confidence)
    for names in (kinds["article"], kinds["number"], kinds["rate"]):
        out = F.when(field.isin(names), score_clean(names[0], t, confidence)).otherwise(out)
    return out


def retry_below(field: Column) -> Column:
    """The score below which a field's reading is doubted. [PRD10]"""
    out = F.lit(0.9)
    for name, limit in RETRY_BELOW.items():
        out = F.when(field == name, limit).otherwise(out)
    return out


def needs_retry(field: Column, text: Column, points: Column) -> Column:
    """Whether a reading is blank or its score, ``points``, is too low. [PRD10]"""
    return (F.coalesce(text, F.lit("")) == "") | (points < retry_below(field))


def may_retry(field: Column) -> Column:
    """Whether a field is read again at all. [PRD9]"""
    return field.isin(RETRIED)


def prefers_token(field: Column, cell: Column, cell_score: Column, token: Column, token_confidence: Column, token_score: Column) -> Column:
    """Whether the page's tokens are trusted over a cell's own reading. [SCR2]"""
    n_token, n_cell = count_of(token, "[A-Za-z]+"), count_of(cell, "[A-Za-z]+")
    sure = F.coalesce(token_confidence, F.lit(0.0))
    article = (
        ((token_score >= 0.8) & (sure >= 0.3) & ((n_cell >= 6) | (F.length(cell) >= 40)))
        | ((token_score >= cell_score - 0.3) & (n_cell > n_token + 3))
        | (token_confidence.isNotNull() & (sure >= 0.8) & (token_score >= 1.8) & (cell_score < token_score + 0.6))
    )
    return F.when(F.coalesce(token, F.lit("")) == "", False).otherwise(((field == "article") & article) | (token_score >= cell_score))


def is_primary(field: Column) -> Column:
    return field.isin(PRIMARY_FIELDS)
