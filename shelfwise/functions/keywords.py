"""Keyword expressions: category hints, skin type, medical flag."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import CATEGORY_PATTERNS, MEDICAL_TERMS, SKIN_TYPES
from .text import quoted_any, unaccent
from .vector import bind


def folded(text: Column) -> Column:
    """Unaccented lower case, the form both sides of a keyword test are in."""
    return F.lower(unaccent(text))


def _hit(text: Column, keywords: Sequence[str]) -> Column:
    """True if any keyword occurs anywhere, also inside a longer word."""
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(text, folded(F.lit(word)))
    return hit


def _named_hits(low: Column, patterns: Mapping[str, Sequence[str]]) -> list[Column]:
    return [F.when(_hit(low, words), F.lit(name)) for name, words in patterns.items()]


def category_hints(
    message: Column, patterns: Mapping[str, Sequence[str]] = CATEGORY_PATTERNS
) -> Column:
    """All names with a keyword in the message, in pattern order."""
    if not patterns:
        return F.array().cast("array<string>")
    return bind(
        folded(message),
        lambda low: F.array_compact(F.array(*_named_hits(low, patterns))),
    )


def skin_type(message: Column, patterns: Mapping[str, Sequence[str]] = SKIN_TYPES) -> Column:
    """The first name in pattern order with a keyword in the message, else null."""
    if not patterns:
        return F.lit(None).cast("string")
    return bind(folded(message), lambda low: F.coalesce(*_named_hits(low, patterns)))


def mentions_medical(message: Column, terms: Column | Sequence[str] = MEDICAL_TERMS) -> Column:
    """Whole-word, case-insensitive mention of any term; no terms means no mention. A column holds a list of terms per row."""
    if isinstance(terms, Column):
        words = quoted_any(terms)
        hit = F.rlike(message, F.concat(F.lit(r"(?i)\b("), words, F.lit(r")\b")))
        return F.when(words.isNull(), F.lit(False)).otherwise(hit)
    words = "|".join(re.escape(t) for t in terms if t)
    return message.rlike(rf"(?i)\b({words})\b") if words else F.lit(False)
