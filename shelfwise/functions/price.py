"""Price expressions over free text."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import PRICE_PATTERNS
from .text import quoted_any
from .vector import bind

NUMBER = r"(\d+(?:[.,]\d+)?)"
# Every character class below also holds the Unicode blanks, such as the one in "30 €".
BLANKS = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
)
CATALOG_PRICE = r"([0-9]+(?:[.,][0-9]{1,2})?)"


@dataclass(frozen=True)
class PriceTerms:
    """Price wording of all languages together, by kind."""

    under: Sequence[str]
    between: Sequence[str]
    currency: Sequence[str]

    @classmethod
    def of(cls, languages: Mapping[str, Mapping[str, Sequence[str]]]) -> PriceTerms:
        def terms(kind: str) -> list[str]:
            return [t for rules in languages.values() for t in rules.get(kind, [])]

        return cls(terms("under"), terms("between"), terms("currency"))

    def between_regex(self) -> str | None:
        words = _any(self.between)
        return "".join(_between(words)) if words else None

    def under_regex(self) -> str | None:
        words = _any(self.under)
        return "".join(_under(words, _any(self.currency))) if words else None

    def currency_regex(self) -> str | None:
        unit = _any(self.currency)
        return "".join(_currency(unit)) if unit else None


@dataclass(frozen=True)
class TermColumns:
    """Price wording per row, as columns that hold lists of terms; a kind without terms is off."""

    under: Column
    between: Column
    currency: Column

    def between_regex(self) -> Column:
        return _concat(_between(quoted_any(self.between)))

    def under_regex(self) -> Column:
        return _concat(_under(quoted_any(self.under), F.coalesce(quoted_any(self.currency), F.lit(""))))

    def currency_regex(self) -> Column:
        return _concat(_currency(quoted_any(self.currency)))


Pattern = Column | str


def _between(words: Pattern) -> list[Pattern]:
    return [f"(?i){NUMBER}{BLANKS}(?:", words, f"){BLANKS}{NUMBER}"]


def _under(words: Pattern, unit: Pattern) -> list[Pattern]:
    return ["(?i)(?:", words, f"){BLANKS}(?:", unit, f")?{BLANKS}{NUMBER}"]


def _currency(unit: Pattern) -> list[Pattern]:
    return ["(?i)(?:", unit, f"){BLANKS}{NUMBER}|{NUMBER}{BLANKS}(?:", unit, ")"]


def _concat(pieces: Sequence[Pattern]) -> Column:
    """Null, a pattern that finds nothing, if a piece is null."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])


def _extract(text: Column, pattern: Pattern, group: int) -> Column:
    if isinstance(pattern, Column):
        return F.call_function("regexp_extract", text, pattern, F.lit(group))
    return F.regexp_extract(text, pattern, group)


def _any(terms: Sequence[str]) -> str:
    """Alternation of literal terms; no terms means the rule that uses it is off."""
    return "|".join(re.escape(t) for t in terms if t)


DEFAULT_TERMS = PriceTerms.of(PRICE_PATTERNS)
RANGE_TYPE = "struct<lo:double,hi:double>"


def _numbers(text: Column, pattern: Pattern, *groups: int) -> Column:
    """The amounts a pattern's groups caught, null where a group caught none.

    The text is searched once; the groups are then taken from the short match.
    """

    def number(match: Column, group: int) -> Column:
        digits = F.nullif(_extract(match, pattern, group), F.lit(""))
        return F.replace(digits, F.lit(","), F.lit(".")).cast("double")

    found = F.when(text.rlike("[0-9]"), _extract(text, pattern, 0))
    return bind(found, lambda m: F.array(*[number(m, g) for g in groups]))


def _range(amounts: Column, lo: Callable[[Column], Column]) -> Column:
    """``(lo, greatest)`` of the amounts found; null when none was found."""
    return bind(
        amounts,
        lambda a: F.when(
            F.array_max(a).isNotNull(), F.struct(lo(a).alias("lo"), F.array_max(a).alias("hi"))
        ),
    )


def _no_range() -> Column:
    return F.lit(None).cast(RANGE_TYPE)


def parse_between(text: Column, terms: PriceTerms | TermColumns = DEFAULT_TERMS) -> Column:
    """``N to M``, in rising order."""
    pattern = terms.between_regex()
    if pattern is None:
        return _no_range()
    return _range(_numbers(text, pattern, 1, 2), F.array_min)


def parse_under(text: Column, terms: PriceTerms | TermColumns = DEFAULT_TERMS) -> Column:
    """``under N`` as (0, N)."""
    pattern = terms.under_regex()
    if pattern is None:
        return _no_range()
    return _range(_numbers(text, pattern, 1), lambda a: F.lit(0.0))


def parse_currency(text: Column, terms: PriceTerms | TermColumns = DEFAULT_TERMS) -> Column:
    """A bare amount with its currency on either side, as (N, N)."""
    pattern = terms.currency_regex()
    if pattern is None:
        return _no_range()
    # One of the two groups catches the amount; the other stays null.
    return _range(_numbers(text, pattern, 1, 2), F.array_min)


def parse_price_range(text: Column, terms: PriceTerms | TermColumns = DEFAULT_TERMS) -> Column:
    """Price limits of a message: range first, then upper bound, then exact amount."""
    return F.coalesce(
        parse_between(text, terms), parse_under(text, terms), parse_currency(text, terms)
    )


def extract_price_number(text: Column) -> Column:
    """First amount in a price cell, at two decimals. A sign is not part of it."""
    digits = F.regexp_extract(F.replace(text.cast("string"), F.lit(" "), F.lit("")), CATALOG_PRICE, 1)
    amount = F.replace(F.nullif(digits, F.lit("")), F.lit(","), F.lit("."))
    return F.round(amount.cast("double"), 2)
