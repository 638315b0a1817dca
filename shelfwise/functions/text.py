"""Text expressions: transliteration, truncation, templates, JSON."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import SINGLE_LETTERS, TRANSLITERATIONS


def _letter_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by canonical decomposition."""
    pairs = dict(SINGLE_LETTERS)
    for first, last in ((0x00AA, 0x024F), (0x1E00, 0x1EFF)):
        for code in range(first, last + 1):
            ch = chr(code)
            base = "".join(
                c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)
            )
            if ch not in TRANSLITERATIONS and len(base) == 1 and base.isascii() and base.strip():
                pairs.setdefault(ch, base)
    # translate() deletes the source letters that have no partner: combining marks go last.
    marks = "".join(map(chr, range(0x0300, 0x0370)))
    return "".join(pairs) + marks, "".join(pairs.values())


ACCENTED, PLAIN = _letter_table()
NON_ASCII = r"[^\x00-\x7F]"
WIDE = "[" + "".join(TRANSLITERATIONS) + "]"


def unaccent(text: Column) -> Column:
    """ASCII transliteration of Latin text; pure-ASCII values skip the work."""
    wide = text
    for source, target in TRANSLITERATIONS.items():
        wide = F.replace(wide, F.lit(source), F.lit(target))
    widened = F.when(text.rlike(WIDE), wide).otherwise(text)
    return F.when(text.rlike(NON_ASCII), F.translate(widened, ACCENTED, PLAIN)).otherwise(text)


def strip(text: Column) -> Column:
    """Remove ASCII whitespace, not only blanks, from both ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"))


def normalize(text: Column) -> Column:
    """Transliterated and stripped; missing becomes empty. Case is kept."""
    return strip(unaccent(F.coalesce(text.cast("string"), F.lit(""))))


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def shorten(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, with an ellipsis only when something was cut."""
    cut = F.concat(F.substring(text, 1, limit), F.lit("…"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def quoted_any(terms: Column) -> Column:
    """Alternation of the literal terms of a list column; null if it has none."""
    quote = lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return non_empty(F.array_join(F.transform(F.filter(terms, lambda t: t != ""), quote), "|"))


PLACEHOLDER = r"\{[A-Za-z_]\w*\}"


def render_each(template: Column, values: Mapping[str, Column], required: Sequence[str] = ()) -> Column:
    """``render`` with a template per row.

    A template that lacks a required placeholder, or names one without a value, gives null.
    """
    pieces = F.regexp_extract_all(template, F.lit(rf"(\{{\{{|\}}\}}|{PLACEHOLDER}|[^{{}}]+|[{{}}])"), F.lit(1))

    def fill(piece: Column) -> Column:
        filled = F.when(piece.isin("{{", "}}"), F.left(piece, F.lit(1)))
        for name, value in values.items():
            filled = filled.when(piece == "{" + name + "}", value)
        return filled.when(~piece.rlike(f"^{PLACEHOLDER}$"), piece)

    usable = F.lit(True)
    for name in required:
        usable = usable & F.contains(template, F.lit("{" + name + "}"))
    parts = F.transform(pieces, fill)
    return F.when(usable & ~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))


def render(template: Column | str, values: Mapping[str, Column], required: Sequence[str] = ()) -> Column:
    """Fill ``{NAME}`` placeholders in one pass.

    The template is split on the driver, so braces inside a value are never expanded again.
    Doubled braces stand for one literal brace. A column holds a template per row (``render_each``).
    """
    if isinstance(template, Column):
        return render_each(template, values, required)
    missing = [name for name in required if "{" + name + "}" not in template]
    if missing:
        raise ValueError(f"template lacks placeholders: {missing}")
    parts: list[Column] = []
    for piece in re.split(r"(\{\{|\}\}|\{[A-Za-z_]\w*\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece.startswith("{"):
            name = piece[1:-1]
            if name not in values:
                raise ValueError(f"no value for placeholder {name}")
            parts.append(values[name])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def few_shot_text(pairs: Column) -> Column:
    """``array<struct<user, assistant>>`` as dialogue blocks; empty array gives ''."""
    blocks = F.transform(
        pairs,
        lambda p: F.concat(
            F.lit("User: "), p["user"], F.lit("\nAssistant: "), strip(p["assistant"]), F.lit("\n")
        ),
    )
    text = F.concat(F.array_join(blocks, "\n"), F.lit("\n"))
    return F.when(F.size(pairs) > 0, text).otherwise(F.lit(""))


def json_text(value: Column) -> Column:
    """Compact JSON that keeps non-ASCII characters and null fields."""
    return F.to_json(value, {"ignoreNullFields": "false"})
