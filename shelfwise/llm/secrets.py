"""Secret scans: fixed patterns, and strings in a sensitive context that do not compress.

Patterns (leftmost, non-overlapping, per kind): an assignment to a password-like name, access keys, long hex strings.

Novelty: other strings of key-like characters that follow a sensitive word closely are measured. The text around a
candidate, without it, and a dictionary of identifiers prime a zstandard compressor; what the candidate adds to the compressed
size are its marginal bytes. Names, words and copies of text nearby add little; random strings add nearly their length.
A candidate with at least ``NOVEL_BYTES`` marginal bytes per character is reported as kind ``novel``. Candidates that overlap
a pattern's span are reported already.

Defined cases: null text is empty and has no spans; null ids are kept; equal texts get equal spans; an empty table gives an
empty result; extra columns are carried on. Positions count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from shelfwise.llm.common import with_columns_of_text

# The patterns and the least lengths of their matches. Letters of the names match in either ASCII case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
ACCESS_LEAST = 20
KINDS = ("assign", "access", "hex", "novel")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"secret|token|passw|api.?key|private|credential|auth|bearer|signature|access|license.?key", re.A | re.I)
CONTEXT_BEFORE = 48
SURROUNDING = 400
NOVEL_BYTES = 0.62
LEVEL = 3
# Words and names that are common around secrets and are none.
IDENTIFIERS = """
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 access_token refresh_token client_secret client_id api_key apiKey
private_key public_key password username authorization Authorization: Bearer authentication credentials credential
secret_access_key session_token signature certificate localhost example.com https://www. http:// -----BEGIN PRIVATE KEY-----
-----END PRIVATE KEY----- configuration environment development production placeholder changeme your_api_key_here
application/json application/x-www-form-urlencoded Content-Type x-api-key SECRET_KEY ACCESS_KEY_ID TOKEN PASSWORD
database connection_string parameters response request function return import export const string undefined null
"""

Span = tuple[int, int, int]


def pattern_spans(text: str) -> list[Span]:
    """(start, kind, end) of all pattern matches that are long enough, in order."""
    spans: list[Span] = []
    lower = text.lower()
    if any(name in lower for name in ASSIGN_NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    data = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def marginal_bytes(text: str, start: int, end: int) -> int:
    """What text[start:end] adds to the compressed size of the identifiers and the text around it."""
    around = text[max(0, start - SURROUNDING) : start] + text[end : end + SURROUNDING]
    size = lambda s: len(_compressor().compress(s.encode("utf-8", "replace")))
    return size(around + text[start:end]) - size(around)


def looks_random(s: str) -> bool:
    """Digits and letters together, which words and headings do not have."""
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def novel_spans(text: str, known: list[Span]) -> list[Span]:
    """Candidates in a sensitive context that do not compress and overlap none of ``known``."""
    if not SENSITIVE.search(text):
        return []
    spans = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if (
            looks_random(m[0])
            and SENSITIVE.search(text, max(0, start - CONTEXT_BEFORE), start)
            and not any(s < end and start < e for s, _, e in known)
            and marginal_bytes(text, start, end) >= NOVEL_BYTES * (end - start)
        ):
            spans.append((start, 3, end))
    return spans


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Pattern spans, and those that novelty adds."""
    base = pattern_spans(text)
    return base, novel_spans(text, base)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan_secrets(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_novel, base_sha256 (of the joined pattern spans) and spans (all, joined)."""

    def run(texts: list[str | None]) -> list[list]:
        out: list[list] = [[] for _ in range(6)]
        for text in texts:
            base, novel = find_spans(text or "")
            kinds = [kind for _, kind, _ in base]
            row = (*(kinds.count(k) for k in range(3)), len(novel), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + novel))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out

    added = "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return with_columns_of_text(docs, added, run, keep_text)


def masked(text: str) -> str:
    """The text with each stretch covered by spans replaced by the kind of the first of them in angle brackets."""
    base, novel = find_spans(text)
    out, at, reach = [], 0, 0
    for start, kind, end in sorted(base + novel):
        if start >= reach:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        reach = at = max(reach, end)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text``; null stays null."""
    rows = with_columns_of_text(docs, "text string", lambda texts: [[t if t is None else masked(t) for t in texts]])
    return rows.select(docs.columns)
