"""Language of a text by cross-parsing: which language's sample explains it in the fewest phrases.

Of every language a bounded sample of labelled text is turned into a suffix automaton, which accepts exactly the
substrings of the sample: ``ALL_SYMBOLS`` divided by the number of languages, ``SAMPLE_SYMBOLS`` at most, an even share of every sampled text. A text is cut greedily into the longest phrases that occur in the sample; the number of
phrases times the bits to name a place in the sample, per symbol, estimates the cross entropy. The smallest wins; ties go to the
language that sorts first.

Automata are laid out as dense tables whose entries also say how many phrases end there, so many stretches of
text take their next symbol together in a few array operations. Texts are cut into stretches of ``STRETCH`` symbols,
each parsed from the start state; all of a text is parsed.

Symbols: lower-case letters, one symbol for any run of other characters. Letters outside the most frequent ones share
hashed symbols, so any alphabet can be learned.

Defined cases: null text, or text without a letter, is ``und`` with score 0; null ids are kept and not learned from; rows
with null lang are predicted and not learned from; if nothing can be learned, every text is ``und``; equal texts get equal
results; an empty table gives an empty result; extra columns are carried on.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import hashed_sample, learnable, with_columns_of_text

SAMPLE_DOCS = 256
SAMPLE_CHARS = 400
# Symbols of all samples together; shared evenly by the languages, at most SAMPLE_SYMBOLS each.
ALL_SYMBOLS = 160_000
SAMPLE_SYMBOLS = 40_000
# Symbols that a sampled text gives at least; with so many texts that they do not all fit, the lowest hashes are taken.
LEAST_SHARE = 64
LETTERS = 96
HASHED = 8
STRETCH = 256
BITS_PER_DOUBT = 8.0
UNKNOWN = "und"
LEAST_PHRASE = 1.5
BORDER, OTHER = 0, 1


class Alphabet:
    """Characters to symbols: BORDER between sample texts, OTHER for what is no letter, then letters."""

    def __init__(self, texts: list[str]):
        count = Counter(c for t in texts for c in t.lower() if c.isalpha())
        common = sorted(sorted(count), key=lambda c: -count[c])[:LETTERS]
        self.size = 2 + len(common) + HASHED
        every = np.arange(0x110000)
        self.symbol = (2 + len(common) + every % HASHED).astype("uint8")
        self.symbol[[i for i in range(0x110000) if not chr(i).isalpha()]] = OTHER
        self.symbol[[ord(c) for c in common]] = 2 + np.arange(len(common))

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text, runs of OTHER as one."""
        s = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = (s[1:] != OTHER) | (s[:-1] != OTHER)
        return s[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts the substrings of ``symbols``; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def even_share(sizes: list[int], most: int) -> int:
    """The largest share such that texts of these sizes, cut to it, have ``most`` symbols together at most."""
    left = most
    for i, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - i) > left:
            return left // (len(sizes) - i)
        left -= size
    return max(sizes, default=0)


def sample_symbols(texts: list[str], letters: Alphabet, most: int) -> list[int]:
    """At most ``most`` symbols of ``texts``: an even share of every text, from a place that its hash names, in the order of the hashes."""
    coded = sorted((zlib.crc32(t.encode("utf-8", "replace")), t) for t in texts)
    coded = [(h, letters.symbols(t)) for h, t in coded]
    share = max(even_share([len(c) + 1 for _, c in coded], most), LEAST_SHARE) - 1
    symbols: list[int] = []
    for h, c in coded:
        begin = h % (max(len(c) - share, 0) + 1)
        symbols += [BORDER, *c[begin : begin + share].tolist()]
    return symbols[:most]


class LanguageModel:
    """Automata of all languages, small enough to be sent to every task."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in samples})
        self.letters = Alphabet([text for _, text in samples])
        most = min(SAMPLE_SYMBOLS, ALL_SYMBOLS // max(1, len(self.langs)))
        self.edges, self.bits = [], []
        for lang in self.langs:
            symbols = sample_symbols([text for own, text in samples if own == lang], self.letters, most)
            step = suffix_automaton(symbols)
            found = [(s, c, t) for s, row in enumerate(step) for c, t in row.items()]
            self.edges.append((len(step), np.array(found, dtype="int32").reshape(-1, 3)))
            self.bits.append(math.log2(max(2, len(symbols))))
        self.step = None

    def tables(self) -> None:
        """Dense transitions of all languages in one array; an entry is 4 * (first cell of the next state) + phrases that end."""
        width = self.letters.size
        self.step = np.empty(sum(states for states, _ in self.edges) * width, dtype="int32")
        self.roots = []
        first = 0
        for states, edges in self.edges:
            source, symbol, target = edges.T
            cells = self.step[first : first + states * width].reshape(states, width)
            begins = np.full(width, -1, dtype="int32")
            at_root = source == 0
            begins[symbol[at_root]] = first + target[at_root] * width
            known = begins >= 0
            # Without a step the phrase ends: the symbol begins the next one, or is a phrase of its own if no phrase has it.
            cells[:] = 4 * np.where(known, begins, first) + np.where(known, 1, 2)
            cells[0] = 4 * np.where(known, begins, first) + 1
            cells[source, symbol] = 4 * (first + target * width)
            self.roots.append(first)
            first += states * width

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by language (rows: languages), and its number of symbols."""
        if self.step is None:
            self.tables()
        coded = [self.letters.symbols(t) for t in texts]
        sizes = np.array([len(c) for c in coded], dtype="int64")
        stretches = -(-sizes // STRETCH)
        text_of = np.repeat(np.arange(len(texts)), stretches)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        length = np.minimum(STRETCH, sizes[text_of] - nth * STRETCH)
        begin = (np.cumsum(sizes) - sizes)[text_of] + nth * STRETCH
        order = np.argsort(-length, kind="stable")
        text_of, length, begin = text_of[order], length[order], begin[order]
        symbols = np.concatenate(coded) if coded else np.zeros(0, "uint8")
        ended = np.zeros((len(self.langs), len(length)), dtype="int32")
        at = np.repeat(np.array(self.roots, dtype="int32")[:, None], len(length), axis=1)
        live = np.searchsorted(-length, -np.arange(STRETCH), side="left")
        for i in range(int(length[0]) if len(length) else 0):
            n = int(live[i])
            found = self.step[at[:, :n] + symbols[begin[:n] + i]]
            ended[:, :n] += found & 3
            at[:, :n] = found >> 2
        total = np.zeros((len(self.langs), len(texts)), dtype="int64")
        for k in range(len(self.langs)):
            # Each stretch ends inside a phrase, which counts too.
            total[k] = np.bincount(text_of, weights=ended[k] + 1, minlength=len(texts))
        return total, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score, and symbols per phrase in that language."""
        known = [t is not None and any(map(str.isalpha, t)) for t in texts]
        langs, scores, spans = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        rows = [i for i, k in enumerate(known) if k]
        if not rows or not self.langs:
            return langs, scores, spans
        phrases, sizes = self.phrases([texts[i] for i in rows])
        bits = phrases * np.array(self.bits)[:, None]
        best = bits.argmin(axis=0)
        doubt = np.exp2((bits.min(axis=0) - bits) / BITS_PER_DOUBT).sum(axis=0)
        for k, i in enumerate(rows):
            langs[i], scores[i] = self.langs[best[k]], float(1 / doubt[k])
            spans[i] = float(sizes[k] / phrases[best[k], k])
        return langs, scores, spans

    def recognises(self, texts: list[str | None]) -> list[bool]:
        """Text in a learned language: that of another one falls apart into phrases of hardly more than a symbol."""
        langs, _, spans = self.predict(texts)
        return [lang != UNKNOWN and span >= LEAST_PHRASE for lang, span in zip(langs, spans, strict=True)]


def learn(docs: DataFrame) -> LanguageModel:
    """Fit on a bounded sample of ``docs`` (doc_id, text, lang) that may be learned from: at most ``SAMPLE_DOCS`` texts a language."""
    rows = docs.where(learnable()).where(F.col("text").rlike(r"\p{L}"))
    return LanguageModel(hashed_sample(rows.select("lang", "text"), "lang", SAMPLE_DOCS, SAMPLE_CHARS))


def predict_language(docs: DataFrame, model: LanguageModel, keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and phrase_symbols (symbols per phrase). A prediction sees the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = "lang_pred string, score double, phrase_symbols double"
    return with_columns_of_text(docs, added, lambda texts: sent.value.predict(texts), keep_text)
