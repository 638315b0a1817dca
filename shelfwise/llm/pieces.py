"""Token ids of texts, piece by piece, with a bounded memo of distinct pieces.

A piece is a stretch of text whose borders are also borders of the tokenizer's own pre-tokens, whatever stands
around it, so ids of a text are the ids of its pieces in order:

* a run of white space is cut as the byte-level pattern cuts it: all but the last character, and the last one
  goes to the next word if it is a space;
* inside a run of other characters, a run of Latin letters ends a piece where an ASCII character that is no letter
  follows. No pre-token crosses that place, and neither normalisation nor case folding joins across it.

The word pattern is cut by arrays, see ``WordEncoder``.

A text that holds the string of a special token is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from string import ascii_letters, ascii_lowercase

import numpy as np
import pyarrow as pa

# White space as the tokenizers' patterns know it; Python's own class has four control characters more.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e"
BYTE_LEVEL = re.compile(rf" ?[{LETTERS}]++(?![^\x00-\x7f])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PATTERNS = {"byte": BYTE_LEVEL}
# Letters that are one pre-token of the word pattern in any number; lower case of U+0130 is a letter and a mark.
PLAIN_WORD = re.compile(rf"(?:(?!\u0130)[{LETTERS}])+")

# Classes of bytes for the word pattern, and between which two of them a piece ends.
BLANK, LETTER, DIGIT, QUOTE, SIGN, WIDE, LATIN_END = range(7)


def byte_classes() -> bytes:
    of = bytearray([SIGN] * 128 + [WIDE] * 128)
    for kind, members in ((BLANK, b"\t\n\x0b\x0c\r "), (LETTER, ascii_letters.encode()), (DIGIT, b"0123456789"), (QUOTE, b"'")):
        for b in members:
            of[b] = kind
    return bytes(of)


def piece_ends() -> bytes:
    """Between ASCII characters: around digits, after letters, and before letters unless a quote stands there (``'s``)."""
    ends = np.zeros((32, 8), dtype="uint8")
    ends[BLANK, :] = ends[:, BLANK] = 1
    for left in (LETTER, LATIN_END):
        ends[left, [DIGIT, QUOTE, SIGN]] = 1
    ends[DIGIT, [LETTER, DIGIT, QUOTE, SIGN]] = 1
    ends[QUOTE, DIGIT] = 1
    ends[SIGN, [LETTER, DIGIT]] = 1
    return ends.tobytes()


# Tables for ``bytes.translate``: of bytes, and of 8 * class + class of the next byte.
BYTE_CLASS, PIECE_ENDS = byte_classes(), piece_ends()

# Pieces that a worker remembers at most, some 250 bytes each: two generations, of which the older one is forgotten whole.
MEMO_ENTRIES = 1_000_000
MEMO_CHARS = 48
CHARS_AT_ONCE = 500_000
# With arrays, a distinct piece costs something per call and a repeated one hardly anything; few pieces of a text are new.
WORD_CHARS_AT_ONCE = 4_000_000
WORD_CHARS_PER_ENTRY = 4


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    chars_at_once = CHARS_AT_ONCE
    chars_per_entry = 1

    def __init__(self, kind: str, encode: Callable[[list[str]], list[bytes]], special: list[str], entries: int = MEMO_ENTRIES):
        self.find = PATTERNS[kind].findall if kind in PATTERNS else None
        self.encode_pieces = encode
        self.special = special
        self.entries = entries
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        return next(self.many([text]))

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text; new pieces of about ``chars_at_once`` characters of text are encoded together, of fewer if the memo is small."""
        at_once = min(self.chars_at_once, self.chars_per_entry * self.entries)
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= at_once:
                yield from self._encode(some)
                some, size = [], 0
        yield from self._encode(some)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.memo) > self.entries // 2:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        cut = [[t] if any(s in t for s in self.special) else self.find(t) for t in texts]
        distinct: set[str] = set().union(*cut)
        new = [p for p in distinct if p not in memo]
        del distinct
        # What is used again moves to the younger generation.
        memo.update((p, older[p]) for p in new if p in older)
        new = [p for p in new if p not in older]
        memo.update(zip(new, self.encode_pieces(new), strict=True))
        for pieces in cut:
            yield b"".join(map(memo.__getitem__, pieces))
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]


class WordEncoder(PieceEncoder):
    """The same for the word pattern, which ignores case and white space; texts are cut, and ids put together, by arrays.

    A piece ends at ASCII white space and where ``PIECE_ENDS`` says so: no pre-token crosses these places, and as one side
    is ASCII, no normalisation joins across them. A Latin letter of two bytes ends a piece like an ASCII letter does.
    ASCII letters are put in lower case unless a mark could follow, which would have to be joined first.
    """

    chars_at_once = WORD_CHARS_AT_ONCE
    chars_per_entry = WORD_CHARS_PER_ENTRY

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], whole: Callable[[str], bytes], special: list[str], entries: int):
        super().__init__("word", encode, special, entries)
        self.whole = whole

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        special = {i: self.whole(t) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        data = [b"" if i in special else t.encode() for i, t in enumerate(texts)]
        firsts = np.cumsum([0, *(len(d) + 1 for d in data)])
        starts, pieces = self._cut(b" ".join([*data, b""]))
        del data
        coded = pieces.dictionary_encode()
        of = coded.indices.to_numpy()
        found = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), "int64", len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        begins = np.cumsum(sizes) - sizes
        counts = sizes[of]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(begins[of] - ends[:-1], counts)
        at += np.arange(len(at))
        ids = pool[at].tobytes()
        bounds = (4 * ends[np.searchsorted(starts, firsts)]).tolist()
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            yield special[i] if i in special else ids[a:b]

    def _cut(self, text: bytes) -> tuple[np.ndarray, pa.Array]:
        """Where the pieces of UTF-8 text begin, and the pieces."""
        if not text:
            return np.zeros(0, "int64"), pa.array([], "large_binary")
        data = np.frombuffer(text, "uint8")
        kind = np.frombuffer(bytearray(text).translate(BYTE_CLASS), "uint8")
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
        code = (data[lead].astype("int32") & 0x1F) << 6 | data[lead + 1] & 0x3F
        kind[lead[(code <= 0x17E) & (code != 0xD7) & (code != 0xF7) & (code != 0x130)] + 1] = LATIN_END
        shown = kind != BLANK
        edge = np.frombuffer((kind[:-1] << 3 | kind[1:]).tobytes().translate(PIECE_ENDS), "bool")
        starts = np.flatnonzero(np.concatenate([[True], edge]) & shown)
        ends = np.flatnonzero(np.concatenate([edge, [True]]) & shown)
        capital = (data >= ord("A")) & (data <= ord("Z"))
        capital[:-1] &= data[1:] < 0x80
        low = (data | capital.astype("uint8") << 5)[shown]
        offsets = np.concatenate([[0], np.cumsum(ends + 1 - starts)])
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(low)]
        return starts, pa.Array.from_buffers(pa.large_binary(), len(starts), buffers)

    def _ids(self, distinct: list[bytes]) -> list[bytes]:
        if len(self.memo) > self.entries // 2:
            self.memo, self.older = {}, self.memo
        found = list(map(self.memo.get, distinct))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            found[i] = self.older.get(distinct[i])
            if found[i] is None:
                new.append(i)
        for i, ids in zip(new, self.encode_pieces([distinct[i] for i in new]), strict=True):
            found[i] = ids
        # What is used again moves to the younger generation.
        self.memo.update((distinct[i], found[i]) for i in missing if len(distinct[i]) <= MEMO_CHARS)
        return found


_LOADED: dict[tuple[str, str, int], PieceEncoder] = {}


def library_encoder(path: str, kind: str, entries: int = MEMO_ENTRIES) -> PieceEncoder:
    """Encoder over the tokenizers library; kept for the life of the worker."""
    if (path, kind, entries) not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec["added_tokens"]
        special = [t["content"] for t in added]
        # A special token cuts the text before anything else looks at it, so it can stand between pieces.
        between = next((t for t in added if not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])), None)

        def whole(text: str, by: Tokenizer = tokenizer) -> np.ndarray:
            return np.asarray(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

        def encode(texts: list[str]) -> list[bytes]:
            plain = [t for t in texts if not any(s in t for s in special)]
            if between is None or len(plain) < len(texts):
                return [whole(t).tobytes() for t in texts]
            if not texts:
                return []
            ids = whole(between["content"].join(texts))
            cuts = (4 * np.flatnonzero(ids == between["id"])).tolist()
            data = ids.tobytes()
            return [data[i:j] for i, j in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]

        # Ids that end a pre-token, if the vocabulary marks them.
        suffix = spec["model"].get("end_of_word_suffix")
        last = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        last[[i for t, i in spec["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True

        def by_word(tokenizer: Tokenizer, words: list[str]) -> list[bytes]:
            """Words of letters are told apart by their last ids, which costs the library less than a special token between them."""
            ids = whole(" ".join(words), tokenizer)
            cuts = (4 * (np.flatnonzero(last[ids]) + 1)).tolist()
            if len(cuts) != len(words):
                return encode(words)
            data = ids.tobytes()
            return [data[i:j] for i, j in zip([0, *cuts], cuts)]

        # Lower-case ASCII words are as the normaliser and the pre-tokeniser leave them, so the library's model alone gives their ids.
        bare = Tokenizer(tokenizer.model)
        bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probe = [a + b for a in ascii_lowercase for b in ascii_lowercase]
        if kind == "word" and by_word(bare, probe) != encode(probe):
            bare = tokenizer

        def encode_words(pieces: list[bytes]) -> list[bytes]:
            plain = [p.isalpha() and p.islower() for p in pieces]
            lower = iter(by_word(bare, [p.decode() for p, is_plain in zip(pieces, plain) if is_plain]))
            texts = [p.decode() for p, is_plain in zip(pieces, plain) if not is_plain]
            words = [t for t in texts if PLAIN_WORD.fullmatch(t)]
            known = dict(zip(words, by_word(tokenizer, words), strict=True))
            others = [t for t in texts if t not in known]
            known.update(zip(others, encode(others), strict=True))
            rest = map(known.__getitem__, texts)
            return [next(lower if is_plain else rest) for is_plain in plain]

        if kind == "word":
            _LOADED[path, kind, entries] = WordEncoder(encode_words, lambda t: whole(t).tobytes(), special, entries)
        else:
            _LOADED[path, kind, entries] = PieceEncoder(kind, encode, special, entries)
    return _LOADED[path, kind, entries]


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
