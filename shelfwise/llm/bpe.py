"""Byte-level BPE by a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of the tree are the pairs of adjacent symbols, each with (rank, position); an inner node holds the smaller of its
children, so the root is the leftmost pair of lowest rank. A merge replaces its two symbols by one and updates at
most three leaves, each along one path to the root. It ends when the root holds no mergeable pair. A word of n bytes
costs O(n log n) however it is built, so a text without any border is no special case.

Defined cases: null text is empty and has no ids; null document ids are kept; equal rows give equal rows; an empty table
gives an empty result; extra columns are not carried. Strings of special tokens are cut out first and get their own id.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import text_of
from shelfwise.llm.pieces import PieceEncoder

# Fixed value: how the byte-level vocabulary cuts words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = 1 << 62
AT_BITS = 32
AT_MASK = (1 << AT_BITS) - 1
ROW_BYTES = 32


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b if b in set(shown) else next(spare)) for b in range(256)]


def merge_pairs(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge until no adjacent pair is in ``pairs``, which maps (left, right) to (rank, merged id)."""
    n = len(ids)
    if n < 2:
        return ids
    ids = list(ids)
    width = 1 << (n - 2).bit_length()
    tree = [NO_PAIR] * (2 * width)
    get = pairs.get
    for i in range(n - 1):
        found = get((ids[i], ids[i + 1]))
        if found:
            tree[width + i] = found[0] << AT_BITS | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while tree[1] != NO_PAIR:
        at = tree[1] & AT_MASK
        gone = after[at]
        ids[at] = get((ids[at], ids[gone]))[1]
        ids[gone] = -1
        following = after[at] = after[gone]
        changed = [(gone, NO_PAIR), (at, NO_PAIR)]
        if following < n:
            before[following] = at
            found = get((ids[at], ids[following]))
            if found:
                changed[1] = (at, found[0] << AT_BITS | at)
        previous = before[at]
        if previous >= 0:
            found = get((ids[previous], ids[at]))
            changed.append((previous, found[0] << AT_BITS | previous if found else NO_PAIR))
        for leaf, value in changed:
            k = width + leaf
            if leaf == n - 1 or tree[k] == value:
                continue
            tree[k] = value
            while k > 1:
                a, b = tree[k], tree[k ^ 1]
                k >>= 1
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
    return [i for i in ids if i >= 0]


class PairTable:
    """Ranks of pairs of ids, looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([left << 32 | right for left, right in pairs], dtype="int64")
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(1 << 62))
        ranks = np.array([rank for rank, _ in pairs.values()], dtype="int64")
        self.ranks = np.append(ranks[order], 0)
        self.merged = np.zeros(len(pairs) and int(ranks.max()) + 1, dtype="int64")
        self.merged[ranks] = [merged for _, merged in pairs.values()]

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(rank, position) of the pairs as tree values; a negative id is in no pair."""
        key = left << 32 | right
        found = np.searchsorted(self.keys, key)
        hit = (self.keys[found] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[found] << AT_BITS | at, NO_PAIR)


def merge_rows(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """``merge_pairs`` for many short words at once: a word is a row of ``ids``, filled up with -1.

    All trees have the same shape and take their next merge together; words that are done drop out. The number of
    columns is a power of two. Returns ``ids`` with -1 where a symbol was merged into the one before.
    """
    n, width = ids.shape
    ids = np.concatenate([ids.astype("int64"), np.full((n, 1), -1)], axis=1)
    at = np.arange(width)
    after = np.tile(np.arange(1, width + 2), (n, 1))
    before = np.tile(np.arange(-1, width), (n, 1))
    tree = np.full((n, 2 * width), NO_PAIR, dtype="int64")
    tree[:, width:] = table.leaves(ids[:, :-1], ids[:, 1:], at)
    for k in range(width - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
    row = np.flatnonzero(tree[:, 1] != NO_PAIR)
    while len(row):
        root = tree[row, 1]
        at = root & AT_MASK
        gone = after[row, at]
        following = after[row, gone]
        merged = table.merged[root >> AT_BITS]
        ids[row, at] = merged
        ids[row, gone] = -1
        after[row, at] = following
        before[row, following] = at
        previous = before[row, at]
        first = np.maximum(previous, 0)
        tree[row, width + gone] = NO_PAIR
        tree[row, width + at] = table.leaves(merged, ids[row, following], at)
        value = table.leaves(ids[row, first], merged, first)
        tree[row, width + first] = np.where(previous >= 0, value, tree[row, width + first])
        paths = [(width + leaf) >> 1 for leaf in (gone, at, first)]
        while paths[0][0]:
            for k in paths:
                tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])
            paths = [k >> 1 for k in paths]
        row = row[tree[row, 1] != NO_PAIR]
    return ids[:, :-1]


class ByteBpe:
    """Vocabulary, merges and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = [vocab[c] for c in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.table = PairTable(self.pairs)
        self.lookup = np.array(self.byte_ids, dtype="int64")
        back = {c: b for b, c in enumerate(letters)}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(WORDS).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest_first)) or r"(?!)")
        self.memo = PieceEncoder("byte", self._encode, list(self.special))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.memo(text)

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        return self.memo.many(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        ids_of = self._merge(list(dict.fromkeys(w for words in cut for w in words if isinstance(w, str))))
        return [b"".join(ids_of[w] if isinstance(w, str) else w for w in words) for words in cut]

    def _cut(self, text: str) -> list[str | bytes]:
        """Words, and ids of special tokens between them."""
        out: list[str | bytes] = []
        at = 0
        for m in self.cut.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        return out + self.words(text[at:])

    def _merge(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word; words of up to ``ROW_BYTES`` are merged in rows of one array per width."""
        out: dict[str, bytes] = {}
        rows: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            if len(data) <= ROW_BYTES:
                rows.setdefault(max(8, 1 << (len(data) - 1).bit_length()), []).append((word, data))
            else:
                out[word] = np.asarray(merge_pairs([self.byte_ids[b] for b in data], self.pairs), dtype="<u4").tobytes()
        for width, some in rows.items():
            length = np.array([len(data) for _, data in some])
            ids = np.full((len(some), width), -1, dtype="int64")
            ids[np.arange(width) < length[:, None]] = self.lookup[np.frombuffer(b"".join(data for _, data in some), "uint8")]
            ids = merge_rows(ids, self.table)
            kept = ids >= 0
            data = ids[kept].astype("<u4").tobytes()
            ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
            for (word, _), a, b in zip(some, [0, *ends], ends, strict=False):
                out[word] = data[a:b]
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text; bytes that are none become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


_LOADED: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``ids`` (binary, little-endian unsigned 32-bit) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            ids = list(bpe.encode_many(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, "binary")], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``text`` of every row of ``encoded`` (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            texts = [bpe.decode(i or b"").decode() for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts)], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode, then decode from the ids: doc_id, n_tokens, ids_sha256, decoded_sha256. Both in one pass over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            ids = list(bpe.encode_many(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array([len(i) // 4 for i in ids], "int64"),
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids],
                }
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)
