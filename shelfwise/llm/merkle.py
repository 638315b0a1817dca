"""Merkle fingerprints of documents: equal roots mean equal texts, branches that differ show where texts differ.

Paragraphs are the leaves: lines, where lines over ``LONG_LINE`` characters are cut after sentences. Sections are nodes over
runs of paragraphs; a section ends after a blank line or a paragraph whose hash falls on a mark (one in
``SECTION`` on average), so an edit moves no border beyond its own section. The root is over the sections and the length.

A fingerprint is a string: root, then per section ``|`` and per paragraph its hash and, in base 36, its length. Section hashes
follow from their paragraphs, so they are not written. The likeness of two fingerprints is the share of
characters in paragraphs that both have (counted with multiplicity), 1 for equal roots.

Defined cases: null text is empty; the likeness of two empty texts is 1, of an empty and another text 0; null ids come last in
descending order; rows of equal id are ordered by text, descending; a single row is its own successor; an empty table gives an
empty result; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import ordered_parts, shuffle_parts, text_of

LONG_LINE = 64
SECTION = 8
LEAF_HEX = 10
SENTENCE = re.compile(r".{32,320}?[.!?|]+\s+|.{1,320}", re.S)
BASE_36 = "0123456789abcdefghijklmnopqrstuvwxyz"


def paragraphs(text: str) -> list[str]:
    """Lines with their line break; long lines cut after sentences of 32 to 320 characters, or at 320. Joined they are the text."""
    out: list[str] = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        if len(line) <= LONG_LINE:
            out.append(line)
        else:
            out += SENTENCE.findall(line)
    return out


def digest(data: str) -> str:
    return hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=LEAF_HEX // 2).hexdigest()


def base_36(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = BASE_36[r] + out
    return out or "0"


@dataclass
class MerkleTree:
    """Sections, each a list of (paragraph hash, length), and the root over the exact text."""

    root: str
    sections: list[list[tuple[str, int]]]

    @classmethod
    def of(cls, text: str) -> MerkleTree:
        sections: list[list[tuple[str, int]]] = []
        open_section = False
        root = hashlib.sha256()
        for p in paragraphs(text):
            h = digest(p)
            if not open_section:
                sections.append([])
            sections[-1].append((h, len(p)))
            open_section = bool(p.strip()) and int(h[-4:], 16) % SECTION != 0
        for section in sections:
            root.update(hashlib.sha256("".join(f"{h}{n}," for h, n in section).encode()).digest())
        # Leaves are short hashes; the root also covers the text itself, so it tests equality at full strength.
        root.update(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
        return cls(root.hexdigest()[:32], sections)

    @classmethod
    def parse(cls, fingerprint: str) -> MerkleTree:
        root, _, rest = fingerprint.partition("|")
        sections = []
        for part in rest.split("|") if rest else []:
            leaves = part.split(",")
            sections.append([(leaf[:LEAF_HEX], int(leaf[LEAF_HEX:], 36)) for leaf in leaves])
        return cls(root, sections)

    def fingerprint(self) -> str:
        return "|".join([self.root, *(",".join(h + base_36(n) for h, n in section) for section in self.sections)])

    @cached_property
    def section_hashes(self) -> list[str]:
        return [digest("".join(h for h, _ in section)) for section in self.sections]

    @cached_property
    def leaves(self) -> Counter:
        return Counter(leaf for section in self.sections for leaf in section)

    @cached_property
    def size(self) -> int:
        return sum(n for section in self.sections for _, n in section)

    def likeness(self, other: MerkleTree) -> float:
        if self.root == other.root:
            return 1.0
        if not self.size or not other.size:
            return 0.0
        mine, theirs = self.leaves, other.leaves
        common = sum(min(n, theirs[leaf]) * leaf[1] for leaf, n in mine.items() if leaf in theirs)
        return 2 * common / (self.size + other.size)

    def edits(self, other: MerkleTree) -> list[tuple[int, int]]:
        """Character ranges of this text in paragraphs that the other text lacks: equal roots and sections are not descended into."""
        if self.root == other.root:
            return []
        theirs = Counter(other.section_hashes)
        out: list[tuple[int, int]] = []
        at = 0
        unmatched = []
        for h, section in zip(self.section_hashes, self.sections, strict=True):
            if theirs[h]:
                theirs[h] -= 1
            else:
                unmatched.append((at, section))
            at += sum(n for _, n in section)
        left: Counter = Counter()
        for h, section in zip(other.section_hashes, other.sections, strict=True):
            if theirs[h]:
                theirs[h] -= 1
                left.update(section)
        for at, section in unmatched:
            for leaf in section:
                if left[leaf]:
                    left[leaf] -= 1
                elif out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + leaf[1])
                else:
                    out.append((at, at + leaf[1]))
                at += leaf[1]
        return out


def with_first_of_next_part(docs: DataFrame, parts: int) -> DataFrame:
    """Rows in descending ranges of doc_id (``part``), and in each part as ``guest`` the first rows of the part after it.

    The part after the last is the first. The driver sees one id per part.
    """
    rows = ordered_parts(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), "doc_id", parts, descending=True)
    tops = sorted(rows.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        return rows.withColumn("guest", F.lit(False))
    before = [(tops[i - 1]["part"], t["part"], t["top"]) for i, t in enumerate(tops)]
    heads = docs.sparkSession.createDataFrame(before, "host int, of int, top long")
    guests = rows.join(F.broadcast(heads), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    guests = guests.select("doc_id", "text", F.col("host").alias("part"), F.lit(True).alias("guest"))
    return rows.select("doc_id", "text", "part", F.lit(False).alias("guest")).union(guests)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses (see ``queries.op10_merkle``)."""
    rows = with_first_of_next_part(docs, shuffle_parts(docs.sparkSession)).repartition("part")
    rows = rows.sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = ["int64", "int64", "string", "string", "string", "float64", "float64"]

    def compare(one: tuple, after: tuple) -> tuple:
        (doc_id, text, tree), (_, next_text, next_tree) = one, after
        third = len(text) // 3
        edited = text[: len(text) - third] + next_text[:third]
        edited_tree = MerkleTree.of(edited)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        return (
            doc_id, len(text), sha, tree.fingerprint(), edited_tree.fingerprint(), tree.likeness(edited_tree), tree.likeness(next_tree)
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        part, closed = None, False
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))
            for p, guest, doc_id, text in zip(*columns, strict=True):
                if p != part:
                    part, closed, last = p, False, None
                if closed:
                    continue
                this = (doc_id, text, MerkleTree.of(text))
                if last is not None:
                    out.append(compare(last, this))
                last, closed = this, guest
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = ", ".join(f"{n} {dict(int64='long', string='string', float64='double')[t]}" for n, t in zip(names, types, strict=True))
    return rows.mapInArrow(run, schema)
