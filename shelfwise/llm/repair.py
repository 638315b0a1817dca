"""Repair of conversations: the cheapest edits after which roles follow the grammar, by interval parsing.

Roles of a repaired conversation, by their initials, are ``(s?(ua)+)?``. Every row is kept, given another role or deleted, and empty turns may be
inserted anywhere. A nonterminal ``[p, q]`` derives what takes the grammar from state p to state q: nothing said yet, after the
system's turn, after a user's, after an assistant's. Rules are in Chomsky normal form: ``[p, q] -> [p, r] [r, q]``, and ``[p, q] -> row`` for the edits of a
row, closed under insertion before and after it. A cell holds the least (cost, audit) of every nonterminal over a span; spans are
combined bottom-up by their length, over all splits.

Cells of adjacent spans combine exactly: of two audits of a span with equal cost none begins the other (they would differ by insertions,
which cost), so the lesser stays the lesser whatever follows. A conversation is therefore parsed in blocks of ``BLOCK`` rows, then blocks of
``BLOCK`` cells, until one is left. Blocks are rows of a DataFrame, so a conversation that holds a third of all rows is many tasks; a table
is written after every round. What stays per conversation is the audit, a character per edit, and the digest of the
repaired text, for which its rows stream through one task in order.

Defined cases: a null id, turn, role or text is one space, and null ids are one conversation; rows of a turn are in order of role and text,
null turns first; a role that starts with none of the three initials (an empty one, too) can be reassigned or deleted, not kept; a conversation
without rows has no faults, costs nothing and hashes the empty text; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import numbered, runs
from shelfwise.session import materialized

BLOCK = 8
KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
WHITE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

# States of the grammar, the turns that lead from one to another, and the states that are reachable from each.
BEGIN, SYSTEM, USER, ASSISTANT = "0sua"
TURNS = {"s": [(BEGIN, SYSTEM)], "u": [(BEGIN, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
REACHED = {BEGIN: "0sua", SYSTEM: "sua", USER: "ua", ASSISTANT: "ua"}
NONTERMINALS = [(p, q) for p, ends in REACHED.items() for q in ends]
NUMBER = {pair: i for i, pair in enumerate(NONTERMINALS)}
RULES = [
    (NUMBER[p, q], NUMBER[p, r], NUMBER[r, q])
    for p, q in NONTERMINALS for r in REACHED[p] if q in REACHED[r]
]

Entry = tuple[int, str]
Cell = list[Entry | None]


def better(cell: Cell, at: int, entry: Entry) -> None:
    if cell[at] is None or entry < cell[at]:
        cell[at] = entry


def joined(left: Cell, right: Cell, into: Cell) -> Cell:
    """Binary rules over two adjacent spans."""
    for target, a, b in RULES:
        x, y = left[a], right[b]
        if x is not None and y is not None:
            cost, old = x[0] + y[0], into[target]
            if old is None or cost <= old[0]:
                entry = cost, x[1] + y[1]
                if old is None or entry < old:
                    into[target] = entry
    return into


def _insertions() -> Cell:
    """What insertion alone derives: every state from every other one, in as few turns as it takes."""
    said: Cell = [(0, "") if p == q else None for p, q in NONTERMINALS]
    one: Cell = list(said)
    for turn in "ua":
        for p, q in TURNS[turn]:
            better(one, NUMBER[p, q], (COSTS[INSERT], INSERT))
    while (more := joined(said, one, list(said))) != said:
        said = more
    return said


INSERTIONS = _insertions()


def cell_of(initial: str, must_go: bool, truncated: bool) -> Cell:
    """Terminal rules of one row, closed under insertion."""
    own: Cell = [None] * len(NONTERMINALS)
    for p in REACHED:
        better(own, NUMBER[p, p], (COSTS[DELETE], DELETE))
    if not must_go:
        left = TRUNCATED if truncated else 0
        for p, q in TURNS.get(initial, []):
            better(own, NUMBER[p, q], (COSTS[KEEP] + left, KEEP))
        for turn in "ua":
            for p, q in TURNS[turn]:
                better(own, NUMBER[p, q], (COSTS[REROLE] + left, REROLE))
    none: Cell = [None] * len(NONTERMINALS)
    return joined(joined(INSERTIONS, own, none), INSERTIONS, list(none))


def parse(cells: list[Cell]) -> Cell:
    """The cell of the whole span: a chart over all spans of the given adjacent cells."""
    n = len(cells)
    chart: dict[tuple[int, int], Cell] = {(i, i + 1): c for i, c in enumerate(cells)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = [None] * len(NONTERMINALS)
            for k in range(i + 1, i + length):
                joined(chart[i, k], chart[k, i + length], cell)
            chart[i, i + length] = cell
    return chart[0, n]


def best(cell: Cell) -> Entry:
    """Least (cost, audit) of a whole conversation."""
    return min(e for e in (cell[NUMBER[BEGIN, BEGIN]], cell[NUMBER[BEGIN, ASSISTANT]]) if e is not None)


class Repaired:
    """Digest of a repaired conversation whose rows come one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        self.hash, self.before, self.next = hashlib.sha256(), b"", "user"

    def _say(self, role: str, text: str) -> None:
        self.hash.update(self.before + f"{role}:{text}".encode())
        self.before = b"\n"

    def _turn(self) -> str:
        role, self.next = self.next, "assistant" if self.next == "user" else "user"
        return role

    def _inserted(self) -> None:
        while self.audit.startswith(INSERT, self.at):
            self._say(self._turn(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == REROLE:
            self._say(self._turn(), text)
        elif edit == KEEP:
            self._say(role, text)
            if not role.startswith("s"):
                self._turn()

    def hexdigest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


# ---- spans as rows

SPAN = "conv string, pos long, costs array<long>, audits array<string>, first string, last string, illegal long"


def _span(conv: str, pos: int, cell: Cell, first: str, last: str, illegal: int) -> dict:
    costs, audits = zip(*(e or (None, None) for e in cell), strict=True)
    return {"conv": conv, "pos": pos, "costs": costs, "audits": audits, "first": first, "last": last, "illegal": illegal}


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    block = F.floor(F.col("pos") / size).cast("long")
    return rows.withColumn("block", block).repartition("conv", "block").sortWithinPartitions("conv", "block", "pos")


def _batches(batches: Iterator[pa.RecordBatch], cells_of, at_once: int = 500) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv", pa.string()), ("pos", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
        + [("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())]
    )
    spans: list[dict] = []
    for block in runs(batches, ["conv", "block"]):
        firsts, lasts, illegal, cells = cells_of(block)
        illegal += sum(a + b not in LEGAL for a, b in zip(lasts, firsts[1:]))
        spans.append(_span(block.column("conv")[0].as_py(), block.column("block")[0].as_py(), parse(cells), firsts[0], lasts[-1], illegal))
        if len(spans) >= at_once:
            yield pa.RecordBatch.from_pylist(spans, schema)
            spans = []
    yield pa.RecordBatch.from_pylist(spans, schema)


def row_spans(rows: DataFrame, size: int) -> DataFrame:
    """Spans of up to ``size`` rows (conv, pos, initial, must_go, truncated)."""

    def cells_of(block: pa.Table):
        initials, go, cut = (block.column(c).to_pylist() for c in ("initial", "must_go", "truncated"))
        return initials, initials, 0, [cell_of(*r) for r in zip(initials, go, cut, strict=True)]

    return in_blocks(rows, size).mapInArrow(lambda batches: _batches(batches, cells_of), SPAN)


def wider_spans(spans: DataFrame, size: int) -> DataFrame:
    """Spans of up to ``size`` spans."""

    def cells_of(block: pa.Table):
        costs, audits = block.column("costs").to_pylist(), block.column("audits").to_pylist()
        cells = [[None if c is None else (c, a) for c, a in zip(*pair, strict=True)] for pair in zip(costs, audits, strict=True)]
        return block.column("first").to_pylist(), block.column("last").to_pylist(), sum(block.column("illegal").to_pylist()), cells

    return in_blocks(spans, size).mapInArrow(lambda batches: _batches(batches, cells_of), SPAN)


def whole_spans(rows: DataFrame, size: int) -> DataFrame:
    """One span per conversation. Conversations of one span wait for the long ones."""
    spans = materialized(row_spans(rows, size), "spans")
    done = None
    while True:
        long = materialized(spans.where("pos > 0").select("conv").distinct(), "long-conversations")
        ready = spans.join(long, "conv", "left_anti")
        done = ready if done is None else done.union(ready)
        if long.isEmpty():
            return done
        spans = materialized(wider_spans(spans.join(long, "conv", "left_semi"), size), "spans")


def repaired_hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): each conversation's audit, then its rows, one after the other through one task."""
    told = audits.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.select("conv", "pos", "role", "text").union(told).repartition("conv").sortWithinPartitions("conv", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            found: list[tuple[str, str]] = []
            for key, pos, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "pos", "role", "text")), strict=True):
                if pos < 0:
                    if state:
                        found.append((conv, state.hexdigest()))
                    conv, state = key, Repaired(text)
                else:
                    state.row(role, text)
            yield pa.RecordBatch.from_arrays([pa.array(c, "string") for c in zip(*found)] or [pa.array([], "string")] * 2, names=["conv", "repaired_sha256"])
        if state:
            yield pa.RecordBatch.from_pydict({"conv": [conv], "repaired_sha256": [state.hexdigest()]})

    return both.mapInArrow(run, "conv string, repaired_sha256 string")


# ---- conversations

FAULTS = ["blank", "duplicate", "truncated"]


def key_of(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def keyed(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text; a null id, role or text is one space."""
    return conversations.select(key_of("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), key_of("role").alias("role"), key_of("text").alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by the checksum of id and turn."""
    kind = F.crc32(F.concat("conv", F.lit(":"), key_of("turn"))) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def repair(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """``rows`` (conv, turn, role, text), read from files, to one row per conversation: faults, cost, audit, digest of the repaired text.

    A task parses ``size`` rows or cells at a time.
    """
    placed, _ = numbered(rows, "conv", ["turn", "role", "text"])
    said = F.rtrim(F.col("text"), F.lit(WHITE))
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    narrow = placed.select(
        "conv", "pos", "turn", F.substring("role", 1, 1).alias("initial"), mark.alias("mark"),
        (said == "").alias("blank"), (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    narrow = materialized(narrow, "turns")
    # Where a role and text are first said: at most one row per row, so the join has no large key.
    first = narrow.groupBy("conv", "mark").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("new"))
    judged = narrow.drop("mark").join(first, ["conv", "pos"], "left")
    duplicate = ~F.col("blank") & F.col("new").isNull()
    judged = judged.withColumn("duplicate", duplicate).withColumn("truncated", F.col("cut") & ~F.col("blank") & ~F.col("duplicate"))
    judged = judged.withColumn("must_go", F.col("blank") | F.col("duplicate"))
    judged = materialized(judged.select("conv", "pos", "turn", "initial", *FAULTS, "must_go"), "judged-turns")

    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    counts = judged.groupBy("conv").agg(gaps, *[F.sum(F.col(c).cast("long")).alias(c) for c in FAULTS])
    finish = F.udf(_finish, "cost long, audit string")
    spans = whole_spans(judged.select("conv", "pos", "initial", "must_go", "truncated"), size)
    parsed = materialized(spans.select("conv", "illegal", finish("costs", "audits").alias("e")).select("conv", "illegal", "e.*"), "repairs")
    return counts.join(parsed, "conv").join(repaired_hashes(placed, parsed), "conv")


def _finish(costs, audits):
    return best([None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)])


EMPTY = hashlib.sha256().hexdigest()


def repair_damaged(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """Every conversation of a table, damaged and repaired again."""
    found = repair(damaged(keyed(conversations)), size)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), key_of("conv_id").alias("conv")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return ids.join(found, "conv", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256")
    )
