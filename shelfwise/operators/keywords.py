"""Names whose keywords occur in a message, by one automaton per tenant.

All keywords of a tenant are one Aho-Corasick automaton: a message is read once, whatever their number, and every keyword that ends
at a character is seen there, also inside a longer word or another keyword. Keyword tables up to ``SHIPPED_BYTES`` go
to the tasks whole, and messages stay where they are. Beyond that, messages meet the keywords of their tenant only, in parts of
``PART_ROWS`` messages, so a tenant with a third of all messages is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.keywords import folded
from ..session import materialized

SHIPPED_BYTES = 8_000_000
PART_ROWS = 4096

Pattern = tuple[int | None, str | None, str]


class Names:
    """The names of one tenant, in pattern order, with their keywords."""

    def __init__(self, patterns: list[Pattern]):
        order = lambda p: tuple((v is not None, v if v is not None else 0) for v in p)  # noqa: E731  nulls first
        self.names = [name for _, name, _ in sorted(patterns, key=order)]
        words: dict[str, list[int]] = {}
        for at, (_, _, keyword) in enumerate(sorted(patterns, key=order)):
            words.setdefault(keyword, []).append(at)
        self.always = words.pop("", [])
        self.automaton = None
        if words:
            self.automaton = ahocorasick.Automaton()
            for keyword, places in words.items():
                self.automaton.add_word(keyword, places)
            self.automaton.make_automaton()

    def found(self, low: str | None) -> list[str | None]:
        """All names with a keyword in the folded text, each once, in pattern order."""
        if low is None:
            return []
        places = set(self.always)
        if self.automaton is not None:
            for _, ends in self.automaton.iter(low):
                places.update(ends)
        return list(dict.fromkeys(self.names[i] for i in sorted(places)))


NOBODY = Names([])


def by_tenant(rows: list[tuple]) -> dict[str, Names]:
    tenants: dict[str, list[Pattern]] = {}
    for tenant, *pattern in rows:
        tenants.setdefault(tenant, []).append(tuple(pattern))
    return {tenant: Names(patterns) for tenant, patterns in tenants.items()}


def with_names(
    messages: DataFrame, patterns: DataFrame, column: str = "hints", shipped_bytes: int = SHIPPED_BYTES, part_rows: int = PART_ROWS
) -> DataFrame:
    """Add ``column``: the names with a keyword in ``message``, for each tenant's own rows ``(tenant_id, ordinal, canonical, keyword)``.

    A null message, a null tenant and a tenant without keywords have no names; an empty keyword is in every message.
    """
    rows = patterns.select("tenant_id", F.col("ordinal").cast("long").alias("ordinal"), "canonical", folded(F.col("keyword")).alias("keyword"))
    rows = materialized(rows.where("tenant_id IS NOT NULL AND keyword IS NOT NULL").distinct(), "keywords")
    bytes_of = F.octet_length("keyword") + F.octet_length(F.coalesce("canonical", F.lit(""))) + F.octet_length("tenant_id") + 16
    told = messages.drop(column).withColumn("__low", folded(F.col("message")))
    kept = [f for f in told.schema.fields if f.name != "__low"]
    schema = T.StructType([*kept, T.StructField(column, T.ArrayType(T.StringType()))])
    if (rows.agg(F.sum(bytes_of)).head()[0] or 0) <= shipped_bytes:
        return _in_place(told, rows, schema)
    return _in_meetings(told, rows, schema, part_rows)


def _in_place(told: DataFrame, rows: DataFrame, schema: T.StructType) -> DataFrame:
    spark = told.sparkSession
    shipped = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])  # at most SHIPPED_BYTES
    kept, arrays = schema.names[:-1], to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenants = by_tenant(shipped.value)
        for batch in batches:
            pairs = zip(batch["tenant_id"].to_pylist(), batch["__low"].to_pylist(), strict=True)
            found = [tenants.get(tenant, NOBODY).found(low) for tenant, low in pairs]
            columns = [*(batch[c] for c in kept), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=arrays.names)

    return told.mapInArrow(run, schema)


def _in_meetings(told: DataFrame, rows: DataFrame, schema: T.StructType, part_rows: int) -> DataFrame:
    kept = schema.names[:-1]
    # A null tenant's messages meet nothing, and are dealt out like any other.
    key = F.coalesce(F.concat(F.lit("="), F.col("tenant_id")), F.lit("")).alias("__tenant")
    told, rows = told.select("*", key), rows.select(key, "ordinal", "canonical", "keyword")
    parts = told.groupBy("__tenant").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("__parts"))
    parts = materialized(parts, "message-parts")
    dealt = F.pmod(F.xxhash64(*kept), F.col("__parts")).cast("int")
    left = told.join(parts, "__tenant").withColumn("__part", dealt).drop("__parts")
    right = rows.join(parts, "__tenant").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))

    def match(messages: pa.Table, patterns: pa.Table) -> pa.Table:
        names = Names(list(zip(*(patterns[c].to_pylist() for c in ("ordinal", "canonical", "keyword")), strict=True)))
        found = [names.found(low) for low in messages["__low"].to_pylist()]
        return messages.select(kept).append_column(schema.names[-1], pa.array(found, pa.list_(pa.string())))

    meeting = ["__tenant", "__part"]
    return left.groupBy(*meeting).cogroup(right.drop("__parts").groupBy(*meeting)).applyInArrow(match, schema)
