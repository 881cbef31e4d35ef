"""Exact deduplication by Grace hashing.

Rows are first combined where they are read (a bounded table per task, flushed
when full), so that a text that makes up a third of all rows reaches the
shuffle at most once per flush of a task.  The combined records are hash
partitioned by content digest, and every task then runs the Grace recursion:
records go into an open-addressing table that compares complete contents; when
the table outgrows its memory, it and the rest of the input are dealt to
``fanout`` spill files by the next bits of the digest, and each file is treated
the same way one level deeper.  Spill files are scratch space of the running
task, and are gone when it ends; a lost executor's tasks simply run again.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evergrove.llm.common import checkpointed, whole_text

LOWEST = -(2**63)
ENTRY_BYTES = 200  # of bookkeeping beside the content


class OpenTable:
    """Open-addressing hash table with linear probing.

    A slot is taken for equal only if the complete contents are equal; digests
    merely say where to look.
    """

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, dtype=np.int64)
        self.digests: list[bytes] = []
        self.contents: list[str] = []
        self.keep: list[int] = []
        self.count: list[int] = []
        self.ties: list[int] = []  # rows that have the largest id
        self.bytes = 0

    def _find(self, digest: bytes, content: str) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (entry := self.slots[at]) >= 0:
            if self.digests[entry] == digest and self.contents[entry] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: str, keep: int, count: int, ties: int) -> None:
        at = self._find(digest, content)
        entry = int(self.slots[at])
        if entry >= 0:
            self.count[entry] += count
            if keep > self.keep[entry]:
                self.keep[entry], self.ties[entry] = keep, ties
            elif keep == self.keep[entry]:
                self.ties[entry] += ties
            return
        self.slots[at] = len(self.contents)
        self.digests.append(digest)
        self.contents.append(content)
        self.keep.append(keep)
        self.count.append(count)
        self.ties.append(ties)
        self.bytes += len(content.encode()) + ENTRY_BYTES
        if 2 * len(self.contents) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        size = 2 * len(self.slots)
        self.slots = np.full(size, -1, dtype=np.int64)
        for entry, digest in enumerate(self.digests):
            at = int.from_bytes(digest[-8:], "little") & (size - 1)
            while self.slots[at] >= 0:
                at = (at + 1) & (size - 1)
            self.slots[at] = entry

    def records(self) -> Iterator[tuple[bytes, str, int, int, int]]:
        return zip(self.digests, self.contents, self.keep, self.count, self.ties)


def grace(records: Iterable[tuple[bytes, str, int, int, int]], memory: int, fanout: int, level: int = 0):
    """Yield one (digest, content, keep, count, ties) per distinct content: the
    largest id, the rows, and those of them that have that id."""
    table, records = OpenTable(), iter(records)
    for record in records:
        table.add(*record)
        # past the digest's last byte no split is possible: what is left has one digest
        if table.bytes > memory and level < 20:
            break
    else:
        yield from table.records()
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        paths = [os.path.join(folder, str(k)) for k in range(fanout)]
        files = [open(path, "wb") for path in paths]
        try:
            for source in (table.records(), records):
                for record in source:
                    pickle.dump(record, files[record[0][level] % fanout], protocol=5)
        finally:
            for file in files:
                file.close()
        del table
        for path in paths:
            yield from grace(_spilled(path), memory, fanout, level + 1)
            os.remove(path)


def _spilled(path: str):
    with open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(records, schema: pa.Schema, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list = []
    for record in records:
        held.append(record)
        if len(held) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _combiner(memory: int):
    schema = pa.schema([("digest", pa.binary()), ("content", pa.string()), ("keep", pa.int64()), ("count", pa.int64()), ("ties", pa.int64())])

    def run(batches):
        def flushed():
            table = OpenTable()
            for digest, content, key in _rows(batches):
                table.add(digest, content, key, 1, 1)
                if table.bytes > memory:
                    yield from table.records()
                    table = OpenTable()
            yield from table.records()

        return _batches(flushed(), schema)

    return run


def _reducer(memory: int, fanout: int):
    schema = pa.schema([("digest", pa.binary()), ("keep", pa.int64()), ("count", pa.int64()), ("ties", pa.int64())])

    def run(batches):
        def groups():
            for digest, _, keep, count, ties in grace(_rows(batches), memory, fanout):
                yield digest, keep, count, ties

        return _batches(groups(), schema)

    return run


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", memory_mb: int = 48, fanout: int = 16) -> DataFrame:
    """(digest, keep, count, ties): one row per distinct content."""
    text = whole_text(text_column)
    rows = docs.select(
        F.sha2(text, 256).alias("digest"), text.alias("content"), F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST)).alias("key")
    ).select(F.unhex("digest").alias("digest"), "content", "key")
    combined = rows.mapInArrow(_combiner(memory_mb << 20), "digest binary, content string, keep long, count long, ties long")
    return combined.repartition("digest").mapInArrow(_reducer(memory_mb << 20, fanout), "digest binary, keep long, count long, ties long")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", memory_mb: int = 48, fanout: int = 16) -> DataFrame:
    """Mark exact copies.  Of equal texts the row with the largest id stays.

    Returns one row per input row: the id, ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256``.  Only digests travel back to the rows.

    Null text counts as empty; empty texts are equal to each other.  A null id
    is below every other id; rows whose group has no other id keep a null
    ``keep_id`` and all count as kept.  Repeated rows with one id and one text
    are the same document and share its decision.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    groups = exact_groups(docs, id_column, text_column, memory_mb, fanout).withColumnRenamed("digest", "group_digest")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.unhex(F.sha2(whole_text(text_column), 256)).alias("row_digest"))
    keep = F.when(F.col("keep") != LOWEST, F.col("keep"))
    return rows.join(groups, F.col("row_digest") == F.col("group_digest")).select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("count").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("row_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, of each group of equal texts:
    the one with the largest id.

    A null id is below every other; null text counts as empty.  Where several
    rows have the group's text and that id, one of them stays (they may differ
    in other columns only); they are combined before they are shuffled.  An empty
    table gives an empty result.
    """
    groups = checkpointed(exact_groups(docs, id_column, text_column)).select(F.col("digest").alias(_free(docs, "digest")), F.col("keep").alias(_free(docs, "keep")), F.col("ties").alias(_free(docs, "ties")))
    found_digest, keep, ties = groups.columns
    digest, key = F.unhex(F.sha2(whole_text(text_column), 256)), F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST))
    marked = docs.join(groups, (digest == F.col(found_digest)) & (key == F.col(keep)))
    repeated = marked.where(F.col(ties) > 1).groupBy(found_digest).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    return marked.where(F.col(ties) == 1).select(*docs.columns).unionAll(repeated.select("row.*"))


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or what it takes not to clash with a column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name
