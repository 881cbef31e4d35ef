"""Mounted collections: any DataFrame bound to a path, one row per child."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evergrove.functions import model
from evergrove.functions.columns import Cell, cell_of
from evergrove.operators import log as L


@dataclass(frozen=True)
class Collection:
    """``frame`` with the key column that names its children.  With ``ts`` and
    ``seq`` the frame is a history: what is read is the newest row of every key.
    """

    frame: DataFrame
    key: str | None = None
    ts: str | None = None
    seq: str | None = None

    @property
    def rows(self) -> DataFrame:
        return L.current(self.frame, self.key, self.ts, self.seq) if self.ts else self.frame

    def now(self) -> Collection:
        return Collection(self.rows, self.key) if self.ts else self

    def as_of(self, time: model.Time) -> Collection:
        if not self.ts:
            raise ValueError("the collection has no history")
        return Collection(L.as_of(self.frame, self.key, time, self.ts, self.seq), self.key)

    def cell(self, name: str) -> Cell | None:
        """A field of the row; ``key`` is the child's name."""
        schema = self.frame.schema
        if name in schema.fieldNames():
            return cell_of(F.col(_quoted(name)), schema[name].dataType)
        if name == "@stamp" and "stamp" in schema.fieldNames():
            return cell_of(F.col("stamp"), schema["stamp"].dataType)
        if name in ("@time", "@agent") and self.ts:
            column = self.ts if name == "@time" else "author"
            return cell_of(F.col(_quoted(column)), schema[column].dataType) if column in schema.fieldNames() else None
        if name == "key" and self.key:
            return Cell(F.col(_quoted(self.key)).cast("string"), "text")
        return None

    def filter(self, *predicates: Cell) -> Collection:
        """Rows for which all predicates are true.  A predicate that is unknown
        for a row drops it; see ``unknown_rows``."""
        current = self.now()
        frame = current.frame
        for p in predicates:
            frame = frame.where(p.condition)
        return replace(current, frame=frame)

    def unknown_rows(self, *predicates: Cell) -> DataFrame:
        """The rows that ``filter`` drops because it cannot tell, with ``reason``."""
        from evergrove.functions.columns import first_reason

        reason = first_reason(*[p.reason for p in predicates])
        rows = self.rows
        return rows.limit(0).withColumn("reason", F.lit(None).cast("string")) if reason is None else rows.withColumn("reason", reason).where("reason is not null")

    def select_key(self, key: Column) -> Collection:
        """The child of that name.  The test is on the key column itself, so a
        history is filtered before it is aggregated."""
        kept = self.frame.where(F.col(_quoted(self.key)) == key.cast(self.frame.schema[self.key].dataType))
        return replace(self, frame=kept).now()

    def project(self, names: Sequence[str], excluded: Sequence[str] = ()) -> Collection:
        """Fields by name, by ``prefix*`` or ``*``.  A name that does not exist
        is null, with ``not_found`` in ``<name>__reason``."""
        current = self.now()
        have = current.frame.columns
        wanted: list[Column] = []
        seen: set[str] = set()
        for name in names:
            matching = [c for c in have if name.endswith("*") and c.startswith(name[:-1])] if name.endswith("*") else [name]
            for column in matching:
                if column in seen or any(_matches(column, x) for x in excluded):
                    continue
                seen.add(column)
                if column in have:
                    wanted.append(F.col(_quoted(column)))
                elif column == "key" and current.key:
                    wanted.append(F.col(_quoted(current.key)).cast("string").alias("key"))
                else:
                    wanted += [F.lit(None).cast("string").alias(column), F.lit("not_found").alias(f"{column}__reason")]
        return Collection(current.frame.select(*wanted), current.key if current.key in seen else None)

    def derive(self, **cells: Cell) -> DataFrame:
        """The rows with computed values; an expression that can fail also gives
        ``<name>__reason``."""
        columns = {}
        for name, cell in cells.items():
            columns[name] = cell.value
            if cell.reason is not None:
                columns[f"{name}__reason"] = cell.reason
        return self.rows.withColumns(columns)

    def dereference(self, field: str, target: Collection, prefix: str = "") -> DataFrame:
        """Rows with the fields of what their reference points to; a reference
        without a target keeps its row."""
        other = target.now()
        renamed = other.frame.select(*[F.col(_quoted(c)).alias(f"{prefix}{c}") for c in other.frame.columns])
        return self.rows.join(renamed, F.col(_quoted(field)) == F.col(_quoted(prefix + other.key)), "left")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _matches(name: str, pattern: str) -> bool:
    return name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern
