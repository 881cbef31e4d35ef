"""The instance log: append-only rows, one per value that a path ever had.

Every operator takes and returns DataFrames and works on any table with key
columns, a timestamp and a sequence number; ``(ts, seq)`` orders instances
totally.  Newest-per-key is an aggregate with a partial step before its shuffle,
never a window over whole histories.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evergrove.functions import model
from evergrove.functions.columns import time_struct
from evergrove.operators.placement import cuts_passed
from evergrove.operators.visibility import hide

SCHEMA = (
    "path string, ts timestamp_ntz, seq bigint, author bigint, kind string, v_text string, v_num double, v_bool boolean, "
    "v_time struct<ts:timestamp_ntz,prec:tinyint>, v_money struct<amount:double,currency:string>, v_json string, "
    "tombstoned boolean, stamp map<string,string>"
)
VALUE_COLUMNS = ("kind", "v_text", "v_num", "v_bool", "v_time", "v_money", "v_json")


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


_TIMES, _COUNTS = ("timestamp", "timestamp_ntz"), ("bigint", "int", "smallint", "tinyint")


def micros(rows: DataFrame, ts: str) -> Column:
    """A timestamp as microseconds since 1970, in its own order: a time without a
    zone is not taken for one of the session's zone, where hours are skipped and
    repeated."""
    time = F.col(ts)
    if dict(rows.dtypes)[ts] != "timestamp_ntz" or rows.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        return F.unix_micros(time.cast("timestamp"))
    seconds = F.unix_date(time.cast("date")).cast("bigint") * 86_400 + F.hour(time) * 3_600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")


def instance_order(log: DataFrame, ts: str = "ts", seq: str = "seq") -> Column:
    """What orders instances totally, for ``max_by``.  A timestamp and a whole
    number become one decimal, microseconds high and sequence low: that fits an
    aggregation buffer of fixed width, so numbers, times and booleans are
    aggregated by hash, and only columns of text need the sort.  Nulls are lowest.
    """
    kinds = dict(log.dtypes)
    if kinds.get(ts) not in _TIMES or kinds.get(seq) not in _COUNTS:
        return F.struct(ts, seq)
    lowest = F.lit(-(2**62))
    high = F.coalesce(micros(log, ts), lowest).cast("decimal(19,0)")
    low = F.coalesce(F.col(seq).cast("bigint"), F.lit(-(2**63))).cast("decimal(19,0)")
    return (high * F.lit(Decimal(2 * 10**19)) + low).cast("decimal(38,0)")


def newest(log: DataFrame, keys: Sequence[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The newest row of every key; the columns' order is the keys' first."""
    rest = [c for c in log.columns if c not in keys]
    ordered = log.withColumn("__order", instance_order(log, ts, seq))
    # one aggregate per column: those that nobody reads are pruned, down to the scan
    return ordered.groupBy(*keys).agg(*[F.max_by(c, "__order").alias(c) for c in rest])


def current(log: DataFrame, keys: str | Sequence[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The newest instance of every key; all columns."""
    return newest(log, _keys(keys), ts, seq).select(*log.columns)


def window_end(time: model.Time) -> datetime:
    return time.window()[1]


def as_of(log: DataFrame, keys: str | Sequence[str], time: model.Time, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The newest instance of every key up to the end of ``time``'s window.  The
    time filter reaches the scan."""
    return current(log.where(F.col(ts) < F.lit(window_end(time).isoformat(sep=" ")).cast("timestamp_ntz")), keys, ts, seq)


def no_value(path: str, time: model.Time, cause: str) -> str:
    return f"no value for {path} as of {model.time_text(time)}: {cause}"


def no_instance(time: model.Time) -> str:
    """The cause, up to the path, of a miss where there are later instances."""
    last = window_end(time) - timedelta(microseconds=1)
    return f"no instance found at timestamp {round((last - datetime(1970, 1, 1)) / timedelta(microseconds=1))} for path "


def as_of_or_unknown(log: DataFrame, keys: str | Sequence[str], time: model.Time, ts: str = "ts", seq: str = "seq", root: str = "") -> DataFrame:
    """As ``as_of``, with a row for every key: ``reason`` says where the key,
    a path below ``root``, had no instance yet.  One pass: instances after the
    window do not compete, but their keys are seen."""
    keys = _keys(keys)
    path = F.concat_ws(".", *([F.lit(root)] if root else []), *[F.col(k).cast("string") for k in keys])
    miss = F.concat(F.lit("no value for "), path, F.lit(f" as of {model.time_text(time)}: {no_instance(time)}["), F.replace(path, F.lit("."), F.lit(" ")), F.lit("]"))
    rest = [c for c in log.columns if c not in keys]
    within = F.col(ts) < F.lit(window_end(time).isoformat(sep=" ")).cast("timestamp_ntz")
    newest = log.groupBy(*keys).agg(F.max_by(F.when(within, F.struct(*rest)), F.when(within, F.struct(ts, seq))).alias("newest"))
    values = [F.col(f"newest.{c}").alias(c) for c in rest]
    return newest.select(*keys, *values, F.when(F.col("newest").isNull(), miss).alias("reason"))


def history(log: DataFrame, keys: str | Sequence[str], ts: str = "ts", seq: str = "seq", ranges: int | None = None) -> DataFrame:
    """All instances with ``age``: 1 is the newest of its key.  With ``ranges`` a
    key's history is cut into that many ranges of time (see `ranged`)."""
    if not ranges:
        order = Window.partitionBy(*_keys(keys)).orderBy(F.col(ts).desc(), F.col(seq).desc())
        return log.withColumn("age", F.row_number().over(order).cast("long"))
    return numbered(log, _keys(keys), ts, seq, ranges, "age", newest_first=True)


def ranged(rows: DataFrame, ts: str, ranges: int) -> DataFrame:
    """Rows with ``__range``, the part of the table's time that they are in, by
    quantiles of the times (one number a range); rows without a time come first.

    A window by key is one task a key; where a key may hold a large share of the
    rows, windows by key and range, and one row a range to carry over, are not."""
    at = micros(rows, ts)
    cuts = rows.agg(F.percentile_approx(at, [k / ranges for k in range(1, ranges)], max(10_000, 4 * ranges)).alias("cuts")).first()["cuts"] if ranges > 1 else []
    return rows.withColumn("__range", F.coalesce(cuts_passed(at, sorted(set(cuts or []))), F.lit(-1)))


def _with_range_values(dealt: DataFrame, keys: list[str], values: DataFrame) -> DataFrame:
    """``dealt`` with the columns that ``values`` has for its keys and range."""
    carried = [c for c in values.columns if c not in (*keys, "__range")]
    other = values.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), *carried)
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return dealt.join(other, same).drop("__r", *[f"__key{i}" for i in range(len(keys))])


def numbered(rows: DataFrame, keys: Sequence[str], ts: str, seq: str, ranges: int, name: str, newest_first: bool = False) -> DataFrame:
    """Every instance's number among its key's, from the first or the newest on."""
    keys, way = list(keys), (lambda c: F.col(c).desc()) if newest_first else (lambda c: F.col(c).asc())
    dealt = ranged(rows, ts, ranges)
    ahead = Window.partitionBy(*keys).orderBy(way("__range")).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    counts = counts.select(*keys, "__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    order = Window.partitionBy(*keys, "__range").orderBy(way(ts), way(seq))
    found = _with_range_values(dealt, keys, counts)
    return found.withColumn(name, F.row_number().over(order) + F.col("__ahead")).select(*rows.columns, name)


def neighbours(rows: DataFrame, keys: Sequence[str], ts: str, seq: str, before: Mapping[str, Column], after: Mapping[str, Column], ranges: int | None = None) -> DataFrame:
    """Rows with values of their key's instance before them (``before``) and after
    them (``after``), as structs ``__before`` and ``__after``, null at the ends."""
    keys = list(keys)
    first, last = (F.struct(*[c.alias(n) for n, c in (values or {"none": F.lit(0)}).items()]) for values in (after, before))
    if not ranges:
        order = Window.partitionBy(*keys).orderBy(ts, seq)
        own = rows.withColumns({"__first": first, "__last": last})
        # nothing asked for, nothing computed
        beside = {"__before": F.lag("__last").over(order) if before else F.lit(None), "__after": F.lead("__first").over(order) if after else F.lit(None)}
        return own.withColumns(beside).drop("__first", "__last")
    dealt = ranged(rows, ts, ranges).withColumns({"__first": first, "__last": last})
    place = instance_order(dealt, ts, seq)
    ends = dealt.groupBy(*keys, "__range").agg(F.min_by("__first", place).alias("__from"), F.max_by("__last", place).alias("__to"))
    along = Window.partitionBy(*keys).orderBy("__range")
    ends = ends.select(*keys, "__range", F.lag("__to").over(along).alias("__to"), F.lead("__from").over(along).alias("__from"))
    order = Window.partitionBy(*keys, "__range").orderBy(ts, seq)
    found = _with_range_values(dealt, keys, ends)
    found = found.withColumns({"__before": F.coalesce(F.lag("__last").over(order), "__to"), "__after": F.coalesce(F.lead("__first").over(order), "__from")})
    return found.select(*rows.columns, "__before", "__after")


def history_range(log: DataFrame, start: model.Time | None = None, end: model.Time | None = None, ts: str = "ts") -> DataFrame:
    """Instances from the start of ``start``'s window up to, not including, the
    start of ``end``'s."""
    if start is not None:
        log = log.where(F.col(ts) >= F.lit(start.window()[0].isoformat(sep=" ")).cast("timestamp_ntz"))
    if end is not None:
        log = log.where(F.col(ts) < F.lit(end.window()[0].isoformat(sep=" ")).cast("timestamp_ntz"))
    return log


def suppress_unchanged(log: DataFrame, keys: str | Sequence[str], value: str | Column, ts: str = "ts", seq: str = "seq", ranges: int | None = None) -> DataFrame:
    """Drop instances whose value equals the one before it.  ``ranges``: see `ranged`."""
    value = F.col(value) if isinstance(value, str) else value
    # a struct, so that a first instance of nothing differs from no instance
    marked = neighbours(log.withColumn("__own", F.struct(value.alias("v"))), _keys(keys), ts, seq, {"v": value}, {}, ranges)
    return marked.where("not (__own <=> __before)").select(*log.columns)


def instance_meta(log: DataFrame, keys: str | Sequence[str], value: str, ts: str = "ts", seq: str = "seq", ranges: int | None = None) -> DataFrame:
    """Adds ``previous_instance_id``, ``valid_to`` (the next instance's time) and
    ``size``, the bytes of the value's text.  ``ranges``: see `ranged`."""
    found = neighbours(log, _keys(keys), ts, seq, {"seq": F.col(seq)}, {"ts": F.col(ts)}, ranges)
    meta = [F.col("__before.seq").alias("previous_instance_id"), F.col("__after.ts").alias("valid_to"), F.octet_length(F.col(value).cast("string")).cast("long").alias("size")]
    return found.select(*log.columns, *meta)


def expired(log: DataFrame, now: datetime, ttl: Column, ts: str = "ts") -> DataFrame:
    """Instances whose time to live, an interval, has passed."""
    return log.where(F.col(ts) + ttl <= F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz"))


def as_of_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], carried: Sequence[str], ts: str = "ts", seq: str = "seq", ranges: int | None = None) -> DataFrame:
    """Every left row with the newest right row of its key at or before it.

    One shuffle by key over the union of both sides; ``last`` with nulls ignored
    carries the right side forward.  Right rows at the same instant come first.
    With ``ranges`` (see `ranged`) each range's last right row is carried over.
    """
    keys = _keys(keys)
    lefts = left.withColumns({"__side": F.lit(1), "__right": F.lit(None).cast(_struct_type(right, carried))})
    rights = right.select(*keys, ts, seq, F.lit(0).alias("__side"), F.struct(*[F.col(c).alias(f"right_{c}") for c in carried]).alias("__right"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    if not ranges:
        order = Window.partitionBy(*keys).orderBy(ts, "__side", seq).rowsBetween(Window.unboundedPreceding, 0)
        matched = both.withColumn("__right", F.last("__right", ignorenulls=True).over(order)).where("__side = 1")
        return matched.select(*left.columns, "__right.*")
    dealt = ranged(both, ts, ranges)
    lasts = dealt.groupBy(*keys, "__range").agg(F.max_by("__right", F.when(F.col("__side") == 0, instance_order(dealt, ts, seq))).alias("__last"))
    along = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(*keys, "__range", F.last("__last", ignorenulls=True).over(along).alias("__carried"))
    order = Window.partitionBy(*keys, "__range").orderBy(ts, "__side", seq).rowsBetween(Window.unboundedPreceding, 0)
    found = _with_range_values(dealt, keys, lasts)
    matched = found.withColumn("__right", F.coalesce(F.last("__right", ignorenulls=True).over(order), "__carried")).where("__side = 1")
    return matched.select(*left.columns, "__right.*")


def _struct_type(frame: DataFrame, columns: Sequence[str]):
    return frame.select(F.struct(*[F.col(c).alias(f"right_{c}") for c in columns]).alias("s")).schema["s"].dataType


# --- the tree -----------------------------------------------------------------


def children(log: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Distinct names right below ``prefix``.  The prefix test is a range on the
    path, which a scan can use."""
    below = below_prefix(log, prefix, path)
    rest = F.substring(F.col(path), F.lit(len(prefix) + 2), F.length(path))
    return below.select(F.split_part(rest, F.lit("."), F.lit(1)).alias("name")).distinct()


def below_prefix(log: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    return log.where(F.col(path).startswith(prefix + "."))


def subtree_paths(log: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Every path that was written below ``prefix``, as the rest of it."""
    return below_prefix(log, prefix, path).select(F.substring(F.col(path), F.lit(len(prefix) + 2), F.length(path)).alias("rest")).distinct()


def leaf_paths(log: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Those of ``subtree_paths`` that have nothing below them."""
    paths = subtree_paths(log, prefix, path)
    parents = paths.select(F.explode(ancestors_of(F.col("rest"))).alias("parent")).distinct()
    return paths.join(parents, F.col("rest") == F.col("parent"), "left_anti")


def ancestors_of(path: Column) -> Column:
    """All proper ancestors of a dotted path, the root first."""
    parts = F.split(path, "\\.")
    return F.transform(F.slice(F.sequence(F.lit(1), F.size(parts)), F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def explode_record(rows: DataFrame, root: str, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows of a mounted collection as paths: one (path, name, value) per field,
    values as text."""
    fields = list(fields)
    pairs = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(F.col(key).alias("key"), F.explode(pairs).alias("p")).select(
        F.concat(F.lit(root + "."), F.col("key").cast("string"), F.lit("."), F.col("p.name")).alias("path"), F.col("p.name").alias("name"), F.col("p.value").alias("value")
    )


def assemble_record(paths: DataFrame, root: str, fields: Sequence[str], path: str = "path", value: str = "value") -> DataFrame:
    """The inverse: one row per child of ``root`` with its declared fields."""
    depth = root.count(".") + 2
    parts = below_prefix(paths, root, path).select(F.split(path, "\\.").alias("parts"), F.col(value).alias("value"))
    named = parts.select(F.get("parts", F.lit(depth - 1)).alias("key"), F.array_join(F.slice("parts", F.lit(depth + 1), F.size("parts")), ".").alias("name"), "value")
    return named.groupBy("key").agg(*[F.max(F.when(F.col("name") == f, F.col("value"))).alias(f) for f in fields])


# --- writing ------------------------------------------------------------------


def purge(log: DataFrame, prefix: str, start: datetime, end: datetime, path: str = "path", ts: str = "ts") -> DataFrame:
    """Tombstone the instances of a path, and of all below it, in [start, end]."""
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    hit = ((F.col(path) == prefix) | F.col(path).startswith(prefix + ".")) & F.col(ts).between(at(start), at(end))
    return log.withColumn("tombstoned", F.coalesce(F.col("tombstoned"), F.lit(False)) | hit)


def visible(log: DataFrame) -> DataFrame:
    return log.where("not coalesce(tombstoned, false)")


def compaction_stats(log: DataFrame) -> DataFrame:
    """Instances before and after dropping tombstones."""
    dead = F.coalesce(F.col("tombstoned"), F.lit(False))
    return log.agg(F.count("*").alias("before"), F.count_if(~dead).alias("after"), F.count_if(dead).alias("dropped"))


def compact(log: DataFrame, folder: str) -> None:
    """Rewrite what is visible, clustered by path so that prefix scans skip files."""
    visible(log).repartitionByRange("path").sortWithinPartitions("path", "ts", "seq").write.mode("overwrite").parquet(folder)


def value_columns(v) -> dict:
    """A single value as the log's value columns."""
    kind = model.kind_of(v)
    row: dict = dict.fromkeys(VALUE_COLUMNS) | {"kind": kind}
    if kind in ("text", "reference"):
        row["v_text"] = v if kind == "text" else v.path
    elif kind == "unknown":
        row["v_text"] = v.reason
    elif kind == "number":
        row["v_num"] = float(v)
    elif kind == "boolean":
        row["v_bool"] = v
    elif kind == "time":
        row["v_time"] = (v.at, v.precision)
    elif kind == "money":
        row["v_money"] = (v.amount, v.currency)
    elif kind in ("list", "record"):
        row["v_json"] = model.to_json(v)
    return row


def value_of(row) -> object:
    """The log's value columns as a single value."""
    kind = row["kind"]
    if kind == "text":
        return row["v_text"]
    if kind == "reference":
        return model.Ref(row["v_text"])
    if kind == "unknown":
        return model.Unknown(row["v_text"])
    if kind == "number":
        return row["v_num"]
    if kind == "boolean":
        return row["v_bool"]
    if kind == "time":
        return model.Time(row["v_time"]["ts"], row["v_time"]["prec"])
    if kind == "money":
        return model.Money(row["v_money"]["amount"], row["v_money"]["currency"])
    if kind in ("list", "record"):
        return model.parse_json(row["v_json"])
    return model.ANYTHING if kind == "anything" else None


class InstanceLog:
    """A log held as a DataFrame; every batch of writes is one append.

    ``folder`` makes it durable: batches are Parquet files there, and the plan
    stays one scan.  Without it, new rows are held here and joined to what the log
    began with; past ``HELD`` they go to the checkpoint folder, if there is one.
    Reads of many paths share one scan.
    """

    HELD = 10_000

    def __init__(self, spark: SparkSession, frame: DataFrame | None = None, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self._base, self._held, self._frame = frame, [], None
        self.next_seq = 1 if frame is None else (frame.agg(F.max("seq")).first()[0] or 0) + 1

    @property
    def frame(self) -> DataFrame:
        if self._frame is None:
            new = self.spark.createDataFrame(self._held, SCHEMA)
            self._frame = new if self._base is None else self._base.unionByName(new)
        return self._frame

    @frame.setter
    def frame(self, frame: DataFrame) -> None:
        self._base, self._held, self._frame = frame, [], frame

    def _add(self, rows: list[tuple]) -> None:
        if self.folder:
            self.spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(self.folder)
            self.frame = self.spark.read.schema(SCHEMA).parquet(self.folder)
            return
        self._held += rows
        self._frame = None
        if len(self._held) > self.HELD and self.spark.sparkContext.getCheckpointDir():
            self.frame = self.frame.checkpoint()

    def append(self, writes: Sequence[tuple], author: int = 0, at: datetime | None = None, stamp: dict | None = None) -> list[str]:
        """Append (path, value) pairs that change something; returns the paths
        that did.  An unknown is not stored."""
        last = {}
        changed, rows = [], []
        known = self.read_many([p for p, _ in writes])
        for path, value in writes:
            if isinstance(value, model.Unknown):
                continue
            before = last.get(path, known.get(path, model.Unknown("not_found")))
            if model.kind_of(before) == model.kind_of(value) and model.to_json(before) == model.to_json(value):
                continue
            last[path] = value
            row = value_columns(value) | {"path": path, "ts": at or utc_now(), "seq": self.next_seq, "author": author, "tombstoned": False, "stamp": stamp or {}}
            self.next_seq += 1
            rows.append(tuple(row[f] for f in _FIELDS))
            changed.append(path)
        if rows:
            self._add(rows)
        return list(dict.fromkeys(changed))

    def _newest(self, rows: DataFrame, time: model.Time | None, hidden: Mapping | None) -> DataFrame:
        """The newest visible instances; those whose stamp a viewer's filter
        matches are hidden, and nothing older takes their place."""
        found = current(rows, "path") if time is None else as_of(rows, "path", time)
        return hide(found, F.col("stamp"), hidden) if hidden else found

    def read_many(self, paths: Sequence[str], time: model.Time | None = None, hidden: Mapping | None = None) -> dict[str, object]:
        """Current (or as-of) values of the paths that have one: one scan."""
        if not paths:
            return {}
        wanted = visible(self.frame).where(F.col("path").isin(list(dict.fromkeys(paths))))
        return {row["path"]: value_of(row) for row in self._newest(wanted, time, hidden).collect()}

    def read(self, path: str, time: model.Time | None = None, hidden: Mapping | None = None, written: str | None = None):
        """The value of ``path``; messages name it as it was ``written``."""
        found = self.read_many([path], time, hidden)
        if path in found:
            return found[path]
        if time is None:
            return model.Unknown("not_found")
        named = f"[{path.replace('.', ' ')}]"
        exists = hidden is None and not visible(self.frame).where(F.col("path") == path).isEmpty()
        return model.Unknown(no_value(written or path, time, f"{no_instance(time)}{named}" if exists else f"path not found: {named}"))

    def children(self, prefix: str, hidden: Mapping | None = None, limit: int = 100_000) -> list[str]:
        """Names right below ``prefix``.  They come to the driver, so there is a
        limit; beyond it ``children`` of this module gives them as rows."""
        rows = visible(self.frame)
        if hidden:
            rows = self._newest(below_prefix(rows, prefix), None, hidden)
        found = [r["name"] for r in children(rows, prefix).limit(limit + 1).collect()]
        if len(found) > limit:
            raise ValueError(f"{prefix} has more than {limit} children")
        return sorted(found)

    def record(self, prefix: str, time: model.Time | None = None, limit: int = 10_000, hidden: Mapping | None = None, readable: Callable[[list[str]], set[str]] | None = None):
        """Everything below ``prefix`` as a record, without the paths that are not
        ``readable``; too many nodes are unknown, never cut."""
        below = below_prefix(visible(self.frame), prefix)
        rows = self._newest(below, time, hidden).limit(limit + 1).collect()
        if len(rows) > limit:
            return model.Unknown(f"record at {prefix} exceeds the {limit}-node read limit")
        if readable is not None and rows:
            allowed = readable([row["path"] for row in rows])
            rows = [row for row in rows if row["path"] in allowed]
        if not rows:
            return model.Unknown("not_found")
        out: dict = {}
        for row in sorted(rows, key=lambda r: r["path"]):
            parts = row["path"][len(prefix) + 1 :].split(".")
            if any(p.startswith("@") for p in parts):
                continue
            at = out
            for part in parts[:-1]:
                if not isinstance(at.get(part), dict):
                    at[part] = {}
                at = at[part]
            if not isinstance(at.get(parts[-1]), dict):
                at[parts[-1]] = value_of(row)
        return out

    def purge(self, prefix: str, start: datetime, end: datetime, author: int = 0) -> int:
        """Hide instances and write an audit entry; returns how many."""
        marked = purge(self.frame, prefix, start, end)
        hidden = marked.where("tombstoned").count() - self.frame.where("tombstoned").count()
        self.frame = marked
        now = utc_now()
        self.append([(f"_audit.purge_{int(now.timestamp())}", f"purged {hidden} instances of {prefix}")], author, now)
        return hidden

    def extract(self, prefix: str, hidden: Mapping | None = None, readable: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The subtree's current values as assignment lines; ``readable`` keeps
        the rows whose ``path`` may be read."""
        rows = visible(self.frame).where((F.col("path") == prefix) | F.col("path").startswith(prefix + "."))
        found = self._newest(rows, None, hidden)
        return (readable(found) if readable else found).select(F.concat("path", F.lit(" = "), literal_text()).alias("line"))


def literal_text() -> Column:
    """A log row's value as a literal of the language."""
    from evergrove.functions.columns import number_text, time_text

    quoted = F.concat(F.lit('"'), F.col("v_text"), F.lit('"'))
    return (
        F.when(F.col("kind") == "text", F.when(F.col("v_text").contains('"'), F.concat(F.lit('_"'), F.col("v_text"), F.lit('"_'))).otherwise(quoted))
        .when(F.col("kind") == "number", number_text(F.col("v_num")))
        .when(F.col("kind") == "boolean", F.col("v_bool").cast("string"))
        .when(F.col("kind") == "time", F.concat(F.lit("@"), time_text(F.col("v_time"))))
        .when(F.col("kind") == "money", F.concat(F.lit("¤"), F.format_string("%.2f", "v_money.amount"), F.lit(" "), F.col("v_money.currency")))
        .when(F.col("kind") == "reference", F.concat(F.lit("(link)"), F.col("v_text")))
        .when(F.col("kind") == "nothing", F.lit("nothing"))
        .otherwise(F.col("v_json"))
    )


_FIELDS = [part.strip().split(" ")[0] for part in ("path, ts, seq, author, kind, v_text, v_num, v_bool, v_time, v_money, v_json, tombstoned, stamp").split(",")]


def instances_of(frame: DataFrame, path: Column, ts: str, seq: str, value: str, author: Column | None = None) -> DataFrame:
    """A table's numeric column as log rows."""
    return frame.select(
        path.alias("path"), F.col(ts).alias("ts"), F.col(seq).cast("bigint").alias("seq"), (author if author is not None else F.lit(0)).cast("bigint").alias("author"), F.lit("number").alias("kind"),
        F.lit(None).cast("string").alias("v_text"), F.col(value).cast("double").alias("v_num"), F.lit(None).cast("boolean").alias("v_bool"),
        F.lit(None).cast("struct<ts:timestamp_ntz,prec:tinyint>").alias("v_time"), F.lit(None).cast("struct<amount:double,currency:string>").alias("v_money"), F.lit(None).cast("string").alias("v_json"),
        F.lit(False).alias("tombstoned"), F.create_map().cast("map<string,string>").alias("stamp"),
    )


def exact_time(column: Column) -> Column:
    return time_struct(column, F.lit(model.SUBSECOND))
