"""The reactive layer: atomic ticks, watchers, cascades and rollback.

Two forms with one meaning.  ``Reactor`` runs watcher programs over an engine,
tick by tick.  The functions below it express the same rules as DataFrame
transformations for large batches; ``watch_stream`` feeds either from Structured
Streaming, one micro-batch a tick.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evergrove.functions import model
from evergrove.operators.log import explode_record, newest, numbered
from evergrove.plans.interpreter import MAX_STAGED, Engine, Program, Scope

#: A tick's length and the longest cascade.
TICK_MS = 333
MAX_CASCADE = 1_000


@dataclass
class Watcher:
    name: str
    paths: tuple[str, ...]
    body: tuple
    append: bool = False
    filters: tuple = ()
    binding: str | None = None
    enabled: bool = True

    def touched_by(self, path: str) -> bool:
        return any(path == w or path.startswith(w + ".") for w in self.paths)


@dataclass
class Reactor:
    """Watchers over an engine.  ``changed`` and ``appended`` collect what the next
    tick sees."""

    engine: Engine
    watchers: list[Watcher] = field(default_factory=list)
    changed: dict[str, None] = field(default_factory=dict)
    appended: dict[str, list] = field(default_factory=dict)
    rounds: int = 0
    problems: list[str] = field(default_factory=list)

    def register_all(self) -> None:
        """Take over the watches that programs have defined."""
        for node in self.engine.watches:
            paths = tuple(self.engine.resolve(p) for p in node.paths)
            self.watchers.append(Watcher(node.name or f"watch {len(self.watchers)}", paths, node.body, node.append, node.filters, node.binding))
        self.engine.watches.clear()

    def write(self, source: str):
        """Run a program; what it changes triggers the next tick."""
        result = self.engine.execute(source)
        self.record_changes()
        self.register_all()
        return result

    def record_changes(self) -> None:
        for path in self.engine.last_changes:
            if path not in self.engine.last_quiet:
                self.changed[path] = None

    def append(self, path: str, item) -> None:
        """An item for append watchers; all items of a tick are kept."""
        self.appended.setdefault(self.engine.resolve(path), []).append(item)

    def triggered(self) -> list[tuple[Watcher, dict]]:
        """Every enabled watcher at most once a tick, with its bindings."""
        found = []
        for w in self.watchers:
            if not w.enabled:
                continue
            if not w.append:
                if any(w.touched_by(p) for p in self.changed):
                    found.append((w, {}))
                continue
            items = [item for path, new in self.appended.items() if w.touched_by(path) for item in new if self._passes(w, item)]
            if items:
                found.append((w, {w.binding: items} if w.binding else {}))
        return found

    def _passes(self, watcher: Watcher, item) -> bool:
        program = Program(self.engine)
        program.scope = Scope()
        program.scope.names["item"] = item
        if isinstance(item, dict):
            program.scope.names.update(item)
        return all(model.truthy(program.value(f)) for f in watcher.filters)

    def tick(self) -> list[str]:
        """One atomic tick: all triggered watchers run over the state before it,
        none sees another's writes; these are merged and committed together, of
        two to one path the later watcher's.  If one returns an unknown, nothing
        is written and the changes stay for the next tick."""
        ready = self.triggered()
        staged: dict[str, tuple[object, bool]] = {}
        for watcher, bindings in ready:
            program = Program(self.engine)
            program.scope.names.update(bindings)
            result = program.block(watcher.body)
            if isinstance(result, model.Unknown):
                self.problems.append(f"{watcher.name}: {result.reason}")
                return []
            staged |= program.staged
        self.changed, self.appended = {}, {}
        done = self.engine.log.append([(p, v) for p, (v, _) in staged.items()], self.engine.agent)
        for path in done:
            if not staged[path][1]:
                self.changed[path] = None
        return [w.name for w, _ in ready]

    def feed(self, writes: Sequence[tuple[str, object]]) -> int:
        """Changes from outside, as one commit; the ticks that settle them."""
        for path in self.engine.log.append([(self.engine.resolve(p), v) for p, v in writes], self.engine.agent, stamp=self.engine.stamp):
            self.changed[path] = None
        return self.settle()

    def settle(self) -> int:
        """Ticks until nothing is triggered; a cascade takes a tick per link."""
        self.rounds = 0
        while self.triggered():
            self.rounds += 1
            if self.rounds > MAX_CASCADE:
                self.problems.append(f"cascade exceeded {MAX_CASCADE} rounds: {', '.join(sorted(self.changed))}")
                break
            if not self.tick():
                break
        return self.rounds


# --- the same rules over DataFrames ------------------------------------------------


def tick_of(ts: Column, length_ms: int = TICK_MS) -> Column:
    """The number of the tick that an instant falls into."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(length_ms * 1000)).cast("long")


def last_per_tick(changes: DataFrame, keys: Sequence[str], ts: str = "ts", seq: str = "seq", length_ms: int = TICK_MS) -> DataFrame:
    """The last write of every key in every tick."""
    ticked = changes.withColumn("tick", tick_of(F.col(ts), length_ms))
    rest = [c for c in ticked.columns if c not in (*keys, "tick")]
    return newest(ticked, ["tick", *keys], ts, seq).select("tick", *keys, *rest)


def triggers(changes: DataFrame, registry: DataFrame, path: str = "path") -> DataFrame:
    """(tick, name): watchers whose path, or one below it, changed in a tick.

    ``registry`` (name, watching, enabled).  A changed path is exploded into
    itself and its ancestors, joined on equality (no prefix join) to the registry,
    which is small, and only what was watched is made distinct.
    """
    parts = F.split(F.col(path), "\\.")
    upward = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    touched = changes.select("tick", F.explode(upward).alias("ancestor"))
    watching = registry.where("enabled").select("name", F.explode("watching").alias("watched"))
    return touched.join(watching, F.col("ancestor") == F.col("watched")).select("tick", "name").distinct()


def appended_items(changes: DataFrame, predicate: Column, item: Column, keys: Sequence[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Per tick and key, the appended items that pass, in order of arrival."""
    passing = changes.where(predicate).groupBy("tick", *keys).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"), item.alias("item")))).alias("__items"))
    return passing.withColumn("items", F.transform("__items", lambda x: x["item"])).drop("__items")


def rolled_back(changes: DataFrame, failed: Column) -> DataFrame:
    """Changes of the ticks in which nothing failed."""
    bad = changes.where(failed).select(F.col("tick").alias("bad_tick")).distinct()
    return changes.join(bad, F.col("tick") == F.col("bad_tick"), "left_anti")


def running_count(rows: DataFrame, keys: Sequence[str], ts: str = "ts", seq: str = "seq", ranges: int | None = None) -> DataFrame:
    """Every instance with how many its key has had so far.

    A few keys may hold all rows, so a key's history is cut into ranges of time:
    a count per range, the sum of the ranges before, and a window inside each
    range.
    """
    return numbered(rows, keys, ts, seq, ranges or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "running")


def cascade(changes: DataFrame, links: Sequence[tuple[Callable[[DataFrame], DataFrame], str]], rounds: int = MAX_CASCADE) -> DataFrame:
    """A chain of watchers, one link a tick: every link maps the changes of the
    tick before to new changes.  Returns all changes with ``round``."""
    now, found = changes, changes.withColumn("round", F.lit(0))
    for k, (link, _) in enumerate(links[:rounds], 1):
        now = link(now).withColumn("tick", F.col("tick") + 1)
        found = found.unionByName(now.withColumn("round", F.lit(k)), allowMissingColumns=True)
    return found


def subscribers(changes: DataFrame, subscriptions: DataFrame, path: str = "path") -> DataFrame:
    """Changes fanned out to the subscribers of their path."""
    return changes.join(subscriptions.select(F.col("path").alias("subscribed"), "subscriber"), F.col(path) == F.col("subscribed")).drop("subscribed")


# --- streaming ----------------------------------------------------------------------


def watch_stream(stream: DataFrame, on_tick: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Every micro-batch is a tick.  An exception in ``on_tick`` fails the batch,
    which the stream runs again from its checkpoint: the tick is rolled back."""
    writer = stream.writeStream.foreachBatch(on_tick).option("checkpointLocation", checkpoint)
    trigger = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{TICK_MS} milliseconds")
    return trigger.start()


def tick_stream(
    stream: DataFrame, folder: str, checkpoint: str, registry: DataFrame | None = None, failed: Column | None = None,
    links: Sequence[tuple[Callable[[DataFrame], DataFrame], str]] = (), path: str = "path", available_now: bool = False,
) -> StreamingQuery:
    """Ticks over a stream of changes: a micro-batch whose rows ``failed`` nowhere
    is committed with what it cascades to over ``links`` (``folder``/changes, with
    ``tick`` and ``round``), and the watchers of ``registry`` that it triggers
    (``folder``/triggered).

    A micro-batch writes folders of its own, by its number, and overwrites them
    when it runs again, so a tick that was interrupted is there once or not at all.
    """

    def on_tick(batch: DataFrame, number: int) -> None:
        ticked = batch.withColumn("tick", F.lit(number).cast("long")).persist()
        try:
            kept = rolled_back(ticked, failed) if failed is not None else ticked
            changes = cascade(kept, links)
            changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
            if registry is not None:
                triggers(changes, registry, path).write.mode("overwrite").parquet(f"{folder}/triggered/batch={number}")
        finally:
            ticked.unpersist()

    return watch_stream(stream, on_tick, checkpoint, available_now)


def react_stream(stream: DataFrame, reactor: Reactor, checkpoint: str, path: str = "path", value: str = "value", available_now: bool = False) -> StreamingQuery:
    """A reactor's ticks from a stream of (path, value): each micro-batch is
    written as one commit and then settled.  Programs run on the driver, so a
    micro-batch may have as many changes as a program may stage."""

    def on_tick(batch: DataFrame, number: int) -> None:
        del number
        rows = batch.select(path, value).limit(MAX_STAGED + 1).collect()
        if len(rows) > MAX_STAGED:
            raise ValueError(f"more than {MAX_STAGED} changes in a tick: limit the stream's batches")
        reactor.feed([(row[path], row[value]) for row in rows])

    return watch_stream(stream, on_tick, checkpoint, available_now)


def latest_per_stream(batch: DataFrame, stream: str, ts: str, seq: str) -> DataFrame:
    """What a push channel sends for a tick: the last value of every stream."""
    return newest(batch, [stream], ts, seq)


def changed_values(stream: DataFrame, key: str, value: str, ts: str, seq: str, watermark: str | None = None) -> DataFrame:
    """Unchanged-write suppression on a stream: a key's value passes only if it
    differs from the key's value before, across batches.

    With ``watermark`` (an interval, '10 minutes') a key whose last instance lies
    behind it is forgotten, so that state does not grow with the keys ever seen;
    its next value passes as a first one.  Without it nothing is forgotten.
    """
    import pandas as pd

    columns = stream.columns
    out = stream.select(*columns).schema
    marked = stream.withWatermark(ts, watermark) if watermark else stream

    def compare(keys, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values([ts, seq])
        own = rows[value].astype(object).where(rows[value].notna(), None).map(lambda v: None if v is None else str(v))
        before = own.shift(1, fill_value=state.get[0] if state.exists else None)
        same = (own == before) | (own.isna() & before.isna())
        if not state.exists:
            same.iloc[0] = False
        state.update((own.iloc[-1],))
        if watermark:
            last = int(rows[ts].max().timestamp() * 1000) + 1
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[~same.to_numpy(), columns]

    return marked.groupBy(key).applyInPandasWithState(compare, out, "last string", "append", "EventTimeTimeout" if watermark else "NoTimeout")


REQUESTS = "my.computer.network.web.requests"


def request_records(requests: DataFrame, id_column: str, url_column: str) -> DataFrame:
    """Inbound requests as fields of ``my.computer.network.web.requests.<id>``:
    (path, name, value) rows that a tick can append.  Works on streams, too."""
    url = F.col(url_column)
    fields = requests.select(
        F.col(id_column), F.lit("GET").alias("method"), F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("route")
    )
    return explode_record(fields, REQUESTS, id_column, ["method", "host", "route"])


def windowed(stream: DataFrame, ts: str, length: str, keys: Sequence[str], late: str = "10 minutes", **aggregates: Column) -> DataFrame:
    """Event-time windows with a watermark (an extension: ticks have none)."""
    marked = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return marked.groupBy(F.window(ts, length), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def due(now: datetime, length_ms: int = TICK_MS) -> int:
    """The tick that ``now`` falls into."""
    return int((now - datetime(1970, 1, 1)).total_seconds() * 1000 // length_ms)


