"""Programs: statements on the driver, reads batched into scans, writes staged
and committed as one append, collections left lazy as DataFrames."""

from __future__ import annotations

import math
import random
import secrets
import uuid as _uuid
from calendar import monthrange
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrove.functions import model
from evergrove.functions.model import Unknown
from evergrove.functions.paths import resolve
from evergrove.operators import log as L
from evergrove.operators.collections import Collection
from evergrove.operators.templates import heritage
from evergrove.operators.visibility import hide, parse_filter
from evergrove.plans import syntax as S
from evergrove.plans.compiler import Row, apply_bracket, is_predicate
from evergrove.plans.parser import parse, parse_expression
from evergrove.sources import library, web

#: The limits of a program.
MAX_LOOP, MAX_CALLS, MAX_STAGED = 100_000, 1_000, 10_000
#: A program whose result is unknown for one of these reasons
#: writes nothing.
ROLLBACK_REASONS = (
    "commit buffer exceeded", "commit failed", "failed to read path", "failed to write path", "storage error", "parse error", "interpreter error",
    "unknown function", "undefined_function", "unsupported statement type", "unsupported expression type",
)
CASCADE = "@cascade"


class _Signal(Exception):
    pass


class _Return(_Signal):
    def __init__(self, value):
        self.value = value


class _Break(_Signal):
    pass


@dataclass
class Closure:
    procedure: S.Procedure
    scope: Scope


class Scope:
    def __init__(self, parent: Scope | None = None):
        self.parent, self.names = parent, {}

    def holder(self, name: str) -> Scope | None:
        scope = self
        while scope is not None and name not in scope.names:
            scope = scope.parent
        return scope

    def get(self, name: str):
        holder = self.holder(name)
        return holder.names[name] if holder else None


class Engine:
    """Mounts, an instance log, and programs over both."""

    def __init__(self, spark: SparkSession, log: L.InstanceLog | None = None, agent: int = 0, may: Callable[[str, str], bool] | None = None, stamp: dict[str, str] | None = None, view: dict | None = None):
        """``may(permission, path)`` is asked before every read and write; its
        attribute ``many(permission, paths)``, if it has one, answers for many at
        once.  ``view`` is a filter record: instances and mounted rows whose stamp
        it matches are hidden from every read."""
        self.spark, self.agent = spark, agent
        self.hidden = parse_filter(view) if view else None
        #: what every written instance carries; its author is always part of it
        self.stamp = {**(stamp or {}), "@author": str(agent)}
        self.log = log if log is not None else L.InstanceLog(spark)
        self.mounts: dict[str, Collection] = {}
        self.watches: list[S.Watch] = []
        self.bridges: dict[str, Engine] = {}
        self.open = may is None
        self.last_changes: list[str] = []
        self.last_quiet: set[str] = set()
        self.may = may or (lambda permission, path: True)

    def mount(self, path: str, frame: DataFrame, key: str | None = None, ts: str | None = None, seq: str | None = None) -> None:
        self.mounts[path] = Collection(frame, key, ts, seq)

    def bridge(self, name: str, other: Engine) -> None:
        """Make another engine's tree readable as ``my.<name>.world...``."""
        self.bridges[name] = other

    def resolve(self, path: str) -> str:
        return resolve(path, self.agent)

    # --- single calls, each checked for its permission

    def readable(self, paths: Sequence[str]) -> set[str]:
        """Those of ``paths`` that may be read."""
        if self.open:
            return set(paths)
        many = getattr(self.may, "many", None)
        return many("read", paths) if many else {path for path in paths if self.may("read", path)}

    def _readable_rows(self, rows: DataFrame) -> DataFrame:
        """Rows whose ``path`` may be read.  Paths are asked for on the driver, as
        many as a record may have."""
        paths = [row["path"] for row in rows.select("path").distinct().limit(MAX_STAGED + 1).collect()]
        if len(paths) > MAX_STAGED:
            raise PermissionError(f"more than {MAX_STAGED} paths to ask for: name a smaller part")
        allowed = self.spark.createDataFrame([(p,) for p in self.readable(paths)], "allowed string")
        return rows.join(allowed, F.col("path") == F.col("allowed"), "left_semi")

    def collection(self, path: str) -> Collection | None:
        """A mounted collection as this engine's viewer sees it."""
        found = self.mounts.get(path)
        if found is None or not self.hidden or "stamp" not in found.frame.columns:
            return found
        return replace(found.now(), frame=hide(found.rows, F.col("stamp"), self.hidden))

    def record(self, path: str, time: model.Time | None = None):
        return self.log.record(path, time, hidden=self.hidden, readable=None if self.open else self.readable)

    def read(self, path: str, time: model.Time | None = None):
        path, written = self.resolve(path), path
        return self.log.read(path, time, self.hidden, written) if self.may("read", path) else Unknown("permission denied")

    def write(self, path: str, value) -> bool:
        """Whether the value was new."""
        path = self.resolve(path)
        if not self.may("write", path):
            raise PermissionError(path)
        return bool(self.log.append([(path, value)], self.agent, stamp=self.stamp))

    def children(self, path: str) -> list[str]:
        """Names of the children that may be read."""
        path = self.resolve(path)
        if not self.may("read", path):
            return []
        names = self.log.children(path, self.hidden)
        allowed = self.readable([f"{path}.{name}" for name in names])
        return [name for name in names if f"{path}.{name}" in allowed]

    def purge(self, path: str, start, end) -> int:
        path = self.resolve(path)
        if not self.may("purge", path):
            raise PermissionError(path)
        return self.log.purge(path, start, end, self.agent)

    def extract(self, path: str) -> DataFrame:
        """The subtree's current values as a program that writes them again; what
        may not be read is left out."""
        path = self.resolve(path)
        if not self.may("read", path):
            raise PermissionError(path)
        return self.log.extract(path, self.hidden, None if self.open else self._readable_rows)

    def status(self) -> dict:
        """What the tree holds, in one pass over the log."""
        row = self.log.frame.agg(F.count("*").alias("instances"), F.count_if(~F.coalesce("tombstoned", F.lit(False))).alias("visible"), F.count_distinct("path").alias("paths"), F.max("ts").alias("last")).first()
        found = {"agent": float(self.agent), "instances": float(row["instances"]), "visible": float(row["visible"]), "paths": float(row["paths"]), "mounts": float(len(self.mounts)), "watches": float(len(self.watches))}
        return found | ({"last": model.Time(row["last"])} if row["last"] is not None else {})

    def compact(self, folder: str) -> dict:
        """The log's visible instances in new files, and how many rows went."""
        stats = L.compaction_stats(self.log.frame).first()
        L.compact(self.log.frame, folder)
        return {name: float(stats[name]) for name in ("before", "after", "dropped")}

    def query(self, text: str) -> DataFrame:
        """An expression over a mounted collection as a DataFrame."""
        result = Program(self).value(parse_expression(text))
        if isinstance(result, Collection):
            return result.rows
        if isinstance(result, DataFrame):
            return result
        raise ValueError(f"not a collection: {model.to_text(result)}")

    def execute(self, source: str):
        """Run a program: its last value.  Writes are committed together, or not
        at all if the result is unknown for a reason that rolls back."""
        try:
            tree = parse(source)
        except ValueError as error:
            return Unknown(f"parse error: {error}")
        return self.run(tree.statements)

    def run(self, statements, bindings: dict | None = None):
        program = Program(self)
        program.scope.names.update(bindings or {})
        try:
            result = program.block(statements)
        except _Return as signal:
            result = signal.value
        except _Break:
            result = None
        self.last_changes, self.last_quiet = [], set()
        if isinstance(result, Unknown) and any(reason in result.reason for reason in ROLLBACK_REASONS):
            return result
        changed = self.log.append([(p, v) for p, (v, _) in program.staged.items()], self.agent, stamp=self.stamp)
        self.last_changes = changed
        self.last_quiet = {p for p, (_, quiet) in program.staged.items() if quiet}
        return result


class Program:
    def __init__(self, engine: Engine):
        self.engine = engine
        self.scope = Scope()
        self.staged: dict[str, tuple[object, bool]] = {}
        self.base: str | None = None
        self.calls = 0
        self.quiet = False

    # --- statements

    def block(self, statements):
        result = None
        for statement in statements:
            result = self.statement(statement)
            if isinstance(result, Unknown) and not isinstance(statement, S.Assign):
                return result
        return result

    def statement(self, node: S.Node):
        handler = getattr(self, "_" + type(node).__name__.lower(), None) if isinstance(node, _STATEMENTS) else None
        return handler(node) if handler else self.value(node)

    def _assign(self, node: S.Assign):
        if isinstance(node.value, S.Procedure):
            closure = Closure(node.value, self.scope)
            self.scope.names[node.target.dotted()] = closure
            return closure
        if isinstance(node.value, S.Watch):
            return self._watch(node.value)
        value = self.value(node.value)
        if isinstance(value, Unknown):
            return value
        parts = self._names(node.target)
        if isinstance(parts, Unknown):
            return parts
        if len(parts) == 1 and not node.definition:
            holder = self.scope.holder(parts[0]) or self.scope
            holder.names[parts[0]] = value
            return value
        if isinstance(value, Collection):
            return Unknown("a collection cannot be assigned to a path")
        path = self._absolute(parts)
        quiet = self.quiet or "quietly" in node.modifiers
        if not self.engine.may("write", path):
            return Unknown(f"failed to write path {path}: permission denied")
        problem = self._stage(path, value, quiet)
        if problem is None and "cascade" in node.modifiers:
            problem = self._stage(f"{path}.{CASCADE}", "true", quiet)
        marked = [(path, m) for m in node.modifiers] + ([(f"{path}.{name}", m) for name, m, _ in node.value.fields if m] if isinstance(node.value, S.RecordOf) else [])
        for at, modifier in marked:
            rule, default = self._rule(modifier)
            if rule is not None:
                problem = problem or self._stage(f"{at}.@heritability", rule, quiet)
            if default is not None:
                problem = problem or self._stage(f"{at}.@default", default, quiet)
        return value if problem is None else problem

    def _rule(self, modifier: str) -> tuple[str | None, object]:
        """A modifier's rule of inheritance, and what ``reset`` sets, if it says."""
        name, _, rest = modifier.partition(" ")
        if name not in ("copy", "link", "reset", "exclude"):
            return None, None
        default = self.value(parse_expression(rest)) if name == "reset" and rest else None
        return name, None if isinstance(default, Unknown) else default

    def _stage(self, path: str, value, quiet: bool):
        """A record is one write per field."""
        if isinstance(value, dict) and value:
            for name in value:
                if (problem := self._stage(f"{path}.{name}", value[name], quiet)) is not None:
                    return problem
            return None
        if len(self.staged) >= MAX_STAGED and path not in self.staged:
            return Unknown("commit buffer exceeded")
        self.staged[path] = (value, quiet)
        return None

    def _if(self, node: S.If):
        for condition, block in node.branches:
            test = self.value(condition)
            if isinstance(test, Unknown):
                return test
            if model.truthy(test):
                return self.block(block)
        return self.block(node.otherwise)

    def _while(self, node: S.While):
        result = None
        for _ in range(MAX_LOOP):
            test = self.value(node.condition)
            if isinstance(test, Unknown):
                return test
            if not model.truthy(test):
                return result
            try:
                result = self.block(node.body)
            except _Break:
                return None
            if isinstance(result, Unknown):
                return result
        return Unknown(f"loop exceeded {MAX_LOOP} iterations")

    def _for(self, node: S.For):
        items = self.value(node.items)
        if isinstance(items, Unknown):
            return items
        if not isinstance(items, list):
            return Unknown(f"cannot iterate over {model.kind_of(items)}")
        if len(items) > MAX_LOOP:
            return Unknown(f"loop exceeded {MAX_LOOP} iterations")
        result, outer = None, self.scope
        self.scope = Scope(outer)
        try:
            for k, item in enumerate(items):
                self.scope.names[node.name] = item
                if node.index:
                    self.scope.names[node.index] = float(k)
                result = self.block(node.body)
                if isinstance(result, Unknown):
                    return result
        except _Break:
            result = None
        finally:
            self.scope = outer
        return result

    def _consider(self, node: S.Consider):
        subject = self.value(node.subject)
        if isinstance(subject, Unknown):
            return subject
        for case, block in node.cases:
            if model.equal(subject, self.value(case)):
                return self.block(block)
        return self.block(node.default)

    def _catch(self, node: S.Catch):
        result = self.block(node.body)
        if not isinstance(result, Unknown) or not node.handler:
            return result
        outer = self.scope
        self.scope = Scope(outer)
        self.scope.names["reason"] = result.reason
        try:
            return self.block(node.handler)
        finally:
            self.scope = outer

    def _quietly(self, node: S.Quietly):
        before, self.quiet = self.quiet, True
        try:
            return self.block(node.body)
        finally:
            self.quiet = before

    def _scope(self, node: S.Scope):
        self.base = self._absolute(list(node.path.parts))

    def _return(self, node: S.Return):
        raise _Return(self.value(node.value) if node.value is not None else None)

    def _break(self, node: S.Break):
        raise _Break

    def _pass(self, node: S.Pass):
        return None

    def _embed(self, node: S.Embed):
        """The record's fields become names here."""
        record = self.value(node.path)
        if isinstance(record, dict):
            for name, value in record.items():
                self.scope.names.setdefault(name, value)
        return record

    def _watch(self, node: S.Watch):
        self.engine.watches.append(node)
        return node

    # --- paths

    def _names(self, path: S.Path) -> list[str] | Unknown:
        names = []
        for part in path.parts:
            if isinstance(part, str):
                names.append(part)
                continue
            key = self.value(part)
            if not isinstance(key, (str, float, bool)):
                return key if isinstance(key, Unknown) else Unknown(f"cannot use {model.kind_of(key)} as a key")
            names.append(model.to_text(key))
        return names

    def _absolute(self, parts: list[str]) -> str:
        if parts and parts[0] == "":
            return f"{self.base}.{'.'.join(parts[1:])}" if self.base else ".".join(parts[1:])
        return self.engine.resolve(".".join(parts))

    def _path(self, node: S.Path):
        """Variable, then relative to the scope, staged, mounted, stored, a stored
        record, and what an ancestor cascades."""
        names = self._names(node)
        if isinstance(names, Unknown):
            return names
        if (holder := self.scope.holder(names[0])) is not None:
            return self._fields(holder.names[names[0]], names[1:])
        if names[0] == "my" and len(names) > 2 and names[1] in self.engine.bridges and names[2] == "world":
            return Program(self.engine.bridges[names[1]])._path(S.Path(tuple(names[2:])))
        if names[:2] == ["world", "clock"] and len(names) == 3:
            return clock(names[2])
        path = self._absolute(names)
        candidates = [path] if not self.base or path.startswith(self.base) else [f"{self.base}.{path}", path]
        for candidate in candidates:
            found = self._read(candidate)
            if not isinstance(found, Unknown) or found.reason.endswith("permission denied"):
                return found
        if len(names) > 1:  # a field of a mounted row or of a stored record
            above = self._absolute(names[:-1])
            owner = self.engine.collection(above)
            if owner is not None:
                if not self.engine.may("read", above):
                    return Unknown(f"failed to read path {path}: permission denied")
                return owner.select_key(F.lit(names[-1]))
        inherited = self._cascaded(path)
        if inherited is not None:
            return inherited
        return Unknown(f"failed to read path [{' '.join(names)}]: not found") if len(names) > 1 else Unknown("not_found")

    def _read(self, path: str):
        if not self.engine.may("read", path):
            return Unknown(f"failed to read path {path}: permission denied")
        if path in self.staged:
            return self.staged[path][0]
        if path in self.engine.mounts:
            return self.engine.collection(path)
        found = self.engine.log.read(path, hidden=self.engine.hidden)
        if not isinstance(found, Unknown):
            return self._followed(found)
        below = {p[len(path) + 1 :]: v for p, (v, _) in self.staged.items() if p.startswith(path + ".")}
        record = self.engine.record(path)
        if below:
            record = record if isinstance(record, dict) else {}
            for rest, value in below.items():
                at = record
                *inner, last = rest.split(".")
                for name in inner:
                    at = at.setdefault(name, {})
                at[last] = value
        return record

    def _followed(self, value):
        for _ in range(100):
            if not isinstance(value, model.Ref):
                return value
            value = self._read(value.path)
        return Unknown("reference cycle")

    def _cascaded(self, path: str):
        """The nearest ancestor's field of that name, if it is marked to cascade:
        one scan for all ancestors."""
        *above, name = path.split(".")
        ancestors = [".".join([*above[:n], name]) for n in range(len(above), 0, -1)]
        if len(above) < 2:
            ancestors += [f"world.{name}"]
        stored = self.engine.log.read_many([q for p in ancestors for q in (p, f"{p}.{CASCADE}")], hidden=self.engine.hidden)
        allowed = self.engine.readable(ancestors)
        for p in ancestors:
            if p not in allowed:
                continue
            marked = self.staged.get(f"{p}.{CASCADE}", (stored.get(f"{p}.{CASCADE}"), False))[0]
            value = self.staged.get(p, (stored.get(p), False))[0]
            if marked == "true" and value is not None:
                return value
        return None

    def _fields(self, value, names: list[str]):
        for name in names:
            value = self._followed(value)
            if isinstance(value, Unknown):
                return value
            if isinstance(value, Collection):
                value = value.select_key(F.lit(name))
            elif not isinstance(value, dict):
                return Unknown(f"cannot access field '{name}' on {model.kind_of(value)}")
            elif name not in value:
                return Unknown(f"field '{name}' not found in record")
            else:
                value = value[name]
        return value

    # --- expressions

    def value(self, node: S.Node):
        if isinstance(node, S.Literal):
            return node.value
        if isinstance(node, S.UnknownMatch):
            return Unknown("unknown")
        if isinstance(node, S.Path):
            return self._path(node)
        if isinstance(node, S.Link):
            names = self._names(node.path)
            return names if isinstance(names, Unknown) else model.Ref(self._absolute(names))
        if isinstance(node, S.Interpolated):
            return "".join(p if isinstance(p, str) else model.to_text(self.value(p)) for p in node.parts)
        if isinstance(node, S.ListOf):
            items = [self.value(item) for item in node.items]
            return next((v for v in items if isinstance(v, Unknown)), items)
        if isinstance(node, S.RecordOf):
            fields = {name: self.value(v) for name, _, v in node.fields}
            return next((v for v in fields.values() if isinstance(v, Unknown)), fields)
        if isinstance(node, S.Unary):
            return self._unary(node)
        if isinstance(node, S.Binary):
            return self._binary(node)
        if isinstance(node, S.Bracket):
            return self._bracket(node)
        if isinstance(node, S.Projection):
            return self._projection(node)
        if isinstance(node, S.Field):
            return self._fields(self.value(node.base), [node.name])
        if isinstance(node, S.CollectionOp):
            return self._collection_op(node)
        if isinstance(node, S.Call):
            return self._call(node)
        if isinstance(node, S.New):
            return self._new(node)
        if isinstance(node, S.Procedure):
            return Closure(node, self.scope)
        if isinstance(node, S.Watch):
            return self._watch(node)
        return Unknown(f"unsupported expression type: {type(node).__name__}")

    def _unary(self, node: S.Unary):
        v = self.value(node.operand)
        if isinstance(v, Unknown):
            return v
        if node.op == "not":
            return not model.truthy(v)
        if node.op == "-" and isinstance(v, model.Money):
            return model.Money(-v.amount, v.currency)
        x = model.to_number(v)
        return x if isinstance(x, Unknown) or node.op == "+" else -x

    def _binary(self, node: S.Binary):
        a = self.value(node.left)
        if node.op == "?=":
            if isinstance(node.right, S.UnknownMatch):
                return isinstance(a, Unknown)
            b = self.value(node.right)
            if isinstance(b, Unknown):
                return isinstance(a, Unknown) and a.reason == b.reason
            return not isinstance(a, Unknown) and model.equal(a, b)
        b = self.value(node.right)
        if node.op == "&":
            return model.to_text(a) + model.to_text(b)
        for v in (a, b):
            if isinstance(v, Unknown):
                return v
        if node.op == "starts":
            return model.to_text(a).startswith(model.to_text(b))
        if node.op == "and":
            return model.truthy(a) and model.truthy(b)
        if node.op == "or":
            return model.truthy(a) or model.truthy(b)
        if node.op in ("=", "!="):
            return model.equal(a, b) == (node.op == "=")
        if node.op in ("<", ">", "<=", ">="):
            c = model.compare(a, b)
            return False if c is None else {"<": c < 0, ">": c > 0, "<=": c <= 0, ">=": c >= 0}[node.op]
        return model.arithmetic(node.op, a, b)

    def _row(self, collection: Collection | None = None) -> Row:
        def variable(name: str):
            found = self.scope.get(name)
            if found is None and "." in name:
                read = self.value(S.Path(tuple(name.split("."))))
                return None if isinstance(read, Unknown) else read
            return None if isinstance(found, Closure) else found

        procedures, scope = {}, self.scope
        while scope is not None:
            procedures = {n: v.procedure for n, v in scope.names.items() if isinstance(v, Closure)} | procedures
            scope = scope.parent
        return Row(collection, {}, variable, procedures)

    def _bracket(self, node: S.Bracket):
        if isinstance(node.base, S.Path) and len(node.filters) == 1:
            time = self._time(node.filters[0])
            names = self._names(node.base)
            if time is not None and not isinstance(names, Unknown) and self._absolute(names) not in self.engine.mounts and self.scope.holder(names[0]) is None:
                path = self._absolute(names)
                if not self.engine.may("read", path):
                    return Unknown(f"failed to read path {path}: permission denied")
                found = self.engine.log.read(path, time, self.engine.hidden, ".".join(names))
                if isinstance(found, Unknown):
                    record = self.engine.record(path, time)
                    return record if isinstance(record, dict) else found
                return self._followed(found)
        base = self.value(node.base)
        if isinstance(base, Unknown):
            return base
        if isinstance(base, Collection):
            return apply_bracket(base, node, self._row(base))
        if len(node.filters) == 1 and not is_predicate(node.filters[0]):
            return self._selected(base, node.filters[0])
        if isinstance(base, list):
            return self._filtered(enumerate(base), node.filters, lambda kept: [v for _, v in kept])
        if isinstance(base, dict):
            return self._filtered(base.items(), node.filters, dict)
        return Unknown(f"cannot apply bracket filter to {model.kind_of(base)}")

    def _time(self, node: S.Node):
        if isinstance(node, S.Literal):
            return node.value if isinstance(node.value, model.Time) else None
        if isinstance(node, S.Path) and node.plain:
            found = self.scope.get(node.parts[0])
            return found if isinstance(found, model.Time) else None
        return None

    def _selected(self, base, node: S.Node):
        if isinstance(base, dict):
            plain = isinstance(node, S.Path) and node.plain and len(node.parts) == 1 and self.scope.holder(node.parts[0]) is None
            key = node.parts[0] if plain else model.to_text(self.value(node))
            return base[key] if key in base else Unknown(f"field '{key}' not found in record")
        if not isinstance(base, list):
            return Unknown(f"cannot apply bracket filter to {model.kind_of(base)}")
        at = model.to_number(self.value(node))
        if isinstance(at, Unknown):
            return at
        k = math.trunc(at)
        return base[k] if 0 <= k < len(base) else Unknown(f"list index {k} out of bounds (length {len(base)})")

    def _filtered(self, pairs, filters, build):
        """Names inside a filter: ``item`` or ``key``, ``field``, and the entry's
        own fields.  One unknown test makes the whole filter unknown."""
        kept, outer = [], self.scope
        for key, entry in pairs:
            self.scope = Scope(outer)
            self.scope.names.update({"item": entry, "key": key if isinstance(key, str) else float(key), "field": entry})
            if isinstance(entry, dict):
                self.scope.names.update(entry)
            try:
                tests = [self.value(f) for f in filters]
            finally:
                self.scope = outer
            for test in tests:
                if isinstance(test, Unknown):
                    return test
            if all(map(model.truthy, tests)):
                kept.append((key, entry))
        return build(kept)

    def _projection(self, node: S.Projection):
        base = self.value(node.base)
        if isinstance(base, Collection):
            return base.project(node.names, node.excluded)
        if isinstance(base, Unknown):
            return base
        if not isinstance(base, dict):
            return Unknown(f"cannot project {model.kind_of(base)}")
        out = {}
        for name in node.names:
            if name.endswith("*"):
                out |= {k: v for k, v in base.items() if k.startswith(name[:-1])}
            else:
                out[name] = base.get(name, Unknown("not_found"))
        return {k: v for k, v in out.items() if k not in node.excluded}

    def _collection_op(self, node: S.CollectionOp):
        base = self.value(node.base)
        args = [self.value(a) for a in node.args]
        for v in (base, *args):
            if isinstance(v, Unknown):
                return v
        if isinstance(base, Collection):
            return float(base.rows.count()) if node.op == "count" else Unknown(f"..{node.op} is not defined for a collection")
        if node.op == "count":
            return float(len(base)) if isinstance(base, (list, dict)) else Unknown(f"cannot count {model.kind_of(base)}")
        if not isinstance(base, list):
            return Unknown(f"cannot apply ..{node.op} to {model.kind_of(base)}")
        if node.op == "combine":
            return (model.to_text(args[0]) if args else "").join(map(model.to_text, base))
        if node.op == "append":
            return [*base, args[0]]
        if node.op == "prepend":
            return [args[0], *base]
        if len(args) == 2:
            first, last = (math.trunc(model.to_number(a)) for a in args)
            if first < 0 or last >= len(base) or first > last:
                return Unknown(f"invalid range for remove: {first}..{last}")
            return base[:first] + base[last + 1 :]
        return removed(base, args[0])

    def _call(self, node: S.Call):
        closure = self.scope.get(node.name)
        if isinstance(closure, Closure):
            return self._invoke(node.name, closure, [self.value(a) for a in node.args])
        if node.name == "new":
            return self._new(S.New(None, None, node.args))
        args = [self.value(a) for a in node.args]
        if node.name != "is_unknown":
            for v in args:
                if isinstance(v, Unknown):
                    return v
        if node.name in ("map", "filter", "reduce"):
            return self._higher_order(node.name, args)
        if node.name == "sort" and len(args) == 2:
            return _sorted_by(*args)
        if node.name.startswith(web.PREFIX):
            return self._web(node.name[len(web.PREFIX) :], args)
        if node.name.startswith(library.PREFIX):
            return library.call(self.engine.spark, node.name[len(library.PREFIX) :], args)
        function = BUILTINS.get(node.name)
        if function is None:
            return Unknown(f"unknown function: {node.name}")
        try:
            return function(*args)
        except TypeError:
            return Unknown(f"wrong number of arguments for {node.name}")

    def _web(self, name: str, args: list):
        if name in web.METHODS:
            return web.call(name, args)
        if name in ("parse_json", "to_json"):
            return BUILTINS[name](*args) if len(args) == 1 else Unknown(f"wrong number of arguments for {name}")
        if name not in web.ANSWERS:
            return Unknown(f"unknown function: {web.PREFIX}{name}")
        response = web.answer(name, args)
        if isinstance(response, Unknown):
            return response
        path, record = self.engine.resolve(response[0]), response[1]
        if not self.engine.may("write", path):
            return Unknown(f"failed to write path {path}: permission denied")
        return self._stage(path, record, self.quiet) or "response_sent"

    def _invoke(self, name: str, closure: Closure, args: list):
        if len(args) != len(closure.procedure.params):
            return Unknown(f"{name} expects {len(closure.procedure.params)} arguments, got {len(args)}")
        for v in args:
            if isinstance(v, Unknown):
                return v
        if self.calls >= min(MAX_CALLS, 150):
            return Unknown(f"call depth exceeded {MAX_CALLS} (possible infinite recursion in '{name}')")
        outer, self.calls = self.scope, self.calls + 1
        self.scope = Scope(closure.scope)
        self.scope.names.update(zip(closure.procedure.params, args))
        try:
            return self.block(closure.procedure.body)
        except _Return as signal:
            return signal.value
        finally:
            self.scope, self.calls = outer, self.calls - 1

    def _higher_order(self, name: str, args: list):
        items, procedure = args[0], args[1]
        if not isinstance(items, list) or not isinstance(procedure, Closure):
            return Unknown(f"{name} needs a list and a procedure")
        if name == "map":
            return [self._invoke(name, procedure, [x]) for x in items]
        if name == "filter":
            return [x for x in items if model.truthy(self._invoke(name, procedure, [x]))]
        total = args[2]
        for x in items:
            total = self._invoke(name, procedure, [total, x])
        return total

    def _new(self, node: S.New):
        """Fields from one or more sources by their heritability, then props."""
        out: dict = {}
        for source in node.sources:
            record = self.value(source)
            if isinstance(record, Unknown):
                return record
            if not isinstance(record, dict):
                return Unknown(f"cannot create from {model.kind_of(record)}")
            path = self._absolute(list(source.parts)) if isinstance(source, S.Path) else None
            marks = self._marks(path, record) if path else {}
            if isinstance(source, S.RecordOf):
                rules = {name: self._rule(modifier) for name, modifier, _ in source.fields if modifier}
                marks = {name: (rule, default) if rule == "reset" else rule for name, (rule, default) in rules.items() if rule}
            out = heritage(out, record, {k: node.modifier.split(" ")[0] for k in record} if node.modifier else marks, path)
        if node.type_name:
            out["_type"] = node.type_name
        if node.props is not None:
            props = self.value(node.props)
            if isinstance(props, Unknown):
                return props
            out |= props
        return out

    def _marks(self, path: str, record: dict) -> dict:
        """Heritability and defaults of a stored record's fields: one scan."""
        asked = [f"{path}.{name}.{meta}" for name in record for meta in ("@heritability", "@default")]
        stored = self.engine.log.read_many(asked) | {p: v for p, (v, _) in self.staged.items() if p in set(asked)}
        marks: dict = {}
        for name in record:
            rule = stored.get(f"{path}.{name}.@heritability", "copy")
            marks[name] = (rule, stored.get(f"{path}.{name}.@default")) if rule == "reset" else rule
        return marks


_STATEMENTS = (S.Assign, S.If, S.While, S.For, S.Consider, S.Catch, S.Quietly, S.Scope, S.Return, S.Break, S.Pass, S.Embed, S.Watch)


def removed(items: list, x):
    """By index, if ``x`` is a number in range whose element is not ``x``; else
    the first equal element."""
    if model.kind_of(x) == "number":
        k = math.trunc(x)
        if 0 <= k < len(items) and not model.equal(items[k], x):
            return items[:k] + items[k + 1 :]
    for k, item in enumerate(items):
        if model.equal(item, x):
            return items[:k] + items[k + 1 :]
    return list(items)


def _number(function):
    def call(v):
        x = model.to_number(v)
        return x if isinstance(x, Unknown) else float(function(x))

    return call


def _numbers(function):
    def call(*values):
        xs = [model.to_number(v) for v in values]
        return next((x for x in xs if isinstance(x, Unknown)), None) or function(xs)

    return call


def _substring(v, start, length):
    raw = model.to_text(v).encode()
    s, n = math.trunc(model.to_number(start)), math.trunc(model.to_number(length))
    if s < 0 or s >= len(raw) or n < 0:
        return Unknown(f"invalid substring bounds: start={s}, length={n} for string of length {len(raw)}")
    return raw[s : s + n].decode("utf-8", "replace")


def _length(v):
    if isinstance(v, Collection):
        return float(v.rows.count())
    return float(len(v) if isinstance(v, (list, dict)) else len(model.to_text(v).encode()))


def _random(*bounds):
    if not bounds:
        return random.SystemRandom().random()
    low, high = (0, bounds[0]) if len(bounds) == 1 else bounds
    return float(random.SystemRandom().randrange(int(low), int(high)))


def _round(x: float) -> float:
    return math.copysign(math.floor(abs(x) + 0.5), x)


def clock(part: str):
    """A part of the present time; weekdays count from Sunday, 1."""
    now = L.utc_now()
    parts = {
        "year": now.year, "month": now.month, "day": now.day, "hour": now.hour, "minute": now.minute, "second": now.second, "weekday": now.isoweekday() % 7 + 1,
        "week": now.isocalendar().week, "quarter": (now.month + 2) // 3, "unix": int((now - _EPOCH).total_seconds()),
    }
    if part in ("month_name", "weekday_name"):
        return now.strftime("%B" if part == "month_name" else "%A")
    return float(parts[part]) if part in parts else Unknown("not_found")


_EPOCH = datetime(1970, 1, 1)


def _add_time(t, amount, unit):
    """The time moved by an amount of a unit; its precision stays."""
    if not isinstance(t, model.Time):
        return Unknown(f"cannot add to {model.kind_of(t)}")
    name, n = model.to_text(unit).rstrip("s"), model.to_number(amount)
    if isinstance(n, Unknown):
        return n
    if name in ("month", "year"):
        months = t.at.year * 12 + t.at.month - 1 + int(n) * (12 if name == "year" else 1)
        year, month = divmod(months, 12)
        return model.Time(t.at.replace(year=year, month=month + 1, day=min(t.at.day, monthrange(year, month + 1)[1])), t.precision)
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}.get(name)
    return Unknown(f"unknown unit: {name}") if seconds is None else model.Time(t.at + timedelta(seconds=n * seconds), t.precision)


def _convert(v, kind):
    kind = model.to_text(kind)
    made = {"text": model.to_text, "number": model.to_number, "boolean": model.truthy, "time": lambda x: model.parse_time(model.to_text(x))}.get(kind)
    return made(v) if made else Unknown(f"cannot convert to {kind}")


def _place(v):
    """What values are sorted by: their kind, then themselves."""
    return model.kind_of(v), v if isinstance(v, (str, float, bool)) else model.to_text(v)


def _sorted_by(items, key):
    """A collection, or a list of records, by one of its fields; those without
    the field come first."""
    name = model.to_text(key)
    if isinstance(items, Collection):
        current = items.now()
        return replace(current, frame=current.frame.orderBy(name)) if name in current.frame.columns else Unknown(f"field '{name}' not found in record")
    if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
        return Unknown(f"cannot sort {model.kind_of(items)} by a field")
    return sorted(items, key=lambda x: (name in x, _place(x.get(name))))


BUILTINS = {
    "len": _length,
    "length": lambda v: float(len(model.to_text(v))),
    "text": model.to_text,
    "number": model.to_number,
    "add": _numbers(lambda xs: float(sum(xs))),
    "max": _numbers(max),
    "min": _numbers(min),
    "abs": _number(abs),
    "floor": _number(math.floor),
    "ceil": _number(math.ceil),
    "ceiling": _number(math.ceil),
    "round": _number(_round),
    "sqrt": _number(lambda x: math.sqrt(x) if x >= 0 else math.nan),
    "exp": _number(math.exp),
    "log": _number(lambda x: math.log(x) if x > 0 else math.nan),
    "random": _random,
    "upper": lambda v: model.to_text(v).upper(),
    "lower": lambda v: model.to_text(v).lower(),
    "trim": lambda v: model.to_text(v).strip(),
    "substring": _substring,
    "find": lambda v, p: float(model.to_text(v).encode().find(model.to_text(p).encode())),
    "replace": lambda v, a, b: model.to_text(v).replace(model.to_text(a), model.to_text(b)),
    "split": lambda v, s: model.to_text(v).split(model.to_text(s)) if model.to_text(s) else list(model.to_text(v)),
    "parse_json": lambda v: model.parse_json(model.to_text(v)),
    "to_json": model.to_json,
    "parse_time": lambda v: model.parse_time(model.to_text(v)),
    "now": lambda: model.Time(L.utc_now()),
    "add_time": _add_time,
    "format_time": lambda t, form: t.at.strftime(model.to_text(form)) if isinstance(t, model.Time) else Unknown(f"cannot format {model.kind_of(t)}"),
    "convert": _convert,
    "uuid": lambda: str(_uuid.uuid4()),
    "my.computer.crypto.generate_token": lambda: secrets.token_hex(32),
    "unknown": lambda *v: Unknown(model.to_text(v[0]) if v else "unknown"),
    "output": lambda v: v,
    "is_unknown": lambda v: isinstance(v, Unknown),
    "type_of": model.kind_of,
    "sort": lambda v: sorted(v, key=_place),
    "range": lambda a, b: [float(k) for k in range(int(a), int(b) + 1)],
    "asset": lambda data, mime: {"data": data, "mime_type": mime},
}
