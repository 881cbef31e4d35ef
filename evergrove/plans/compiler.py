"""Syntax trees in row context to cells, and over collections to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import functions as F

from evergrove.functions import columns as C
from evergrove.functions import model
from evergrove.functions.columns import Cell
from evergrove.operators.collections import Collection
from evergrove.plans import syntax as S


class CompileProblem(ValueError):
    pass


@dataclass(frozen=True)
class Row:
    """What names mean inside an expression: the element at hand (``item``), the
    row's fields, then variables."""

    collection: Collection | None = None
    names: Mapping[str, Cell] = field(default_factory=dict)
    variable: Callable[[str], object] | None = None
    procedures: Mapping[str, S.Procedure] = field(default_factory=dict)

    def bind(self, **names: Cell) -> Row:
        return replace(self, names={**self.names, **names})

    def find(self, name: str) -> Cell | None:
        if name in self.names:
            return self.names[name]
        found = self.collection.cell(name) if self.collection is not None else None
        if found is None and self.variable is not None:
            value = self.variable(name)
            if value is not None and not isinstance(value, Collection):
                return C.literal(value)
        return found


COMPARISONS = ("<", ">", "<=", ">=", "=", "!=")


def compile_row(node: S.Node, row: Row) -> Cell:
    if isinstance(node, S.Literal):
        return C.literal(node.value)
    if isinstance(node, S.UnknownMatch):
        return C.literal(model.Unknown("unknown"))
    if isinstance(node, S.Path):
        return _path(node, row)
    if isinstance(node, S.Link):
        return Cell(F.lit(node.path.dotted()), "reference")
    if isinstance(node, S.Interpolated):
        texts = [C.literal(p) if isinstance(p, str) else compile_row(p, row) for p in node.parts]
        return Cell(F.concat(*[C.to_text(t).value for t in texts]) if texts else F.lit(""), "text")
    if isinstance(node, S.Unary):
        operand = compile_row(node.operand, row)
        return {"not": C.negation, "-": C.minus, "+": C.to_number}[node.op](operand)
    if isinstance(node, S.Binary):
        return _binary(node, row)
    if isinstance(node, S.ListOf):
        cells = [compile_row(item, row) for item in node.items]
        kinds = {c.kind for c in cells}
        if len(kinds) > 1:
            cells = [Cell(C.to_text(c).value, "text", c.reason) for c in cells]
        return C.guarded(Cell(F.array(*[c.value for c in cells]), "list", C.first_reason(*[c.reason for c in cells]), cells[0].kind if cells else "text"))
    if isinstance(node, S.RecordOf):
        cells = {name: compile_row(value, row) for name, _, value in node.fields}
        return C.guarded(Cell(F.struct(*[c.value.alias(name) for name, c in sorted(cells.items())]), "record", C.first_reason(*[c.reason for c in cells.values()])))
    if isinstance(node, S.Bracket):
        return _bracket(node, row)
    if isinstance(node, S.CollectionOp):
        return _collection_op(node, row)
    if isinstance(node, S.Field):
        return _member(compile_row(node.base, row), node.name)
    if isinstance(node, S.Call):
        return _call(node, row)
    raise CompileProblem(f"unsupported expression type: {type(node).__name__}")


def _path(node: S.Path, row: Row) -> Cell:
    if not node.plain:
        raise CompileProblem("computed path parts are not allowed in row context")
    first, *rest = node.parts
    if node.parts[:2] == ("world", "clock") and len(node.parts) == 3:
        return C.clock_part(node.parts[2])
    cell = row.find(first)
    if cell is None and row.variable is not None:
        value = row.variable(node.dotted())
        if value is not None and not isinstance(value, Collection):
            return C.literal(value)
    if cell is None:
        return C.literal(model.Unknown("not_found"))
    if rest and row.collection is not None and first in row.collection.frame.columns and cell.kind != "map":
        frame = row.collection.frame.select(F.col(".".join(f"`{p}`" for p in node.parts)).alias("x"))
        return C.cell_of(F.col(".".join(f"`{p}`" for p in node.parts)), frame.schema["x"].dataType)
    for name in rest:
        cell = _member(cell, name)
    return cell


def _member(cell: Cell, name: str) -> Cell:
    """A field; of a stamp or another map, a missing entry is nothing."""
    if cell.kind == "map":
        return Cell(F.try_element_at(cell.value, F.lit(name)), cell.item or "text", cell.reason)
    return Cell(cell.value[name], "anything", cell.reason)


def _binary(node: S.Binary, row: Row) -> Cell:
    if node.op == "?=" and isinstance(node.right, S.UnknownMatch):
        return C.definite_equal(compile_row(node.left, row), C.literal(None), "*")
    if node.op == "?=" and isinstance(node.right, S.Call) and node.right.name == "unknown" and len(node.right.args) == 1 and isinstance(node.right.args[0], S.Literal):
        return C.definite_equal(compile_row(node.left, row), C.literal(None), model.to_text(node.right.args[0].value))
    left, right = compile_row(node.left, row), compile_row(node.right, row)
    if node.op in COMPARISONS:
        return C.compare(node.op, left, right)
    if node.op == "?=":
        return C.definite_equal(left, right)
    if node.op == "starts":
        return C.starts(left, right)
    if node.op == "and":
        return C.both(left, right)
    if node.op == "or":
        return C.either(left, right)
    if node.op == "&":
        return C.concat(left, right)
    return C.arithmetic(node.op, left, right)


def _bracket(node: S.Bracket, row: Row) -> Cell:
    base = compile_row(node.base, row)
    if base.kind != "list":
        return Cell(F.lit(None).cast("string"), "unknown", C.first_reason(base.reason, F.lit(f"cannot apply bracket filter to {base.kind}")))
    if len(node.filters) == 1 and not is_predicate(node.filters[0]):
        return C.index(base, C.to_number(compile_row(node.filters[0], row)))

    def keep(x):
        element = Cell(x.cast("double") if base.item == "number" else x, base.item or "text")
        inner = row.bind(item=element)
        test = F.lit(True)
        for f in node.filters:
            test = test & C.truthy(compile_row(f, inner))
        return test

    return Cell(F.filter(base.value, keep), "list", base.reason, base.item)


def _collection_op(node: S.CollectionOp, row: Row) -> Cell:
    if node.op == "count" and isinstance(node.base, S.Call) and node.base.name == "split" and len(node.base.args) == 2 and node.base.name not in row.procedures:
        text, separator = (compile_row(a, row) for a in node.base.args)
        if isinstance(separator.constant, str) and separator.constant:
            return C.split_count(text, separator.constant)
    base = compile_row(node.base, row)
    args = [compile_row(a, row) for a in node.args]
    if node.op == "count":
        return Cell(F.size(base.value).cast("double"), "number", base.reason)
    if node.op == "combine":
        return C.combine(base, args[0] if args else C.literal(""))
    if node.op == "append":
        return C.append(base, args[0])
    if node.op == "prepend":
        return C.prepend(base, args[0])
    return C.remove_range(base, *args) if len(args) == 2 else C.remove(base, args[0])


def _call(node: S.Call, row: Row) -> Cell:
    if node.name in row.procedures:
        procedure = row.procedures[node.name]
        if len(procedure.params) != len(node.args):
            raise CompileProblem(f"{node.name} expects {len(procedure.params)} arguments")
        bound = {p: compile_row(a, row) for p, a in zip(procedure.params, node.args)}
        return inline(procedure.body, row.bind(**bound))
    if node.name == "parse_json":
        return Cell(F.try_parse_json(compile_row(node.args[0], row).value), "anything")
    if node.name == "to_json":
        return C.json_text(compile_row(node.args[0], row))
    if node.name in ("map", "filter", "sort", "reduce"):
        return _higher_order(node, row)
    if node.name == "range":
        low, high = (C.to_number(compile_row(a, row)) for a in node.args)
        return Cell(F.transform(F.sequence(low.value.cast("long"), high.value.cast("long")), lambda x: x.cast("double")), "list", C.first_reason(low.reason, high.reason), "number")
    function = C.FUNCTIONS.get(node.name)
    if function is None:
        return C.literal(model.Unknown(f"unknown function: {node.name}"))
    return function(*[compile_row(a, row) for a in node.args])


def _higher_order(node: S.Call, row: Row) -> Cell:
    """map, filter, sort and reduce over a list, with a procedure or its name."""
    base = compile_row(node.args[0], row)
    if node.name == "sort":
        if len(node.args) == 1:
            return Cell(F.array_sort(base.value), "list", base.reason, base.item)
        name = compile_row(node.args[1], row).constant
        order = lambda a, b: F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(0)
        return Cell(F.array_sort(base.value, order), "list", base.reason, base.item)
    given = node.args[1]
    procedure = given if isinstance(given, S.Procedure) else row.procedures[given.dotted()]
    element = lambda x: Cell(x.cast("double") if base.item == "number" else x, base.item or "text")
    call = lambda *cells: inline(procedure.body, row.bind(**dict(zip(procedure.params, cells))))
    if node.name == "filter":
        return Cell(F.filter(base.value, lambda x: C.truthy(call(element(x)))), "list", base.reason, base.item)
    if node.name == "map":
        kind = call(element(F.lit(None).cast("double" if base.item == "number" else "string"))).kind
        return Cell(F.transform(base.value, lambda x: call(element(x)).value), "list", base.reason, kind)
    start = compile_row(node.args[2], row)
    return Cell(F.aggregate(base.value, start.value, lambda acc, x: call(Cell(acc, start.kind), element(x)).value), start.kind, base.reason)


def inline(body: tuple, row: Row) -> Cell:
    """A pure procedure as one expression: assignments to its own names, if,
    loops over lists that change such names, and return."""
    for k, statement in enumerate(body):
        if isinstance(statement, S.Return):
            return compile_row(statement.value, row) if statement.value is not None else C.literal(None)
        if isinstance(statement, S.Assign) and len(statement.target.parts) == 1:
            row = row.bind(**{statement.target.parts[0]: compile_row(statement.value, row)})
        elif isinstance(statement, S.For):
            row = _looped(statement, row)
        elif isinstance(statement, S.Pass):
            continue
        elif isinstance(statement, S.If):
            rest = body[k + 1 :]
            result = inline((*statement.otherwise, *rest), row)
            for condition, block in reversed(statement.branches):
                test = compile_row(condition, row)
                yes = inline((*block, *rest), row)
                value = F.when(C.truthy(test), yes.value).otherwise(result.value)
                reason = C.first_reason(test.reason, F.when(C.truthy(test), yes.why).otherwise(result.why))
                result = C.guarded(Cell(value, yes.kind, reason, yes.item))
            return result
        elif isinstance(statement, S.Node) and k == len(body) - 1 and not isinstance(statement, (S.While, S.For, S.Assign)):
            return compile_row(statement, row)
        else:
            raise CompileProblem("only pure procedures can run inside a query")
    return C.literal(None)


def _looped(loop: S.For, row: Row) -> Row:
    """``row`` after a loop: one aggregate over the list, whose state holds the
    names that the body changes, each with its reason.  They must have a value
    before the loop, of the kind that they keep."""
    items = compile_row(loop.items, row)
    if items.kind != "list":
        raise CompileProblem(f"cannot iterate over {items.kind}")
    names = sorted(_assigned(loop.body) - {loop.name, loop.index})
    if unbound := [n for n in names if row.find(n) is None]:
        raise CompileProblem(f"{unbound[0]} has no value before the loop")
    before = {n: row.find(n) for n in names}
    no_reason = F.lit(None).cast("string")
    packed = lambda cells: F.struct(*[c for n in names for c in (cells[n].value.alias(n), F.coalesce(cells[n].reason if cells[n].reason is not None else no_reason, no_reason).alias(f"{n} reason"))])
    opened = lambda state: {n: Cell(state[n], before[n].kind, state[f"{n} reason"], before[n].item) for n in names}

    def step(state, pair):
        inner = row.bind(**opened(state))
        element = Cell(pair["item"].cast("double") if items.item == "number" else pair["item"], items.item or "text")
        inner = inner.bind(**{loop.name: element}, **({loop.index: Cell(pair["at"].cast("double"), "number")} if loop.index else {}))
        after = _effects(loop.body, inner)
        for n in names:
            if after.find(n).kind != before[n].kind:
                raise CompileProblem(f"{n} changes from {before[n].kind} to {after.find(n).kind} in a loop")
        return packed({n: after.find(n) for n in names})

    if not names:
        return row
    pairs = F.transform(items.value, lambda item, at: F.struct(item.alias("item"), at.alias("at")))
    state = F.aggregate(pairs, packed(before), step)
    return row.bind(**{n: replace(c, reason=C.first_reason(items.reason, c.reason)) for n, c in opened(state).items()})


def _assigned(body: tuple) -> set[str]:
    """The plain names that statements assign to."""
    names: set[str] = set()
    for statement in body:
        if isinstance(statement, S.Assign) and len(statement.target.parts) == 1:
            names.add(statement.target.parts[0])
        elif isinstance(statement, S.If):
            for block in (*[b for _, b in statement.branches], statement.otherwise):
                names |= _assigned(block)
        elif isinstance(statement, S.For):
            names |= _assigned(statement.body) - {statement.name, statement.index}
    return names


def _effects(body: tuple, row: Row) -> Row:
    """``row`` after statements that only change names."""
    for statement in body:
        if isinstance(statement, S.Assign) and len(statement.target.parts) == 1:
            row = row.bind(**{statement.target.parts[0]: compile_row(statement.value, row)})
        elif isinstance(statement, S.For):
            row = _looped(statement, row)
        elif isinstance(statement, S.If):
            names = sorted(_assigned((statement,)))
            if unbound := [n for n in names if row.find(n) is None]:
                raise CompileProblem(f"{unbound[0]} has no value before the condition")
            found = _effects(statement.otherwise, row)
            found = {n: found.find(n) for n in names}
            for condition, block in reversed(statement.branches):
                test, yes = compile_row(condition, row), _effects(block, row)
                taken = C.truthy(test)
                # an unknown condition makes what it decides unknown
                found = {
                    n: Cell(F.when(taken, yes.find(n).value).otherwise(c.value), c.kind, C.first_reason(test.reason, F.when(taken, yes.find(n).why).otherwise(c.why)), c.item) for n, c in found.items()
                }
            row = row.bind(**{n: C.guarded(c) for n, c in found.items()})
        elif not isinstance(statement, S.Pass):
            raise CompileProblem("only pure procedures can run inside a query")
    return row


def is_predicate(node: S.Node) -> bool:
    """Whether a bracket's content is a test rather than a key or an index."""
    if isinstance(node, S.Binary):
        return node.op in (*COMPARISONS, "?=", "starts", "and", "or")
    return isinstance(node, S.Unary) and node.op == "not" or isinstance(node, S.Call)


def apply_bracket(base: Collection, node: S.Bracket, row: Row) -> Collection:
    """Time, then key, then filters: the order in which a bracket is understood."""
    first = node.filters[0]
    if len(node.filters) == 1:
        if isinstance(first, S.Literal) and isinstance(first.value, model.Time):
            return base.as_of(first.value)
        if isinstance(first, S.Binary) and first.left == S.Path(("@",)) or _is_range(node):
            return _ranged(base, node)
        if not is_predicate(first):
            named = first.parts[0] if isinstance(first, S.Path) and first.plain and len(first.parts) == 1 else None
            column = base.cell(named) if named else None
            if column is None or column.kind != "boolean":
                if isinstance(first, S.Path) and named and column is None and (row.variable is None or row.variable(named) is None):
                    return base.select_key(F.lit(named))
                value = row.variable(named) if named and row.variable is not None else None
                if isinstance(value, model.Time):
                    return base.as_of(value)
                return base.select_key(_key_text(compile_row(first, row)))
    if _is_range(node):
        return _ranged(base, node)
    current = base.now()
    inner = replace(row, collection=current)
    return current.filter(*[compile_row(f, inner) for f in node.filters])


def _key_text(cell: Cell):
    return C.to_text(cell).value


def _is_range(node: S.Bracket) -> bool:
    """[@ >= a, @ < b]: history between two times."""
    return all(isinstance(f, S.Binary) and f.op in (">=", "<") and f.left == S.Path(("@",)) for f in node.filters)


def _ranged(base: Collection, node: S.Bracket) -> Collection:
    from evergrove.operators.log import history_range

    limits = {f.op: f.right.value for f in node.filters}
    return Collection(history_range(base.frame, limits.get(">="), limits.get("<"), base.ts))
