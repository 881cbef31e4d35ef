"""The value semantics over Spark columns.

SQL has one NULL; the engine tells *nothing* from *unknown, because ...*.  So an
expression is a ``Cell``: a value column, a reason column (null when the value
is known) and the value's kind, which is fixed when the expression is built.
Reasons that a query does not select are pruned by Catalyst.  Every operation
that ANSI mode could raise on is the ``try_`` form.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evergrove.functions import model



def no_reason() -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Cell:
    value: Column
    kind: str
    reason: Column | None = None
    item: str | None = None  # the elements' kind, of a list
    test: Column | None = None  # true exactly where the value is; null also means false
    instant: Column | None = None  # the plain timestamp of a time of full precision
    constant: object = None  # the single value that a literal stands for

    @property
    def condition(self) -> Column:
        """For WHERE: as plain as possible, so that scans can use it."""
        return self.test if self.test is not None else truthy(self)

    @property
    def why(self) -> Column:
        return no_reason() if self.reason is None else self.reason

    @property
    def known(self) -> Column:
        return F.lit(True) if self.reason is None else self.reason.isNull()


def kind_of_type(dtype: T.DataType) -> tuple[str, str | None]:
    if isinstance(dtype, T.StringType):
        return "text", None
    if isinstance(dtype, T.NumericType):
        return "number", None
    if isinstance(dtype, T.BooleanType):
        return "boolean", None
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return "instant", None
    if isinstance(dtype, T.MapType):
        return "map", kind_of_type(dtype.valueType)[0]
    if isinstance(dtype, T.ArrayType):
        return "list", kind_of_type(dtype.elementType)[0]
    if isinstance(dtype, T.StructType):
        names = dtype.fieldNames()
        if names == ["ts", "prec"]:
            return "time", None
        if names == ["amount", "currency"]:
            return "money", None
        return "record", None
    return "anything", None


def cell_of(column: Column, dtype: T.DataType) -> Cell:
    """A table's column as a value; integers become the one number type, plain
    timestamps times of full precision."""
    kind, item = kind_of_type(dtype)
    if kind == "number":
        return Cell(column.cast("double"), kind)
    if kind == "instant":
        return Cell(F.when(column.isNotNull(), time_struct(column, F.lit(model.SUBSECOND))), "time", instant=column.cast("timestamp_ntz"))
    return Cell(column, kind, None, item, column if kind == "boolean" else None)


def time_struct(at: Column, precision: Column) -> Column:
    return F.struct(at.cast("timestamp_ntz").alias("ts"), precision.cast("tinyint").alias("prec"))


def literal(v) -> Cell:
    """A single value as a cell."""
    kind = model.kind_of(v)
    if kind == "unknown":
        return Cell(F.lit(None).cast("string"), "unknown", F.lit(v.reason))
    if kind == "nothing":
        return Cell(F.lit(None).cast("string"), kind)
    if kind == "number":
        return Cell(F.lit(float(v)), kind, constant=float(v))
    if kind == "time":
        return Cell(time_struct(F.lit(v.at.isoformat(sep=" ")), F.lit(v.precision)), kind, constant=v)
    if kind == "money":
        return Cell(F.struct(F.lit(float(v.amount)).alias("amount"), F.lit(v.currency).alias("currency")), kind)
    if kind == "reference":
        return Cell(F.lit(v.path), kind)
    if kind == "list":
        cells = [literal(x) for x in v]
        kinds = {c.kind for c in cells}
        if len(kinds) > 1:
            cells = [to_text(c) for c in cells]
        return Cell(F.array(*[c.value for c in cells]), kind, None, cells[0].kind if cells else "text")
    if kind == "record":
        return Cell(F.struct(*[literal(x).value.alias(k) for k, x in sorted(v.items())]), kind)
    return Cell(F.lit(v), kind, constant=v)


def first_reason(*reasons: Column | None) -> Column | None:
    some = [r for r in reasons if r is not None]
    return F.coalesce(*some) if len(some) > 1 else some[0] if some else None


def failing(condition: Column, text: Column | str) -> Column:
    return F.when(condition, F.lit(text) if isinstance(text, str) else text)


def guarded(cell: Cell) -> Cell:
    """The value is null wherever there is a reason."""
    if cell.reason is None:
        return cell
    return replace(cell, value=F.when(cell.reason.isNull(), cell.value))


# --- text and numbers -------------------------------------------------------


def number_text(x: Column) -> Column:
    """Shortest text of a double (see ``model.number_text``).  Spark's own text
    has the shortest digits; only the layout differs."""
    size = F.abs(x)
    shown = size.cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.split_part(shown, F.lit("E"), F.lit(1)), "\\.", ""), "^0+|0+$", "")
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise(F.lit("")))
    power = F.when(shown.contains("E"), F.split_part(shown, F.lit("E"), F.lit(2)).cast("int")).otherwise(F.length(F.split_part(shown, F.lit("."), F.lit(1))) - 1)
    exponent = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
    exponent = F.when(F.abs(power) >= 100, F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.abs(power).cast("string"))).otherwise(exponent)
    rare = F.when((size >= 1e6) | ((size < 1e-4) & shown.contains("E")), F.concat(mantissa, exponent)).otherwise(F.concat(F.lit("0.000"), digits))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    # the usual sizes need no taking apart
    return (
        F.when(F.isnan(x), F.lit("NaN"))
        .when(x == 0, F.when(x.cast("string") == "-0.0", F.lit("-0")).otherwise(F.lit("0")))
        .when((size < 1e6) & (x == F.floor(x)), x.cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e6), x.cast("string"))
        .when(x == float("inf"), F.lit("+Inf"))
        .when(x == float("-inf"), F.lit("-Inf"))
        .otherwise(F.concat(sign, rare))
    )


_FORMS = {model.YEAR: "yyyy", model.MONTH: "yyyy-MM", model.DAY: "yyyy-MM-dd", model.HOUR: "yyyy-MM-dd HH:00", model.MINUTE: "yyyy-MM-dd HH:mm", model.SECOND: "yyyy-MM-dd HH:mm:ss"}


def time_text(time: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.date_format(time["ts"], "yyyy-MM-dd HH:mm:ss.SSSSSS"), "0+$", ""), "\\.$", "")
    for precision, form in _FORMS.items():
        text = F.when(time["prec"] == precision, F.date_format(time["ts"], form)).otherwise(text)
    return text


def to_text(c: Cell) -> Cell:
    """Text of anything; an unknown becomes 'Unknown: reason'."""
    if c.kind == "number":
        value = number_text(c.value)
    elif c.kind == "boolean":
        value = F.when(c.value, F.lit("true")).otherwise(F.lit("false"))
        value = F.when(c.value.isNotNull(), value)
    elif c.kind == "time":
        value = time_text(c.value)
    elif c.kind == "money":
        value = F.concat(F.format_string("%.2f", c.value["amount"]), F.lit(" "), c.value["currency"])
    elif c.kind == "list":
        value = F.concat(F.lit("["), F.array_join(F.transform(c.value, lambda x: to_text(Cell(x, c.item or "text")).value), ", "), F.lit("]"))
    elif c.kind == "record":
        value = F.to_json(c.value)
    else:
        value = c.value.cast("string")
    value = F.coalesce(value, F.lit(""))
    if c.reason is not None:
        value = F.when(c.reason.isNotNull(), F.concat(F.lit("Unknown: "), c.reason)).otherwise(value)
    return Cell(value, "text")


#: Spark would also read '1.5d' and ' 1 ' as numbers.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(c: Cell) -> Cell:
    if c.kind == "number":
        missing = failing(c.value.isNull(), "cannot coerce nothing to number")
        return guarded(Cell(c.value, "number", first_reason(c.reason, missing)))
    if c.kind == "text":
        value = F.when(c.value.rlike(NUMBER), c.value.try_cast("double"))
        bad = failing(c.value.isNull(), "cannot coerce nothing to number")
        wrong = F.when(c.value.isNotNull() & value.isNull(), F.concat(F.lit("cannot convert text to number: "), c.value))
        return guarded(Cell(value, "number", first_reason(c.reason, bad, wrong)))
    if c.kind == "money":
        return Cell(c.value["amount"], "number", c.reason)
    if c.kind == "time":
        # the zone of the session is UTC, as all times are
        return Cell(F.unix_seconds(c.value["ts"].cast("timestamp")).cast("double"), "number", c.reason)
    return Cell(F.lit(None).cast("double"), "number", first_reason(c.reason, F.lit(f"cannot coerce {c.kind} to number")))


def truthy(c: Cell) -> Column:
    v = c.value
    if c.kind in ("nothing", "unknown"):
        return F.lit(False)
    test = {
        "number": lambda: v != 0,
        "text": lambda: v != "",
        "boolean": lambda: v,
        "time": lambda: v["ts"] != F.lit(datetime(1970, 1, 1).isoformat(sep=" ")).cast("timestamp_ntz"),
        "money": lambda: v["amount"] != 0,
        "list": lambda: F.size(v) > 0,
    }.get(c.kind, lambda: v.isNotNull())()
    return c.known & F.coalesce(test, F.lit(False))


# --- operators ----------------------------------------------------------------


def arithmetic(op: str, a: Cell, b: Cell) -> Cell:
    x, y = to_number(a), to_number(b)
    u, v = x.value, y.value
    reason = first_reason(a.reason, b.reason, x.reason, y.reason)
    failure = None
    if op == "+":
        value = u + v
    elif op == "-":
        value = u - v
    elif op == "*":
        value = u * v
    elif op == "/":
        value, failure = F.try_divide(u, v), failing(v == 0, "division by zero")
    elif op == "%":
        value, failure = F.try_mod(u, v), failing(v == 0, "modulo by zero")
    elif op == "^":
        value = F.pow(u, v)
        failure = failing(F.isnan(value) | (F.abs(value) == float("inf")), "exponentiation result out of range")
    else:
        raise ValueError(f"unsupported binary operator: {op}")
    return guarded(Cell(value, "number", first_reason(reason, failure)))


def concat(a: Cell, b: Cell) -> Cell:
    return Cell(F.concat(to_text(a).value, to_text(b).value), "text")


_UNITS = {model.YEAR: "YEAR", model.MONTH: "MONTH", model.DAY: "DAY", model.HOUR: "HOUR", model.MINUTE: "MINUTE", model.SECOND: "SECOND"}


def window_start(time: Column) -> Column:
    start = time["ts"]
    for precision, unit in _UNITS.items():
        start = F.when(time["prec"] == precision, F.date_trunc(unit, time["ts"]).cast("timestamp_ntz")).otherwise(start)
    return start


def window_end(time: Column) -> Column:
    """The first instant after the window."""
    p, start = time["prec"], window_start(time)
    one = lambda unit: F.when(p == unit, F.lit(1)).otherwise(F.lit(0))
    second = F.when(p == model.SECOND, F.lit(1)).when(p >= model.SUBSECOND, F.lit(0.000001)).otherwise(F.lit(0)).cast("decimal(18,6)")
    zero = F.lit(0)
    return start + F.make_interval(one(model.YEAR), one(model.MONTH), zero, one(model.DAY), one(model.HOUR), one(model.MINUTE), second)


def time_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1; a finer time inside a coarser one's window equals it."""
    sa, sb = window_start(a), window_start(b)
    plain = F.when(sa < sb, F.lit(-1)).when(sa > sb, F.lit(1)).otherwise(F.lit(0))
    in_a = F.when(sb < sa, F.lit(1)).when(sb >= window_end(a), F.lit(-1)).otherwise(F.lit(0))
    in_b = F.when(sa < sb, F.lit(-1)).when(sa >= window_end(b), F.lit(1)).otherwise(F.lit(0))
    order = F.when(a["prec"] == b["prec"], plain).when(a["prec"] < b["prec"], in_a).otherwise(in_b)
    return F.when(a.isNotNull() & b.isNotNull(), order)


def _plain(op: str, u: Column, v: Column) -> Column:
    return {"<": lambda: u < v, ">": lambda: u > v, "<=": lambda: u <= v, ">=": lambda: u >= v, "=": lambda: u == v}[op]()


def _same_kind(op: str, a: Cell, b: Cell) -> Column | None:
    """The comparison; None where the kinds cannot be compared."""
    if "nothing" in (a.kind, b.kind):
        if a.kind == b.kind:
            return F.lit(op in ("=", "<=", ">="))
        # a column that is null holds nothing
        other = b if a.kind == "nothing" else a
        return other.value.isNull() if op in ("=", "<=", ">=") else F.lit(False)
    if a.kind != b.kind:
        return None
    u, v = a.value, b.value
    if a.kind == "time":
        return _plain(op, time_order(u, v), F.lit(0))
    if a.kind == "money":
        return (u["currency"] == v["currency"]) & _plain(op, u["amount"], v["amount"])
    if a.kind == "number":
        return ~F.isnan(u) & ~F.isnan(v) & _plain(op, u, v)
    return _plain(op, u, v)


_MIRRORED = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "!=": "!="}


def _direct(op: str, a: Cell, b: Cell) -> Column | None:
    """The comparison as WHERE should see it: null for false, no NaN tests that a
    scan cannot use, times of full precision against a literal's window."""
    if a.constant is not None and b.constant is None:
        return _direct(_MIRRORED[op], b, a)
    if a.kind != b.kind or op == "!=":
        return None
    u, v = a.value, b.value
    if a.kind == "number":
        test = _plain(op, u, v)
        if b.constant is None or b.constant != b.constant:
            # NaN sorts above infinity
            return (u.eqNullSafe(v) if op == "=" else test) & F.coalesce((u <= float("inf")) & (v <= float("inf")), u.isNull() & v.isNull())
        return test & (u <= float("inf")) if op in (">", ">=") else test
    if a.kind == "time" and a.instant is not None and isinstance(b.constant, model.Time):
        start, end = (F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in b.constant.window())
        t = a.instant
        return {"=": lambda: (t >= start) & (t < end), "<": lambda: t < start, "<=": lambda: t < end, ">": lambda: t >= end, ">=": lambda: t >= start}[op]()
    if a.kind in ("text", "boolean", "reference"):
        return u.eqNullSafe(v) if op == "=" and b.constant is None else _plain(op, u, v)
    return None


def _where(test: Column | None, reason: Column | None) -> Column | None:
    return test if test is None or reason is None else test & reason.isNull()


def compare(op: str, a: Cell, b: Cell) -> Cell:
    """< > <= >= = and !=.  An unknown side makes the result unknown; kinds that
    cannot be compared, and nothing against something, are false."""
    reason = first_reason(a.reason, b.reason)
    test = _same_kind("=" if op == "!=" else op, a, b)
    value = F.lit(False) if test is None else F.coalesce(test, a.value.isNull() & b.value.isNull() if op in ("=", "!=") else F.lit(False))
    cell = guarded(Cell(~value if op == "!=" else value, "boolean", reason))
    return replace(cell, test=_where(_direct(op, a, b), reason))


def starts(a: Cell, b: Cell) -> Cell:
    """Whether a text begins with another; nothing begins with nothing."""
    left, right = _text(a), _text(b)
    value = F.coalesce(F.startswith(left.value, right.value), F.lit(False))
    cell = guarded(Cell(value, "boolean", first_reason(a.reason, b.reason)))
    if a.kind == "text" and isinstance(b.constant, str) and b.constant:  # nothing begins with no such text
        return replace(cell, test=_where(a.value.startswith(b.constant), cell.reason))
    return cell


def definite_equal(a: Cell, b: Cell, match: str | None = None) -> Cell:
    """``?=`` is never unknown.  Against a bare unknown (match '*') it asks
    whether the left is unknown, against a reasoned one whether for that reason."""
    if match is not None:
        return Cell(~a.known if match == "*" else F.coalesce(a.why == match, F.lit(False)), "boolean")
    test = _same_kind("=", a, b)
    value = F.lit(False) if test is None else F.coalesce(test, F.lit(False))
    direct = None if test is None else _direct("=", a, b)
    if direct is not None and b.constant is None and a.constant is None:
        direct = None  # two nulls are not definitely equal
    return Cell(a.known & b.known & value, "boolean", test=_where(direct, first_reason(a.reason, b.reason)))


def both(a: Cell, b: Cell) -> Cell:
    reason = first_reason(a.reason, b.reason)
    return replace(guarded(Cell(truthy(a) & truthy(b), "boolean", reason)), test=_where(a.condition & b.condition, reason))


def either(a: Cell, b: Cell) -> Cell:
    reason = first_reason(a.reason, b.reason)
    return replace(guarded(Cell(truthy(a) | truthy(b), "boolean", reason)), test=_where(a.condition | b.condition, reason))


def negation(a: Cell) -> Cell:
    return guarded(Cell(~truthy(a), "boolean", a.reason))


def minus(a: Cell) -> Cell:
    if a.kind == "money":
        return Cell(F.struct((-a.value["amount"]).alias("amount"), a.value["currency"].alias("currency")), "money", a.reason)
    x = to_number(a)
    return Cell(-x.value, "number", x.reason)


# --- functions ------------------------------------------------------------------


def _text(c: Cell) -> Cell:
    return Cell(to_text(c).value, "text", c.reason)


def _utf8(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def substring(t: Cell, start: Cell, length: Cell) -> Cell:
    """0-based, in bytes; the end is clamped, a start outside is unknown."""
    text, s, n = _text(t), to_number(start), to_number(length)
    size, at, count = F.octet_length(text.value), s.value.cast("int"), n.value.cast("int")
    bad = failing((at < 0) | (at >= size) | (count < 0), F.concat(F.lit("invalid substring bounds: start="), at.cast("string"), F.lit(", length="), count.cast("string"), F.lit(" for string of length "), size.cast("string")))
    value = F.decode(F.substring(_utf8(text.value), at + 1, F.greatest(count, F.lit(0))), "UTF-8")
    return guarded(Cell(value, "text", first_reason(t.reason, s.reason, n.reason, bad)))


def find(t: Cell, part: Cell) -> Cell:
    """The 0-based byte offset of the first occurrence, or -1."""
    text, p = _text(t).value, _text(part).value
    before = F.octet_length(F.split_part(text, p, F.lit(1)))
    value = F.when(p == "", F.lit(0)).when(F.position(p, text) == 0, F.lit(-1)).otherwise(before)
    return guarded(Cell(value.cast("double"), "number", first_reason(t.reason, part.reason)))


def split(t: Cell, separator: Cell) -> Cell:
    text, s = _text(t).value, _text(separator).value
    quoted = F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    value = F.when(s == "", F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))).otherwise(F.split(text, quoted, -1))
    return Cell(value, "list", first_reason(t.reason, separator.reason), "text")


def split_count(t: Cell, separator: str) -> Cell:
    """How many parts ``split`` would make, from what its separators take up."""
    text, width = _text(t).value, len(separator.encode())
    taken = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(separator)))
    return guarded(Cell((taken / width + 1).cast("double"), "number", t.reason))


def replaced(t: Cell, old: Cell, new: Cell) -> Cell:
    """All occurrences; an empty ``old`` matches before every character and at
    the end."""
    text, a, b = _text(t).value, _text(old).value, _text(new).value
    spread = F.concat(b, F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.concat(c, b)), ""))
    value = F.when(a == "", spread).otherwise(F.replace(text, a, b))
    return guarded(Cell(value, "text", first_reason(t.reason, old.reason, new.reason)))


def _numeric(function):
    def apply(c: Cell) -> Cell:
        x = to_number(c)
        return Cell(function(x.value).cast("double"), "number", x.reason)

    return apply


def _textual(function):
    def apply(c: Cell) -> Cell:
        return guarded(Cell(function(_text(c).value), "text", c.reason))

    return apply


def _extreme(function):
    def apply(*cells: Cell) -> Cell:
        numbers = [to_number(c) for c in cells]
        value = function(*[n.value for n in numbers]) if len(numbers) > 1 else numbers[0].value
        return guarded(Cell(value, "number", first_reason(*[n.reason for n in numbers])))

    return apply


def total(*cells: Cell) -> Cell:
    result = literal(0.0)
    for cell in cells:
        result = arithmetic("+", result, cell)
    return result


def length(c: Cell) -> Cell:
    """Bytes of a text, elements of a list, fields of a record."""
    if c.kind == "list":
        return Cell(F.size(c.value).cast("double"), "number", c.reason)
    return guarded(Cell(F.octet_length(_text(c).value).cast("double"), "number", c.reason))


def index(items: Cell, position: Cell) -> Cell:
    """0-based; fractions are cut off; outside the list is unknown."""
    at = F.when(position.value >= 0, F.floor(position.value)).otherwise(F.ceil(position.value)).cast("int")
    size = F.size(items.value)
    outside = failing((at < 0) | (at >= size), F.concat(F.lit("list index "), at.cast("string"), F.lit(" out of bounds (length "), size.cast("string"), F.lit(")")))
    element = F.get(items.value, at)
    if items.item == "number":
        element = element.cast("double")
    return guarded(Cell(element, items.item or "anything", first_reason(items.reason, position.reason, outside)))


def combine(items: Cell, separator: Cell) -> Cell:
    """All elements as text, nothing as an empty one, joined by ``separator``."""
    texts = F.transform(items.value, lambda x: to_text(Cell(x.cast("double") if items.item == "number" else x, items.item or "text")).value)
    between = _text(separator).value
    joined = F.aggregate(texts, F.lit(None).cast("string"), lambda done, x: F.when(done.isNull(), x).otherwise(F.concat(done, between, x)))
    return Cell(F.coalesce(joined, F.lit("")), "text", first_reason(items.reason, separator.reason))


def _element(items: Cell, v: Cell) -> Column:
    return v.value if items.item != "number" else v.value.cast("double")


def _list(items: Cell) -> Column:
    return items.value.cast("array<double>") if items.item == "number" else items.value


def append(items: Cell, v: Cell) -> Cell:
    return Cell(F.array_append(_list(items), _element(items, v)), "list", first_reason(items.reason, v.reason), items.item)


def prepend(items: Cell, v: Cell) -> Cell:
    return Cell(F.array_prepend(_list(items), _element(items, v)), "list", first_reason(items.reason, v.reason), items.item)


def remove(items: Cell, x: Cell) -> Cell:
    """By index if ``x`` is a number within the list whose element there is not
    ``x`` itself; else the first element equal to ``x``."""
    values = _list(items)
    position = F.array_position(values, _element(items, x)) if x.kind == items.item else F.lit(0).cast("long")
    if x.kind == "number":
        at = F.floor(x.value).cast("int")
        there = F.get(values, at)
        use_index = (x.value >= 0) & (at < F.size(values))
        if items.item == "number":
            use_index = use_index & (there != x.value)
        drop = F.when(use_index, at).otherwise((position - 1).cast("int"))
    else:
        drop = (position - 1).cast("int")
    return Cell(F.filter(values, lambda v, i: i != drop), "list", first_reason(items.reason, x.reason), items.item)


def remove_range(items: Cell, first: Cell, last: Cell) -> Cell:
    a, b, size = first.value.cast("int"), last.value.cast("int"), F.size(items.value)
    bad = failing((a < 0) | (b >= size) | (a > b), F.concat(F.lit("invalid range for remove: "), a.cast("string"), F.lit(".."), b.cast("string")))
    return guarded(Cell(F.filter(_list(items), lambda v, i: (i < a) | (i > b)), "list", first_reason(items.reason, bad), items.item))


SPACE = r"(?U)^\s+|\s+$"

FUNCTIONS = {
    "upper": _textual(F.upper),
    "lower": _textual(F.lower),
    "trim": _textual(lambda t: F.regexp_replace(t, SPACE, "")),
    "abs": _numeric(F.abs),
    "floor": _numeric(F.floor),
    "ceil": _numeric(F.ceil),
    "ceiling": _numeric(F.ceil),
    "round": _numeric(lambda x: F.round(x, 0)),
    "sqrt": _numeric(F.sqrt),
    "exp": _numeric(F.exp),
    "log": _numeric(F.ln),
    "number": to_number,
    "text": lambda c: _text(c),
    "len": length,
    "length": lambda c: guarded(Cell(F.char_length(_text(c).value).cast("double"), "number", c.reason)),
    "add": total,
    "max": _extreme(F.greatest),
    "min": _extreme(F.least),
    "substring": substring,
    "find": find,
    "replace": replaced,
    "split": split,
    "output": lambda c: c,
    "is_unknown": lambda c: Cell(~c.known, "boolean"),
    "type_of": lambda c: Cell(F.when(c.known, F.lit(c.kind)).otherwise(F.lit("unknown")), "text"),
    "unknown": lambda c: Cell(F.lit(None).cast("string"), "unknown", to_text(c).value),
    "uuid": lambda: Cell(F.uuid(), "text"),
    "now": lambda: Cell(time_struct(F.current_timestamp(), F.lit(model.SUBSECOND)), "time"),
}


def parse_time(c: Cell) -> Cell:
    """Text to a time whose precision the form sets."""
    text = F.trim(c.value)
    forms = [
        (model.YEAR, r"^\d{4}$", F.concat(text, F.lit("-01-01 00:00:00"))),
        (model.MONTH, r"^\d{4}-\d{2}$", F.concat(text, F.lit("-01 00:00:00"))),
        (model.DAY, r"^\d{4}-\d{2}-\d{2}$", F.concat(text, F.lit(" 00:00:00"))),
        (model.HOUR, r"^\d{4}-\d{2}-\d{2}[ T]\d{2}$", F.concat(text, F.lit(":00:00"))),
        (model.MINUTE, r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}$", F.concat(text, F.lit(":00"))),
        (model.SECOND, r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$", text),
        (model.SUBSECOND, r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\.\d+$", text),
    ]
    at, precision = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("int")
    for p, pattern, full in forms:
        at = F.when(text.rlike(pattern), full.try_cast("timestamp_ntz")).otherwise(at)
        precision = F.when(text.rlike(pattern), F.lit(p)).otherwise(precision)
    bad = F.when(at.isNull(), F.concat(F.lit("cannot parse time: "), F.coalesce(c.value, F.lit(""))))
    return guarded(Cell(time_struct(at, precision), "time", first_reason(c.reason, bad)))


def add_time(t: Cell, amount: Cell, unit: Cell) -> Cell:
    """The time moved by a constant unit; its precision stays."""
    name = str(unit.constant or "").rstrip("s")
    months, seconds = {"year": 12, "month": 1}.get(name), {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}.get(name)
    n = to_number(amount)
    if months is None and seconds is None:
        return Cell(F.lit(None).cast("struct<ts:timestamp_ntz,prec:tinyint>"), "time", F.lit(f"unknown unit: {name}"))
    if months is not None:
        moved = t.value["ts"] + F.make_ym_interval(F.lit(0), (n.value * months).cast("int"))
    else:
        moved = t.value["ts"] + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n.value * seconds).cast("decimal(18,6)"))
    return guarded(Cell(time_struct(moved, t.value["prec"]), "time", first_reason(t.reason, n.reason)))


FUNCTIONS["parse_time"] = parse_time
FUNCTIONS["add_time"] = add_time
FUNCTIONS["format_time"] = lambda t, form: Cell(F.date_format(t.value["ts"], str(form.constant)), "text", t.reason)



def random_number(*bounds: Cell) -> Cell:
    """In [0, 1); with a bound a whole number below it, with two between them."""
    if not bounds:
        return Cell(F.rand(), "number")
    numbers = [to_number(b) for b in bounds]
    low = numbers[0].value if len(numbers) == 2 else F.lit(0.0)
    return guarded(Cell(low + F.floor(F.rand() * (numbers[-1].value - low)), "number", first_reason(*[n.reason for n in numbers])))


def converted(c: Cell, kind: Cell) -> Cell:
    """To the kind that a constant names."""
    made = {"text": _text, "number": to_number, "boolean": lambda x: Cell(truthy(x), "boolean", x.reason), "time": lambda x: parse_time(_text(x))}.get(str(kind.constant))
    return made(c) if made else literal(model.Unknown(f"cannot convert to {kind.constant}"))


def clock_part(part: str) -> Cell:
    """A part of the present time, in UTC; weekdays count from Sunday, 1."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    numbers = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": F.dayofweek, "week": F.weekofyear, "quarter": F.quarter}
    if part in numbers:
        return Cell(numbers[part](now).cast("double"), "number")
    if part == "unix":
        return Cell(F.unix_timestamp().cast("double"), "number")
    names = {"month_name": "MMMM", "weekday_name": "EEEE"}
    return Cell(F.date_format(now, names[part]), "text") if part in names else literal(model.Unknown("not_found"))


FUNCTIONS["random"] = random_number
FUNCTIONS["convert"] = converted
FUNCTIONS["asset"] = lambda data, mime: Cell(F.struct(_text(data).value.alias("data"), _text(mime).value.alias("mime_type")), "record", first_reason(data.reason, mime.reason))


def json_text(c: Cell) -> Cell:
    """A value as JSON: whole numbers without a fraction, names in order, times
    in UTC, money as amount and currency."""
    if c.kind == "time":
        text = F.date_format(c.value["ts"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return Cell(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", ""), F.lit('Z"')), "text", c.reason)
    value = F.struct(c.value["amount"].alias("amount"), c.value["currency"].alias("currency")) if c.kind == "money" else c.value
    whole = c.kind in ("list", "record", "money")
    text = F.to_json(F.try_parse_json(F.to_json(value if whole else F.array(value))))
    return guarded(Cell(text if whole else F.substring(text, F.lit(2), F.length(text) - 2), "text", c.reason))
