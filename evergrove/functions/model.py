"""The value model for single values, in plain Python.

Text is ``str``, numbers are ``float``, booleans ``bool``, nothing is ``None``;
lists and records are ``list`` and ``dict``.  The other kinds are below.
``columns`` gives the same semantics over Spark columns.
"""

from __future__ import annotations

import json
import math
import re
from calendar import monthrange
from dataclasses import dataclass
from datetime import datetime, timedelta

YEAR, MONTH, DAY, HOUR, MINUTE, SECOND, SUBSECOND = range(1, 8)


@dataclass(frozen=True)
class Unknown:
    reason: str = "unknown"


@dataclass(frozen=True)
class Time:
    """An instant in UTC, known to ``precision`` (1 year ... 7 subsecond)."""

    at: datetime
    precision: int = SUBSECOND

    def window(self) -> tuple[datetime, datetime]:
        """The first instant that it may mean and the first that it may not."""
        t, p = self.at, self.precision
        start = datetime(t.year, t.month if p >= MONTH else 1, t.day if p >= DAY else 1, t.hour if p >= HOUR else 0, t.minute if p >= MINUTE else 0, t.second if p >= SECOND else 0)
        if p >= SUBSECOND:
            return t, t + timedelta(microseconds=1)
        if p == YEAR:
            return start, datetime(t.year + 1, 1, 1)
        if p == MONTH:
            return start, start + timedelta(days=monthrange(t.year, t.month)[1])
        return start, start + {DAY: timedelta(days=1), HOUR: timedelta(hours=1), MINUTE: timedelta(minutes=1), SECOND: timedelta(seconds=1)}[p]


@dataclass(frozen=True)
class Money:
    amount: float
    currency: str


@dataclass(frozen=True)
class Ref:
    path: str


class _Anything:
    def __repr__(self):
        return "Anything"


ANYTHING = _Anything()
NUMBER_TEXT = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\Z|[+-]?(inf|infinity|nan)\Z", re.I)
TIME_TEXT = re.compile(r"(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[ T](\d{2})(?::(\d{2})(?::(\d{2})(?:\.(\d+))?)?)?)?)?)?Z?\Z")


def kind_of(v) -> str:
    if v is None:
        return "nothing"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "text", Unknown: "unknown", Time: "time", Money: "money", Ref: "reference", list: "list", dict: "record"}.get(type(v), "anything")


def number_text(x: float) -> str:
    """The shortest text that gives the number back: plain from 1e-4 up to
    999999, an exponent of at least two digits beyond."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    mantissa, _, exponent = f"{x:.17e}".partition("e")
    for digits in range(17):  # the fewest digits that round-trip
        mantissa, _, exponent = f"{x:.{digits}e}".partition("e")
        if float(f"{mantissa}e{exponent}") == x:
            break
    power = int(exponent)
    if power < -4 or power >= 6:
        return f"{mantissa}e{'-' if power < 0 else '+'}{abs(power):02d}"
    return f"{x:.{max(0, len(mantissa.partition('.')[2]) - power)}f}"


def time_text(t: Time) -> str:
    """Only the parts that the precision covers; an hour shows ':00'."""
    forms = {YEAR: "%Y", MONTH: "%Y-%m", DAY: "%Y-%m-%d", HOUR: "%Y-%m-%d %H:00", MINUTE: "%Y-%m-%d %H:%M", SECOND: "%Y-%m-%d %H:%M:%S"}
    if t.precision in forms:
        return t.at.strftime(forms[t.precision])
    return t.at.strftime("%Y-%m-%d %H:%M:%S.%f").rstrip("0").rstrip(".")


def parse_time(text: str) -> Time | Unknown:
    """The first form that fits sets the precision; a fraction means subsecond."""
    match = TIME_TEXT.match(text.strip())
    if not match:
        return Unknown(f"cannot parse time: {text}")
    parts = match.groups()
    precision = sum(p is not None for p in parts)
    year, month, day, hour, minute, second = (int(p) if p else d for p, d in zip(parts[:6], (1, 1, 1, 0, 0, 0)))
    try:
        return Time(datetime(year, month, day, hour, minute, second, int((parts[6] or "0")[:6].ljust(6, "0"))), precision)
    except ValueError:
        return Unknown(f"cannot parse time: {text}")


def to_text(v) -> str:
    kind = kind_of(v)
    if kind == "text":
        return v
    if kind == "number":
        return number_text(float(v))
    if kind == "boolean":
        return "true" if v else "false"
    if kind == "nothing":
        return ""
    if kind == "unknown":
        return f"Unknown: {v.reason}"
    if kind == "time":
        return time_text(v)
    if kind == "money":
        return f"{v.amount:.2f} {v.currency}"
    if kind == "reference":
        return v.path
    if kind == "list":
        return "[" + ", ".join(map(to_text, v)) + "]"
    if kind == "record":
        return "{" + ", ".join(f"{k}: {to_text(v[k])}" for k in sorted(v)) + "}"
    return "Anything"


def to_number(v):
    kind = kind_of(v)
    if kind == "number":
        return float(v)
    if kind == "text":
        return float(v) if NUMBER_TEXT.match(v) else Unknown(f"cannot convert text to number: {v}")
    if kind == "money":
        return v.amount
    if kind == "time":
        return float(math.floor((v.at - datetime(1970, 1, 1)).total_seconds()))
    return v if kind == "unknown" else Unknown(f"cannot coerce {kind} to number")


def truthy(v) -> bool:
    kind = kind_of(v)
    if kind in ("nothing", "unknown"):
        return False
    if kind == "time":
        return v.at != datetime(1970, 1, 1)
    if kind == "money":
        return v.amount != 0
    if kind in ("reference", "anything"):
        return True
    return bool(v)


def arithmetic(op: str, a, b):
    for v in (a, b):
        if isinstance(v, Unknown):
            return v
    x = to_number(a)
    if isinstance(x, Unknown):
        return x
    y = to_number(b)
    if isinstance(y, Unknown):
        return y
    if op == "/" and y == 0:
        return Unknown("division by zero")
    if op == "%" and y == 0:
        return Unknown("modulo by zero")
    try:
        if op == "^":
            result = math.pow(x, y)
            return Unknown("exponentiation result out of range") if math.isinf(result) or math.isnan(result) else result
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: math.fmod(x, y)}[op]()
    except (OverflowError, ValueError):
        return Unknown("exponentiation result out of range")


def compare(a, b) -> int | None:
    """-1, 0 or 1; None where the two cannot be compared."""
    kind = kind_of(a)
    if kind != kind_of(b):
        return None
    sign = lambda x, y: (x > y) - (x < y)
    if kind == "number":
        return None if math.isnan(a) or math.isnan(b) else sign(a, b)
    if kind == "text":
        return sign(a.encode(), b.encode())
    if kind == "boolean":
        return sign(a, b)
    if kind == "nothing":
        return 0
    if kind == "unknown":
        return sign(a.reason, b.reason)
    if kind == "reference":
        return sign(a.path, b.path)
    if kind == "money":
        return sign(a.amount, b.amount) if a.currency == b.currency else None
    if kind == "time":
        return compare_times(a, b)
    if kind == "list":
        for x, y in zip(a, b):
            if (c := compare(x, y)) != 0:
                return c
        return sign(len(a), len(b))
    if kind == "record":
        if len(a) != len(b):
            return sign(len(a), len(b))
        for k in sorted(a):
            if k not in b:
                return None
            if (c := compare(a[k], b[k])) != 0:
                return c
        return 0
    return 0


def compare_times(a: Time, b: Time) -> int:
    """Of mixed precision, the finer one is before, in or after the window."""
    if a.precision == b.precision:
        x, y = a.window()[0], b.window()[0]
        return (x > y) - (x < y)
    coarse, fine, sign = (a, b, -1) if a.precision < b.precision else (b, a, 1)
    start, end = coarse.window()
    at = fine.window()[0]
    return sign * (-1 if at < start else 1 if at >= end else 0)


def equal(a, b) -> bool:
    return compare(a, b) == 0


def parse_json(text: str):
    def value(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        if isinstance(x, (int, float)):
            return float(x)
        return [value(y) for y in x] if isinstance(x, list) else {k: value(y) for k, y in x.items()}

    try:
        return value(json.loads(text))
    except ValueError as error:
        return Unknown(f"invalid JSON: {error}")


def json_number(x: float) -> int | float:
    return int(x) if x == int(x) and abs(x) < 1e21 else x


def to_json(v) -> str:
    def plain(x):
        kind = kind_of(x)
        if kind == "number":
            return json_number(float(x))
        if kind == "time":
            return x.at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{x.at.microsecond:06d}".rstrip("0") if x.at.microsecond else "") + "Z"
        if kind == "money":
            return {"amount": json_number(x.amount), "currency": x.currency}
        if kind == "unknown":
            return {"type": "unknown", "reason": x.reason}
        if kind == "list":
            return [plain(y) for y in x]
        if kind == "record":
            return {k: plain(y) for k, y in x.items()}
        return x.path if kind == "reference" else x

    return json.dumps(plain(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
