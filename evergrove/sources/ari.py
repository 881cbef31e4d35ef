"""Declarative extraction from fixed-layout reports.

A specification names sections (between a line that starts and one that ends
them), fields (where a landmark stands, how to move from it, and what to take)
and breaks, which repeat a section's fields.  Reports are documents of their own,
so a table of them is extracted row by row in Arrow batches.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame

from evergrove.functions import model
from evergrove.functions.model import Unknown

#: What the built-in patterns take, most specific first.
TAKES = {
    "money": r"[-(]?[$€£¥]\s?-?\d[\d,]*(?:\.\d+)?\)?",
    "date": r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}",
    "decimal": r"-?\d[\d,]*\.\d+",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "integer": r"-?\d[\d,]*",
    "quoted": r"\"[^\"]*\"",
    "word": r"\S+",
}
ORDER = ("money", "date", "decimal", "integer", "quoted", "word")


class SpecificationProblem(ValueError):
    pass


@dataclass
class Field:
    name: str
    moves: list[tuple[str, int]]
    patterns: list[str]
    kind: str | None = None


@dataclass
class Section:
    name: str
    starts: str | None = None
    ends: str | None = None
    fields: list[Field] = field(default_factory=list)
    sections: list[Section] = field(default_factory=list)
    breaks: str | None = None  # '' for a plain break
    repeating: bool = False


@dataclass
class Custom:
    """A type of one's own: a pattern and what becomes of its text."""

    pattern: str
    strip: str = ""
    negate: str = ""
    kind: str = "text"


@dataclass
class Specification:
    sections: list[Section]
    types: dict[str, Custom]


_SECTION = re.compile(r"section\s+(\w+)\s*(?:starts\((?P<s>.*?)\))?\s*(?:ends\((?P<e>.*?)\))?\s*:$")
_FIELD = re.compile(r"field\s+(\w+)\s*:\s*(.*)$")
_MOVE = re.compile(r"(left|right|up|down)\s+(\d+)?(-)?(\d+)?|(same|flush)")


def _unquoted(text: str) -> str:
    return text.strip().strip('"')


def parse_specification(source: str) -> Specification:
    """Indented lines: ``type``, ``section``, ``field`` and ``break``."""
    top = Section("")
    stack: list[tuple[int, object]] = [(-1, top)]
    types: dict[str, Custom] = {}
    for number, raw in enumerate(source.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        level = len(raw) - len(raw.lstrip())
        while level <= stack[-1][0]:
            stack.pop()
        owner = stack[-1][1]
        if match := _SECTION.match(line):
            section = Section(match[1], _unquoted(match["s"]) if match["s"] else None, _unquoted(match["e"]) if match["e"] else None)
            owner.sections.append(section)
            stack.append((level, section))
        elif match := _FIELD.match(line):
            owner.fields.append(_field(match[1], match[2], number))
        elif match := re.match(r"break(?:\s+on\s+(.*))?$", line):
            owner.repeating, owner.breaks = True, _unquoted(match[1] or "")
        elif match := re.match(r"type\s+(\w+)\s*:\s*(.*)$", line):
            types[match[1]] = Custom("")
            stack.append((level, types[match[1]]))
            _custom(types[match[1]], match[2])
        elif isinstance(owner, Custom):
            _custom(owner, line)
        else:
            raise SpecificationProblem(f"line {number}: cannot read {line!r}")
    return Specification(top.sections, types)


def _custom(custom: Custom, text: str) -> None:
    for part in filter(None, (p.strip() for p in re.split(r"[;]|(?=\bstrip\b)|(?=\bnegate\b)|(?=\bas\b)|->", text))):
        word, _, rest = part.partition(" ")
        if word in ("strip", "negate", "as"):
            setattr(custom, "kind" if word == "as" else word, _unquoted(rest))
        elif not custom.pattern:
            custom.pattern = _unquoted(part)


def _field(name: str, rest: str, number: int) -> Field:
    moves_text, _, patterns_text = _before_patterns(rest)
    moves = []
    for m in _MOVE.finditer(moves_text):
        if m[5]:
            moves.append((m[5], 0))
        else:
            moves.append((m[1], int(m[2] if m[2] is not None else m[4] or 0)))
    patterns = [p.strip() for p in re.findall(r"\"[^\"]*\"|/[^/]+/|\w+", patterns_text)]
    if not patterns:
        raise SpecificationProblem(f"line {number}: field {name} has no pattern")
    return Field(name, moves, patterns)


def _before_patterns(rest: str) -> tuple[str, str, str]:
    """Moves and patterns, where the pattern's own text may hold a colon."""
    at = re.match(r"[^\"]*:", rest)
    return (rest[: at.end() - 1], ":", rest[at.end() :]) if at else ("", ":", rest)


def _regex(pattern: str, types: dict[str, Custom]) -> str:
    if pattern.startswith('"'):
        return re.escape(pattern[1:-1])
    if pattern.startswith("/"):
        return pattern[1:-1]
    if pattern in types:
        return types[pattern].pattern
    return TAKES.get(pattern, re.escape(pattern))


def _value(token: str, kind: str | None, types: dict[str, Custom]):
    token = token.strip()
    if kind in types:
        custom = types[kind]
        for sign in custom.strip:
            token = token.replace(sign, "")
        if custom.negate and custom.negate in token:
            token = "-" + token.replace(custom.negate, "")
        return _value(token, custom.kind, {})
    if kind == "money":
        negative = token.startswith(("-", "(")) or "-" in token
        digits = re.sub(r"[^\d.]", "", token)
        return -float(digits) if negative else float(digits)
    if kind in ("integer", "decimal", "number"):
        try:
            return float(token.replace(",", ""))
        except ValueError:
            return Unknown(f"cannot convert text to number: {token}")
    if kind == "date":
        if "/" in token:
            month, day, year = (int(x) for x in token.split("/"))
            return model.Time(datetime(year + (2000 if year < 100 else 0), month, day), model.DAY)
        return model.parse_time(token)
    return token[1:-1] if kind == "quoted" else token


def _take(line: str, at: int, types: dict[str, Custom], kind: str | None = None):
    """The token at a column, blanks skipped: the first of the kinds that fits."""
    rest = line[at:].lstrip()
    if not rest:
        return Unknown("not_found")
    for k in [kind] if kind else ORDER:
        match = re.match(_regex(k, types), rest)
        if match and (k in ("word", "quoted") or kind or re.match(r"\s|$|[,;|]", rest[match.end() :][:1] or " ")):
            return _value(match.group(), k, types)
    return Unknown("not_found")


def _bounds(section: Section, lines: list[str], low: int, high: int) -> list[tuple[int, int]]:
    """All places of a section; without marks, the whole of its parent."""
    if section.starts is None:
        return [(low, high)]
    found, at = [], low
    while at < high:
        begin = next((k for k in range(at, high) if section.starts in lines[k]), None)
        if begin is None:
            break
        end = high
        if section.ends is not None:
            end = next((k for k in range(begin + 1, high) if section.ends in lines[k]), high)
            end = min(high, end + 1)
        found.append((begin, end))
        at = max(end, begin + 1)
    return found


def _locate(f: Field, lines: list[str], low: int, high: int, types: dict[str, Custom]):
    """A field's value: at its landmark and the moves from there, or, without
    moves, the pattern itself.  No landmark means not found."""
    landmark, kind = f.patterns[0], f.patterns[1] if len(f.patterns) > 1 else None
    pattern = re.compile(_regex(landmark, types))
    for row in range(low, high):
        match = pattern.search(lines[row])
        if not match:
            continue
        if not f.moves:
            return _value(match.group(), landmark if landmark in TAKES or landmark in types else None, types)
        at_row, at = row, match.start()
        for way, distance in f.moves:
            if way == "right":
                at += distance
            elif way == "left":
                at -= distance
            elif way == "down":
                at_row += distance
            elif way == "up":
                at_row -= distance
            elif way == "flush":
                at = 0
        at_row = min(max(at_row, low), high - 1)
        return _take(lines[at_row], max(at, 0), types, kind)
    return Unknown("not_found")


def _repeats(section: Section, lines: list[str], low: int, high: int) -> list[tuple[int, int]]:
    """The line ranges of a repeating section's records: from one break to the
    next; with a plain break, from where the first field's landmark stands to where
    it stands again."""
    inner = low + (section.starts is not None)
    mark = section.breaks or (_unquoted(section.fields[0].patterns[0]) if section.fields else "")
    starts = [k for k in range(inner, high) if mark and mark in lines[k]]
    return [(k, n) for k, n in zip(starts, [*starts[1:], high])]


def _extract_section(section: Section, lines: list[str], low: int, high: int, types: dict[str, Custom]):
    if section.repeating:
        return [_record(section, lines, a, b, types) for a, b in _repeats(section, lines, low, high)]
    return _record(section, lines, low, high, types)


def _record(section: Section, lines: list[str], low: int, high: int, types: dict[str, Custom]) -> dict:
    out = {f.name: _locate(f, lines, low, high, types) for f in section.fields}
    for inner in section.sections:
        out[inner.name] = _section(inner, lines, low, high, types)
    return out


def _section(section: Section, lines: list[str], low: int, high: int, types: dict[str, Custom]):
    """None for no place, a record for one, a list for several; a repeating
    section is always a list."""
    found = [_extract_section(section, lines, a, b, types) for a, b in _bounds(section, lines, low, high)]
    if section.repeating:
        return [record for records in found for record in records]
    return found[0] if len(found) == 1 else found or None


def extract(specification: Specification, text: str) -> dict:
    """One report as a record, a field per top-level section."""
    lines = text.splitlines()
    return {s.name: _section(s, lines, 0, len(lines), specification.types) for s in specification.sections}


def extract_reports(reports: DataFrame, source: str, id_column: str, text_column: str) -> DataFrame:
    """(id, record): every report's record as JSON text.  Null text counts as an
    empty report."""
    specification = parse_specification(source)

    def run(batches):
        for batch in batches:
            records = [model.to_json(extract(specification, text or "")) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(records, pa.string())], names=["id", "record"])

    return reports.select(id_column, text_column).mapInArrow(run, f"id {reports.schema[id_column].dataType.simpleString()}, record string")
