"""Values as a person reads them: what a prompt shows."""

from __future__ import annotations

from evergrove.functions import model


def display(value, indent: str = "") -> str:
    """Nothing shows nothing; lists of like records are tables, records are
    indented lines, everything else is its text."""
    if value is None:
        return ""
    if isinstance(value, model.Unknown):
        return f"unknown({value.reason})"
    if isinstance(value, list):
        return _listed(value, indent)
    if isinstance(value, dict):
        if not value:
            return "{}"
        return "\n".join(f"{indent}{name}:{_below(v, indent)}" for name, v in value.items())
    return f"{value.amount:.2f} {value.currency}" if isinstance(value, model.Money) else model.to_text(value)


def _below(value, indent: str) -> str:
    if isinstance(value, dict) and value or isinstance(value, list) and any(isinstance(v, (dict, list)) for v in value):
        return "\n" + display(value, indent + "  ")
    return f" {display(value)}" if value is not None else ""


def _listed(items: list, indent: str) -> str:
    if items and all(isinstance(v, dict) for v in items) and len({tuple(v) for v in items}) == 1:
        return table([[*items[0]], *[[display(v) for v in row.values()] for row in items]], indent)
    if any(isinstance(v, (dict, list)) for v in items):
        return "\n".join(f"{indent}-{_below(v, indent)}" for v in items)
    return "[" + ", ".join(map(display, items)) + "]"


def table(rows: list[list[str]], indent: str = "") -> str:
    """Rows in columns of equal width; the first row is the head."""
    widths = [max(len(row[k]) for row in rows) for k in range(len(rows[0]))]
    lines = [indent + "  ".join(cell.ljust(width) for cell, width in zip(row, widths)).rstrip() for row in rows]
    return "\n".join([lines[0], indent + "  ".join("-" * width for width in widths), *lines[1:]])
