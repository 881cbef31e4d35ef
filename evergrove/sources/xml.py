"""XML to records and back.

Attributes and children become fields of one name space, an element's own text
the field ``_text``, repeated children a list; the root's name is dropped.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrove.functions import model

OPTIONS = {"attributePrefix": "", "valueTag": "_text"}
#: Writers need a prefix to tell attributes; names that start with '@' become some.
WRITE_OPTIONS = {"attributePrefix": "@", "valueTag": "_text"}


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """One row per ``row_tag`` element of the files under ``path``."""
    reader = spark.read.format("xml").options(rowTag=row_tag, **OPTIONS)
    return (reader.schema(schema) if schema else reader).load(path)


def write_xml(rows: DataFrame, path: str, row_tag: str = "record", root_tag: str = "records") -> None:
    rows.write.mode("overwrite").format("xml").options(rowTag=row_tag, rootTag=root_tag, **WRITE_OPTIONS).save(path)


def parse_column(text: Column, schema: str) -> Column:
    """XML text to a struct of that schema; malformed text is null."""
    return F.from_xml(text, schema, OPTIONS)


def to_column(record: Column, row_tag: str = "record") -> Column:
    return F.to_xml(record, {"rowTag": row_tag, **WRITE_OPTIONS})


def _local(tag: str) -> str:
    return re.sub(r"^\{[^}]*\}", "", tag)


def to_record(text: str):
    """One document as a record."""
    try:
        return _record(ElementTree.fromstring(text))
    except ElementTree.ParseError as error:
        return model.Unknown(f"invalid XML: {error}")


def _record(element) -> dict:
    out: dict = {_local(k): v for k, v in element.attrib.items()}
    for child in element:
        name, value = _local(child.tag), _record(child)
        if name in out:
            out[name] = [*out[name], value] if isinstance(out[name], list) else [out[name], value]
        else:
            out[name] = value
    body = (element.text or "").strip()
    if body:
        out["_text"] = body
    return out


def from_record(record: dict, root: str = "root", pretty: bool = False, attributes: tuple[str, ...] = (), level: int = 0) -> str:
    """A record as XML, names sorted, everything escaped.  ``attributes`` names the
    fields that become attributes."""
    pad, end = ("  " * level, "\n") if pretty else ("", "")
    attrs = "".join(f" {k}={quoteattr(model.to_text(record[k]))}" for k in sorted(record) if k in attributes and not isinstance(record[k], (dict, list)))
    body = escape(model.to_text(record["_text"])) if "_text" in record else ""
    inner = ""
    for name in sorted(record):
        if name == "_text" or name in attributes and not isinstance(record[name], (dict, list)):
            continue
        for value in record[name] if isinstance(record[name], list) else [record[name]]:
            if isinstance(value, dict):
                inner += from_record(value, name, pretty, attributes, level + 1)
            else:
                inner += f"{'  ' * (level + 1) if pretty else ''}<{name}>{escape(model.to_text(value))}</{name}>{end}"
    if not body and not inner:
        return f"{pad}<{root}{attrs}/>{end}"
    return f"{pad}<{root}{attrs}>{body}{end if inner else ''}{inner}{pad if inner else ''}</{root}>{end}"
