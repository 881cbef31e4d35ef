"""The file calls of the language, ``my.computer.files.<name>(...)``.

Paths are anything the session's Hadoop file systems know.  Tables come back as
collections and stay lazy; single documents come back as values.
"""

from __future__ import annotations

from evergrove.functions import model
from evergrove.functions.model import Unknown
from evergrove.operators.collections import Collection
from evergrove.sources import ari, files, xml

#: Fixed value: bytes of a report that is read as one value.
MAX_REPORT = 10 * 1024 * 1024
MAX_TEXT = 256 * 1024 * 1024
PREFIX = "my.computer.files."


def call(spark, name: str, args: list):
    function = FUNCTIONS.get(name)
    if function is None:
        return Unknown(f"unknown files procedure: {name}")
    try:
        return function(spark, *args)
    except TypeError:
        return Unknown(f"wrong number of arguments for files.{name}")
    except Exception as error:  # a missing file or a bad document is a value of the language
        return Unknown(f"files.{name}: {type(error).__name__}: {str(error).splitlines()[0][:200]}")


def _filesystem(spark, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def read(spark, path: str):
    """A file as one text, which comes to the driver whole and so has a limit."""
    size = int(info(spark, path)["size"])
    if size > MAX_TEXT:
        return Unknown(f"#file_too_large: file size {size} exceeds maximum {MAX_TEXT}")
    return files.read_text(spark, path).first()["text"]


def write(spark, path: str, text) -> bool:
    system, target = _filesystem(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(model.to_text(text).encode()))
    finally:
        stream.close()
    return True


def listing(spark, path: str) -> list:
    system, target = _filesystem(spark, path)
    return sorted(status.getPath().getName() for status in system.listStatus(target))


def info(spark, path: str) -> dict:
    system, target = _filesystem(spark, path)
    status = system.getFileStatus(target)
    return {"name": target.getName(), "size": float(status.getLen()), "directory": bool(status.isDirectory()), "modified": float(status.getModificationTime()) / 1000}


def load(spark, path: str, form: str, options: dict | None = None):
    """xml, json and toml documents as values; csv, tsv and json lines (option
    ``lines``) as collections, with ``schema`` and ``key`` from the options."""
    options = options or {}
    schema, key = options.get("schema"), options.get("key")
    if form == "xml":
        if "row" in options:
            return Collection(xml.read_xml(spark, path, options["row"], schema), key)
        return xml.to_record(read(spark, path))
    if form == "json":
        return Collection(files.read_json(spark, path, schema), key) if options.get("lines") else model.parse_json(read(spark, path))
    if form in ("csv", "tsv"):
        separator = "," if form == "csv" else "\t"
        reader = spark.read.schema(schema) if schema else spark.read
        return Collection(reader.csv(path, sep=separator, header=bool(options.get("header", True))), key)
    if form == "toml":
        return model.parse_json(files.read_toml(spark, path).first()["document"])
    return Unknown(f"unsupported import format: {form}")


def save(spark, node, path: str, form: str, options: dict | None = None):
    options = options or {}
    if isinstance(node, Collection):
        if form == "xml":
            xml.write_xml(node.rows, path, options.get("row", "record"), options.get("root_element", "records"))
        else:
            files.write(node.rows, path, form)
        return True
    if form == "json":
        return write(spark, path, model.to_json(node))
    if form == "xml" and isinstance(node, dict):
        attributes = tuple(options.get("attributes") or ())
        return write(spark, path, xml.from_record(node, options.get("root_element", "root"), bool(options.get("pretty")), attributes))
    if form in ("csv", "tsv") and isinstance(node, list) and all(isinstance(row, dict) for row in node):
        names = sorted({name for row in node for name in row})
        rows = [tuple(model.to_text(row.get(name)) for name in names) for row in node]
        files.write(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)), path, form)
        return True
    return Unknown(f"unsupported export format: {form}")


def fixed_width(spark, path: str, specification: str):
    """A report by an extraction specification: its text, or a file of it.  A
    report comes to the driver whole, so its size has a limit."""
    size = int(info(spark, path)["size"])
    if size > MAX_REPORT:
        return Unknown(f"#file_too_large: file size {size} exceeds maximum {MAX_REPORT}")
    source = specification if "\n" in specification else read(spark, specification)
    return ari.extract(ari.parse_specification(source), read(spark, path))


FUNCTIONS = {
    "read": read,
    "write": write,
    "exists": lambda spark, path: bool(files.exists(spark, path)),
    "delete": lambda spark, path: bool(files.delete(spark, path)),
    "list": listing,
    "info": info,
    "import": load,
    "export": save,
    "import_fixed_width": fixed_width,
}
