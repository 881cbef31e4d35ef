"""JSON, CSV, TSV and TOML sources and sinks, and files as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = True) -> DataFrame:
    """A schema is required: inferring one would read everything twice."""
    return spark.read.schema(schema).csv(path, sep=separator, header=header)


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return read_csv(spark, path, schema, "\t", header)


def read_toml(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its path and its content as JSON text.  Files are read
    whole, each by one task."""

    def parse(frames):
        import tomllib

        for frame in frames:
            frame["document"] = [json.dumps(tomllib.loads(text), default=str, sort_keys=True) for text in frame["value"]]
            yield frame[["path", "document"]]

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return texts.mapInPandas(parse, "path string, document string")


def write(rows: DataFrame, path: str, form: str) -> None:
    """json, csv or tsv."""
    writer = rows.write.mode("overwrite")
    if form == "json":
        writer.json(path)
    elif form in ("csv", "tsv"):
        writer.csv(path, sep="," if form == "csv" else "\t", header=True)
    else:
        raise ValueError(f"unknown form: {form}")


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path: name, size and time, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
