"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; only
    where that is unset and everything runs in one process (tests, notebooks) one
    of our own.  On a cluster without it there is no folder to share: an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="evergrove-checkpoint-"))
    return named or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder.  Spark deletes the
    files after the returned frame only where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as the engine's
    own session does; what a computation no longer needs belongs in `Scratch`."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one computation, in the shared folder.  ``drop`` deletes one
    that is superseded, and the end of the ``with`` block deletes all: nothing
    lazy that reads them may leave it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.folder)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.folder}/{name}")

    def _delete(self, path: str) -> None:
        delete_folder(self.spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: an expression repeated inside a lambda
    would otherwise be evaluated again for every array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(column: str = "text") -> Column:
    """The text as the operators see it: null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: of '')."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


SCAN = 256  # elements that one inner loop of `scanned` appends


def scanned(items: Column, start: Column, step, output: str) -> Column:
    """A running computation over an array, in time that grows with its length:
    ``step(state, item)`` gives (next state, output of the type ``output``), and
    the outputs are the result.  They are gathered block by block, since appending
    to one long array copies it every time."""

    def block(state: Column, part: Column) -> Column:
        def one(held: Column, item: Column) -> Column:
            after, made = step(held["state"], item)
            return F.struct(after.alias("state"), F.concat(held["out"], F.array(made)).alias("out"))

        return F.aggregate(part, F.struct(state.alias("state"), F.array().cast(f"array<{output}>").alias("out")), one)

    def whole(all_items: Column) -> Column:
        def added(held: Column, k: Column) -> Column:
            return let(
                block(held["state"], F.slice(all_items, k * SCAN + 1, SCAN)),
                lambda b: F.struct(b["state"].alias("state"), F.concat(held["out"], F.array(b["out"])).alias("out")),
            )

        blocks = F.sequence(F.lit(0), ((F.size(all_items) - 1) / SCAN).cast("int"))
        none = F.array().cast(f"array<array<{output}>>")
        return F.aggregate(blocks, F.struct(start.alias("state"), none.alias("out")), added, lambda held: F.flatten(held["out"]))

    return let(items, whole)


CHUNK_CHARS = 1024


def chunked(text: Column) -> Column:
    """The text in pieces of 1,024 code points, for `piece`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK_CHARS}}}+"), F.lit(0))


def piece(chunks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text given as `chunked`.  ``substring`` on a
    text counts code points from its start; here that is a chunk's start."""
    end = F.greatest(start, end)
    first, last = (start / CHUNK_CHARS).cast("int"), (end / CHUNK_CHARS).cast("int")
    part = lambda k, a, n: F.substring(F.coalesce(F.get(chunks, k), F.lit("")), a, n)
    within = part(first, start % CHUNK_CHARS + 1, end - start)
    between = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(part(first, start % CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)), between, part(last, F.lit(1), end % CHUNK_CHARS))
    return F.when(first == last, within).otherwise(across)
