"""A corpus pipeline: quality, exact copies, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrove.llm.common import checkpoint_folder, delete_folder, read_documents
from evergrove.llm.exact_dedup import drop_copies
from evergrove.llm.near_dedup import near_duplicates
from evergrove.llm.packing import pack
from evergrove.llm.pii import find_pii, redacted
from evergrove.llm.quality import score_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    The decision belongs to the text: rows with one id and different texts are
    decided one by one, null ids too, and repeated rows alike.  Null texts count
    as empty and stay null.  Without labels every score is 1/2, and all rows
    stay.  An empty table gives an empty result.  Columns other than those of
    ``documents`` are dropped here and in the next stages, whatever their names.
    """
    scores = score_quality(docs, read_documents(spark, sf_dir, "labels"))
    rejected = scores.where("predicted = 0").select(F.col("doc_id").alias("i"), F.col("digest").alias("d")).distinct()
    digest = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return docs.select(*COLUMNS).join(rejected, F.col("doc_id").eqNullSafe(F.col("i")) & (digest == F.col("d")), "left_anti")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; a null id is below all
    others.  Null and empty texts are equal.  Rows repeated with id and text are
    one document and become one row.  An empty table gives an empty result."""
    return drop_copies(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every near-duplicate group (five-word shingles, Jaccard 0.8), the
    document with the smallest id.

    Rows that share an id are one document and stay or go together.  Rows with a
    null id, and texts without words, are linked with nothing and stay.  An empty
    table gives an empty result."""
    dropped = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("dropped")).distinct()
    return docs.select(*COLUMNS).join(dropped, F.col("doc_id") == F.col("dropped"), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by the name of its kind; null texts
    become empty, ``n_chars`` is counted anew, ids may be null or repeated.  An
    empty table gives an empty result."""
    others = [c for c in COLUMNS if c not in ("text", "n_chars")]
    found = find_pii(docs, carried=others)
    clean = found.select(*others, redacted(F.col("text"), F.col("spans")).alias("text"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens, in sequences with every source's share: one row per piece.
    Every row is a document, also with a null or repeated id; an empty text is
    one token, null sources are one queue.  An empty table gives an empty result."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("packing", pack_windows),
]

#: Shingle sets, discriminants and merges are beyond SQL; tests hold the stages
#: against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every one is written before the next reads,
    and a stage's table goes when the next one's is complete."""
    folder = f"{checkpoint_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = read_documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete_folder(spark, f"{folder}/{k - 1}")
    return docs
