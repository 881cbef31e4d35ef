"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evergrove.llm.common import read_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op1_exact_dedup(spark, sf_dir):
    from evergrove.llm.exact_dedup import exact_dedup

    return exact_dedup(read_documents(spark, sf_dir))


ORACLES["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@_query
def op9_packing(spark, sf_dir):
    import public_tokenizers

    from evergrove.llm.packing import pack

    return pack(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op2_winnowing(spark, sf_dir):
    from evergrove.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(read_documents(spark, sf_dir))


@_query
def op8_pii(spark, sf_dir):
    from evergrove.llm.pii import pii_report

    return pii_report(read_documents(spark, sf_dir))


@_query
def op3_quality(spark, sf_dir):
    from evergrove.llm.quality import score_quality

    return score_quality(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels"))


@_query
def op5_toxicity(spark, sf_dir):
    from evergrove.llm.toxicity import score_toxicity

    return score_toxicity(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels"))


@_query
def op10_near_dedup(spark, sf_dir):
    from evergrove.llm.near_dedup import near_duplicates

    return near_duplicates(read_documents(spark, sf_dir), words=2)


@_query
def op4_lm_scoring(spark, sf_dir):
    from evergrove.llm.lm_scoring import score_by_cross_entropy

    good = read_documents(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score_by_cross_entropy(read_documents(spark, sf_dir), good)


@_query
def op7_sentencepiece(spark, sf_dir):
    import public_tokenizers

    from evergrove.llm.sentencepieces import encode_report

    return encode_report(read_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op6_secret_scan(spark, sf_dir):
    from evergrove.llm.secret_scan import secret_report

    return secret_report(read_documents(spark, sf_dir))
