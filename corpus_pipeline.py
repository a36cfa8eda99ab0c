"""A corpus preparation pipeline: each stage works on all documents that the stage before it kept.

Every stage takes null ids, null, empty and very long texts, repeated rows, empty tables and further columns of any
name; all but the last return the columns that they are given.
"""

from __future__ import annotations

from tracewright.llm import decontaminate, piece_codec, secret_scan, simhash_dedup, toxicity
from tracewright.llm.common import cut, table


def toxicity_stage(spark, docs, sf_dir):
    """Documents that the classifier rejects go; it learns from the labels and the documents at hand.

    Null and empty texts have no features and stay or go as the bias says; without toxic labels all documents stay.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark, docs, sf_dir):
    """Of each group of near duplicates the document with the smallest id stays.

    Null, empty and blank texts are one group. Of rows with the same id one stays; rows with a null id all stay.
    """
    return simhash_dedup.keep_one(docs)


def benchmark_stage(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go; null and empty texts hold none. Repeated rows go alike."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark, docs, sf_dir):
    """Secrets in texts give way to a placeholder, and n_chars follows; all documents stay, null texts as they are."""
    return secret_scan.redact_secrets(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def codec_stage(spark, docs, sf_dir):
    """Token ids (with begin and end ids) and the text they decode to; a null text is as an empty one."""
    return piece_codec.encode_decode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("decontaminate", benchmark_stage),
    ("secret_scan", secret_stage),
    ("piece_codec", codec_stage),
]

ORACLE_SQL = None  # learned scores, fingerprints and a tokenizer are beyond SQL


def run(spark, sf_dir):
    """All stages over the documents, one after another.

    Later stages read what they are given several times, so what the classifier keeps is written to the checkpoint folder
    once; the stages that only leave out documents by id, or by a broadcast table, are cheap to repeat.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name in ("toxicity", "decontaminate"):
            docs = cut(docs)
    return docs
