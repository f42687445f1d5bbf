"""From raw documents to packed training sequences: five stages, each written and read by the next."""

from __future__ import annotations

from trailmark.llm import decontamination, lines, minhash, packing, quality
from trailmark.llm.common import load, written


def quality_filter(spark, docs, sf_dir):
    """Documents that the quality classifier accepts (it learns from all labels).

    Null and empty texts are judged as one empty line; with no labels, or of one kind only, every document stays.
    """
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.clean(docs, quality.learn(load(spark, sf_dir, "documents").select("doc_id", "text"), labels))


def line_dedup(spark, docs, sf_dir):
    """Lines that match an earlier line go, short ones too, and documents that consist of such lines only.

    Null and empty texts stay; rows that share an id share their place, so neither costs the other a line.
    """
    return lines.clean(docs)


def near_dedup(spark, docs, sf_dir):
    """One document (the smallest id) of each group of near-duplicates stays.

    Null and empty texts and rows of a null id stay; rows that share an id go or stay together.
    """
    return minhash.clean(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark passage go; with an empty benchmark all stay."""
    return decontamination.clean(docs, load(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """Token pieces placed in sequences of 4,096; a null or empty text is its end id alone."""
    return packing.packed(docs)


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", benchmark_decontamination), ("packing", pack)]

#: the classifier and the tokenizer cannot be expressed in SQL
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
