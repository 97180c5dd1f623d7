"""Corpus pipeline: documents in, packed pieces out.

``STAGES`` lists (name, function) in order.  Each function takes (spark, docs, sf_dir), works on all
documents that the stage before it kept, and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of ``documents``.

1. quality classifier: documents rejected for quality or toxicity go;
2. n-gram Jaccard join: of documents alike in five-word shingles (0.8 or more) one stays;
3. suffix-array dedup: strings of 200 bytes that also start elsewhere are cut out of ``text``, and
   ``n_chars`` follows; texts cut out as a whole stay as empty texts;
4. benchmark decontamination: documents with a benchmark item go;
5. packing: the texts left, as pieces of sequences of 4096 ids.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dfprofile.llm import decontaminate, jaccard, packing, quality, repeats
from dfprofile.llm.common import load, stash

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = str(2 << 20)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """``stage`` with texts sent to its workers in batches of ``BATCH_BYTES``.  The same executors and
    workers run all stages, so what one of them once held at a time is memory the next ones lack."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, BATCH_BYTES)  # left so: the result is not computed yet
        return stage(spark, docs, sf_dir)

    return bounded


@small_batches
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, load(spark, sf_dir, "labels"))


@small_batches
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, width=5, percent=80)


@small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs)


@small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_benchmark(docs, load(spark, sf_dir, "benchmark"))


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), forget=True)


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_of_each),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Models, shingle joins and repeated strings are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, batch = load(spark, sf_dir, "documents"), spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            docs = stash(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(BATCH, batch)
    return docs
