"""A corpus pipeline of five of the operators, and the registry of all their queries.

Every stage takes what the one before has kept and returns the columns of
``documents``; the last returns the encoded texts. ``run`` writes what each
stage keeps to the folder the cluster shares, reads it again, and deletes it
once the next stage is written; what the last one keeps stays for its readers.

Every stage takes null, empty and very long texts, repeated ids and rows, empty
tables and columns of any further names, and treats them as its operator says:
texts without letters are in no language, texts without words fail the base
limits, rows without an id stay where no row with one has their text, rows
without a source are a source, and a null text has no ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import delete, lean, shared_folder, sweep, table
from lodestone.llm.langid import keep_identified
from lodestone.llm.mixing import mix
from lodestone.llm.pieces import encode_with_digests
from lodestone.llm.quality import keep_good
from lodestone.llm.queries import ORACLES, QUERIES as OPERATOR_QUERIES
from lodestone.llm.simhash import keep_one

#: Distinct units that the last stage remembers in a worker, besides as many from before.
UNITS = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go."""
    lean(spark)
    return keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is low go, and those that fail the base limits."""
    lean(spark)
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays."""
    lean(spark)
    return keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to temperature weights, some documents more than once."""
    lean(spark)
    return mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text decoded from them."""
    lean(spark)
    return encode_with_digests(docs, cache=UNITS)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]
#: SQL can express no stage but parts of one; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    place, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            delete(spark, before)
        before = f"{place}/{name}"
        sweep(spark)
    return docs


QUERIES = {**OPERATOR_QUERIES, "pipeline": run}
SQL = {**ORACLES}
