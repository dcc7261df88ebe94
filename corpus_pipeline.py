"""A training corpus from raw documents: toxicity, near-duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet
and read again. All but the last return the columns of documents.

Defined cases, of every stage: null and empty texts stay what they are and are equal to each other as duplicates; repeated
rows are near-duplicates and repeat each other's passages, and are else treated one by one; very long texts are treated
whole; columns beyond those of documents are passed on whatever their names, up to packing, which returns pieces; an empty
table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import packing, pii, simhash_wide, substrings, toxicity
from sluice.llm.common import checkpoint_dir, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the field scores as toxic (a half or more). All labels train it."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more."""
    return simhash_wide.kept(docs, similarity=0.8, shingle=5)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the bytes of repeated 200-byte strings; parts of a character that remain at a cut go too. A null text stays null."""
    return substrings.without_repeats(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind in angle brackets; a null text stays null."""
    return _with_text(docs, _masked)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens with their ids (uint32, little-endian). A null text is an empty one."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash", remove_near_duplicates),
    ("substrings", remove_repeats),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def _masked(text: str) -> str:
    found = pii.spans(text)
    return pii.masked(text, found) if found else text


def _with_text(docs: DataFrame, change) -> DataFrame:
    """docs with `change` applied to every text that is not null, and n_chars with it where there is such a column."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if t is None else change(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else b.column(k) for k in range(len(names))], names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
