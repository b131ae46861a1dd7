"""The corpus pipeline: documents in, packed training sequences out.

Every stage but the last returns rows of its input with all their columns, whatever their names
and however many there are. Null texts count as empty; an empty table gives no rows, and an empty
labels or benchmark table rejects nothing. Long texts are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semirel.llm.blocks import ensure_checkpoint_dir
from semirel.llm.decontamination import drop_contaminated
from semirel.llm.line_dedup import line_dedup
from semirel.llm.near_copies import drop_near_copies
from semirel.llm.packing import pack, sequences, token_pieces
from semirel.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Rows that repeat a ``doc_id`` are scored one by one; a null ``doc_id`` has no label."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller ``doc_id`` holds go, no rows. A null ``doc_id`` comes last; rows that repeat an id are one document."""
    return line_dedup(docs, keep_columns=True)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest ``doc_id`` (null last). All empty texts are one group; rows of a null ``doc_id`` are only compared for equality."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also in other case or with other numbers and names, go. Rows with a null ``doc_id`` and items without usable windows reject nothing."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each row in its sequence; empty texts are one end token. Repeated rows are packed one by one."""
    pieces = token_pieces(docs)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Tokenisation, the classifier and the fingerprints have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages but the last keep. Each is written to the shared checkpoint folder and read again; what it read itself is removed then."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of what the other stages kept is packed."""
    return STAGES[-1][1](spark, _kept(spark, sf_dir), sf_dir)


def training_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sequence_id, length, ids``: the packed sequences themselves, their token ids as little-endian unsigned 32-bit numbers."""
    return sequences(pack(token_pieces(_kept(spark, sf_dir))))
