"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

A stage's result is written before the next stage begins, so each begins by deleting the tables of those before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemline.llm import lines, mixing, pieces, quality, simhash
from tandemline.llm.common import release
from tandemline.llm.queries import piece_model, table
from tandemline.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    release(spark)
    return quality.good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier line; n_chars follows the text."""
    release(spark)
    other = {c: f"__c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # whatever they are called
    found = lines.deduplicated(docs.withColumnsRenamed(other)).withColumnsRenamed({v: k for k, v in other.items() if k not in ("n_lines", "n_removed")})
    kept = [F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(other[c] if c in ("n_lines", "n_removed") else c) for c in docs.columns]
    return found.select(*[k.alias(c) for k, c in zip(kept, docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on shingles of five words."""
    release(spark)
    return simhash.drop_near_copies(docs, width=5)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated, taken once or left out, by their source's target."""
    release(spark)
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document of the mix, with their digests."""
    release(spark)
    return pieces.encoded(docs, piece_model(), texts=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mixing_sources),
    ("SentencePiece encoding", encoding),
]

#: The fit of the rules and the encoding are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    release(spark)
    return docs
