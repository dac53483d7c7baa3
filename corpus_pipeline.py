"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import mixing, packing, pii, quality, simhash
from tallyframe.llm.common import own_folder, table
from tallyframe.llm.q_packing import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and go.  Equal documents, repeated rows among them, are judged
    alike, so there are no ties; an empty table stays empty.  Here as in all stages, columns that
    documents doesn't have are left out, whatever their names."""
    return quality.kept(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the smallest id.

    Rows without an id come last, and among equal ids the smallest digest of the text decides; of rows
    that repeat in both, one stays.  Null and empty texts have fingerprint zero and link with each other.
    An empty table stays empty."""
    return simhash.representatives(docs.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans become their kind in angle brackets; n_chars follows.

    Null texts stay null, with null n_chars; empty ones stay empty.  Repeated rows change alike.  Of
    overlapping spans the first gives the kind.  An empty table stays empty."""
    return pii.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is there as often as the mix takes it.

    Null and empty texts have no words: they cost nothing, and go with the complete epochs and with what
    lies below the budget.  Null sources are one source, the last.  Documents with equal keys go by id;
    repeated rows are told apart by order alone.  An empty table stays empty."""
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars")).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences.

    Null and empty texts are one token, the one that ends a document.  Repeated rows are packed as often
    as they occur; which of equal pieces takes which place is open.  An empty table gives no piece."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality rules", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs


#: Fingerprints and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
