"""Query: all documents packed into sequences of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack


def tokenizer() -> str:
    """The vocabulary of the contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer())


QUERIES = {"op6_packing": op6_packing}
ORACLE_SQL: dict[str, str] = {}
