"""Query: language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .lattice import score


def pieces() -> str:
    """The one vocabulary at hand whose pieces have scores."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), pieces())


QUERIES = {"op10_lattice_lm": op10_lattice_lm}
ORACLE_SQL: dict[str, str] = {}
