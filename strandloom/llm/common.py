"""Shared plumbing of the training-data operators: table access, durable cuts, word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import durable as cuts
from ..plans.durable import bucketed, discard
from ..shipping import ship

#: The six ASCII white-space characters that separate words everywhere in this subpackage.
SPACES = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["SPACES", "WORD", "bucketed", "crc_of_id", "discard", "durable", "ship", "table", "text_or_empty", "words_of"]


def durable(df: DataFrame) -> DataFrame:
    """A cut that also lets Spark drop the shuffle files behind it."""
    return cuts.durable(df, sweep=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def crc_of_id(id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z only; split at the six ASCII spaces, which is what bytes.split() does."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
