"""Labelled training rows: a bounded sample that never holds a held-out document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 12_000


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; documents with remainder 1 are held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3


def held_out(id_col: Column) -> Column:
    """True for held-out ids; a null id is not held out."""
    return F.coalesce(remainder(id_col) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", id_col: str = "doc_id", bound: int = SAMPLE) -> DataFrame:
    """(id, text, label) of at most ``bound`` labelled documents, chosen by a hash of the id.

    Null labels and ids are left out; of several labels of an id the largest counts, of several texts the smallest.  The
    sample's ids are at most ``bound`` narrow rows, which is what is broadcast.
    """
    key = F.col(f"`{id_col}`")
    chosen = (labels.where(key.isNotNull() & F.col(f"`{label}`").isNotNull() & (remainder(key) != 1))
              .groupBy(key.alias("id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(bound))
    texts = docs.select(key.alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
