"""Exact de-duplication of chunks by content id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_blobs(chunks: DataFrame, known: DataFrame, id_col: str = "chunk_id", known_col: str | None = None) -> DataFrame:
    """One row per content id that ``known`` lacks: claims each id exactly once, in the batch and against the index. Null ids are left out."""
    fresh = chunks.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return fresh.join(known.select(F.col(known_col or id_col).alias("__k")).distinct(), F.col(id_col) == F.col("__k"), "left_anti")


def dedup_stats(chunks: DataFrame, id_col: str = "chunk_id", len_col: str = "len") -> DataFrame:
    """References, distinct chunks and the bytes of both; sums are taken per id first, so a frequent chunk is one row early."""
    per = chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.max(len_col).alias("l"))
    return per.agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_unique"), F.sum(F.col("n") * F.col("l")).alias("raw_bytes"), F.sum("l").alias("unique_bytes"))


def blob_lookup(wanted: DataFrame, index: DataFrame, id_col: str = "blob_id") -> DataFrame:
    """Location of each wanted id: the data entry before the tree entry, then the lowest pack and offset. The least is found with a partial aggregate, so an id in very many packs is one row early."""
    others = [c for c in index.columns if c not in (id_col, "pack_id", "offset")]
    place = F.min(F.struct(F.when(F.col("blob_type") == "data", 0).otherwise(1).alias("__k"), "pack_id", "offset", *others))
    first = index.groupBy(id_col).agg(place.alias("__x")).select(id_col, "__x.*").drop("__k")
    return first.join(wanted.select(id_col).distinct(), id_col, "left_semi").select(index.columns)
