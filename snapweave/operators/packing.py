"""Filling packs and index files in a given order, and what follows from it.

A pack takes blobs until its size exceeds the greatest size; the blob that exceeds it is its last. The fill starts anew
after each pack, so it depends on all before it: it runs as a sequential fold, one task per stream. ``writer_streams``
gives each blob type as many streams as there are pack writers, each filling packs of its own; one stream gives the
strictly sequential fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapweave.session import written

MAX_PACK, MAX_INDEX_BLOBS = 16 << 20, 65_535


def assign_packs(blobs: DataFrame, stream_col: str, order_col: str, size_col: str, most: int = MAX_PACK, inclusive: bool = False) -> DataFrame:
    """(stream, order, size, pack): the number of the pack in its stream. ``inclusive`` closes a pack at ``most``, not above it.

    Rows stream through: the partition is sorted and folded batch by batch, nothing of a stream is held. Null sizes count
    0; ties of the order go by size."""
    df = blobs.select(F.col(stream_col).alias("stream"), F.col(order_col).alias("ord"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pack, filled = object(), 0, 0
        for b in batches:
            packs = []
            for s, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if s != now:
                    now, pack, filled = s, 0, 0
                packs.append(pack)
                filled += n
                if filled > most or (inclusive and filled >= most):
                    pack, filled = pack + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(packs, pa.int64())], names=["stream", "ord", "size", "pack"])

    out = df.repartition("stream").sortWithinPartitions("stream", "ord", "size").mapInArrow(run, f"stream {kinds['stream']}, ord {kinds['ord']}, size long, pack long")
    return out.select(F.col("stream").alias(stream_col), F.col("ord").alias(order_col), F.col("size").alias(size_col), "pack")


def writer_streams(blobs: DataFrame, type_col: str, order_col: str, writers: int) -> DataFrame:
    """Adds ``stream``: the blob type and one of ``writers`` numbers by hash of the order column."""
    return blobs.withColumn("stream", F.concat_ws("-", F.col(type_col), F.pmod(F.xxhash64(order_col), F.lit(writers)).cast("string")))


def with_offsets(blobs: DataFrame, pack_col: str, order: list[str], size_col: str) -> DataFrame:
    """Adds ``offset``: the bytes before a blob in its pack."""
    w = Window.partitionBy(pack_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return blobs.withColumn("offset", (F.sum(size_col).over(w) - F.col(size_col)).cast("long"))


def nested_index(entries: DataFrame) -> DataFrame:
    """(pack_id, n_blobs, bytes, blobs): the entries of each pack as a sorted array."""
    blobs = F.array_sort(F.collect_list(F.struct("offset", "blob_id", "blob_type", "length")))
    return entries.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_blobs"), F.sum("length").alias("bytes"), blobs.alias("blobs"))


def merge_indexes(entries: DataFrame, most: int = MAX_INDEX_BLOBS) -> DataFrame:
    """(pack_id, n_blobs, index_no): each pack once, whatever indexes list it, in index files of about ``most`` blobs.

    Packs go in order of (three hex digits of the SHA-256 of the id, id); a file number is the two-level prefix sum of blobs
    over ``most``, so packs are never all in one task and a file exceeds ``most`` by less than one pack."""
    packs = entries.dropDuplicates(["pack_id", "blob_id"]).groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_blobs"))
    packs = packs.withColumn("__r", F.substring(F.sha2(F.col("pack_id").cast("string"), 256), 1, 3))
    base = packs.groupBy("__r").agg(F.sum("n_blobs").alias("t"))
    base = base.select("__r", (F.sum("t").over(Window.partitionBy(F.lit(0)).orderBy("__r")) - F.col("t")).alias("__base"))  # at most 4,096 rows, so the broadcast below is bounded
    inside = F.sum("n_blobs").over(Window.partitionBy("__r").orderBy("pack_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_blobs")
    return packs.withColumn("__in", inside).join(F.broadcast(base), "__r").select("pack_id", "n_blobs", F.floor((F.col("__in") + F.col("__base")) / F.lit(most)).cast("long").alias("index_no"))


def ordered_positions(df: DataFrame, order: list, out_col: str = "position") -> DataFrame:
    """``df`` with the place of each row in the whole order, from 0. Rows are range-partitioned and written, numbered within a
    range and shifted by the counts of the ranges before it: no task sees all rows. Equal rows of the order take any of their places."""
    keys = [f"__o{i}" for i in range(len(order))]
    placed = df.select("*", *[c.alias(k) for c, k in zip(order, keys)]).repartitionByRange(*keys).withColumn("__p", F.spark_partition_id())
    placed = written(placed, "positions")
    counts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("__p", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__p")) - F.col("n")).alias("__base"))  # one row per range
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*keys)) - 1
    return placed.withColumn("__i", place).join(base, "__p").withColumn(out_col, F.col("__i") + F.col("__base")).drop("__p", "__i", "__base", *keys)


def first_seen_ordinals(df: DataFrame, value_col: str, seq_col: str) -> DataFrame:
    """(value, ordinal): values numbered from 0 in the order in which they first appear; ties by value, nulls left out.

    Firsts are range-partitioned and written, so that their places stay the same, then numbered within a range and shifted
    by the counts of the ranges before it: no task sees all values."""
    firsts = df.where(F.col(value_col).isNotNull()).groupBy(value_col).agg(F.min(seq_col).alias("__first"))
    placed = written(firsts.repartitionByRange("__first", value_col).withColumn("__p", F.spark_partition_id()), "ordinals")
    counts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("__p", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__p")) - F.col("n")).alias("__base"))  # one row per range
    place = F.row_number().over(Window.partitionBy("__p").orderBy("__first", value_col)) - 1
    return placed.withColumn("__i", place).join(F.broadcast(base), "__p").select(value_col, (F.col("__i") + F.col("__base")).alias("ordinal"))
