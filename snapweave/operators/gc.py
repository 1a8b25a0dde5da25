"""Garbage collection as set operations: what is referenced, what is garbage, what to repack.

Index entries: pack_id, blob_id, blob_type, length. References: snapshot_id, blob_id. Statuses of a pack, the first that
holds: ``unused`` (no blob referenced), ``obsolete`` (garbage above tolerance x greatest pack size), ``small`` (below
small_factor x greatest pack size, if at least two packs are), ``tolerated`` (some garbage), ``kept``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.session import written

MAX_PACK, TOLERANCE, SMALL_FACTOR = 16 << 20, 0.05, 0.05


def pack_bytes(index: DataFrame, refs: DataFrame) -> DataFrame:
    """(pack_id, n_ref, total, garbage): one join on the blob, one aggregate on the pack. References are reduced to
    distinct blobs before they meet the index."""
    used = refs.where("blob_id is not null").select("blob_id").distinct().withColumn("__used", F.lit(True))
    j = index.join(used, "blob_id", "left")
    unused = F.col("__used").isNull()
    return j.groupBy("pack_id").agg(F.count_if(~unused).alias("n_ref"), F.sum("length").alias("total"), F.sum(F.when(unused, F.col("length")).otherwise(0)).alias("garbage"))


def gc_plan(index: DataFrame, refs: DataFrame, most: float = MAX_PACK, tolerance: float = TOLERANCE, small_factor: float = SMALL_FACTOR) -> DataFrame:
    """(pack_id, n_ref, total, garbage, status). The bytes of the packs are written once: the count of small packs and whatever
    uses the plan read them."""
    packs = written(pack_bytes(index, refs), "pack-bytes")
    obsolete = F.col("garbage") / most > tolerance
    small = F.col("total") / most < small_factor
    merge = packs.where((F.col("n_ref") > 0) & ~obsolete & small).agg(F.count(F.lit(1)) > 1).scalar()
    status = F.when(F.col("n_ref") == 0, "unused").when(obsolete, "obsolete").when(small & merge, "small").when(F.col("garbage") > 0, "tolerated").otherwise("kept")
    return packs.select("pack_id", "n_ref", "total", "garbage", status.alias("status"))


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def repack_set(index: DataFrame, refs: DataFrame, plan: DataFrame) -> DataFrame:
    """(blob_id, pack_id): referenced blobs of obsolete and small packs, each once, from its lowest pack."""
    moving = plan.where("status in ('obsolete', 'small')").select("pack_id")
    live = index.join(moving, "pack_id", "left_semi").join(refs.select("blob_id").distinct(), "blob_id", "left_semi")
    return live.groupBy("blob_id").agg(F.min("pack_id").alias("pack_id"))


def reachable_packs(index: DataFrame, refs: DataFrame) -> DataFrame:
    """(pack_id, n_ref) of packs with a referenced blob."""
    used = refs.where("blob_id is not null").select("blob_id").distinct()
    return index.join(used, "blob_id", "left_semi").groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_ref"))


def missing_references(index: DataFrame, refs: DataFrame) -> DataFrame:
    """(snapshot_id, n_missing): references of each snapshot that the index lacks, 0 for sound snapshots."""
    known = index.select(F.col("blob_id").alias("__b")).distinct()
    j = refs.join(known, F.col("blob_id") == F.col("__b"), "left")
    return j.groupBy("snapshot_id").agg(F.count_if(F.col("blob_id").isNotNull() & F.col("__b").isNull()).alias("n_missing"))


def dangling_blobs(pack_entries: DataFrame, index: DataFrame) -> DataFrame:
    """Entries of pack headers that the index lacks."""
    return pack_entries.join(index.select("blob_id").distinct(), "blob_id", "left_anti")

