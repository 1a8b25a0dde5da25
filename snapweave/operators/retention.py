"""Which snapshots to keep. Rules flag rows; a snapshot stays if any rule keeps it.

Snapshots need the columns repo, snapshot_id and ts. Newest first means ts descending, then id descending, everywhere.
Null times are oldest. Rules rank within a repo.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = {
    "yearly": lambda ts: F.year(ts).cast("string"),
    "monthly": lambda ts: F.date_format(ts, "yyyy-MM"),
    "weekly": lambda ts: F.format_string("%04d-%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts)),
    "daily": lambda ts: F.date_format(ts, "yyyy-MM-dd"),
}


def _newest():
    return Window.partitionBy("repo").orderBy(F.desc("ts"), F.desc("snapshot_id"))


def keep_last(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(_newest())).where(F.col("__r") <= n).drop("__r")


def keep_within(df: DataFrame, seconds: int, now: datetime) -> DataFrame:
    """Snapshots at most ``seconds`` older than ``now``, which is a parameter, never the clock."""
    return df.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.make_interval(secs=F.lit(seconds)))


def keep_bucket(df: DataFrame, bucket: str, n: int) -> DataFrame:
    """The newest snapshot of each of the ``n`` newest calendar buckets: yearly, monthly, weekly (ISO) or daily."""
    key = BUCKETS[bucket](F.col("ts"))
    w = Window.partitionBy("repo", "__b").orderBy(F.desc("ts"), F.desc("snapshot_id"))
    first = df.withColumn("__b", key).where("__b is not null").withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return first.withColumn("__k", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("__b")))).where(F.col("__k") <= n).drop("__b", "__r", "__k")


def has_tags(tags: Column, wanted: list[str]) -> Column:
    """Any of the wanted tags; "[]" means untagged; an empty list matches nothing."""
    if not wanted:
        return F.lit(False)
    some = F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(w) for w in wanted])), F.lit(False))
    return some | (F.coalesce(F.size(tags), F.lit(0)) <= 0) if "[]" in wanted else some


def keep_tags(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.where(has_tags(F.col("tags"), wanted))


def forget_plan(df: DataFrame, kept: list[DataFrame]) -> DataFrame:
    """(repo, snapshot_id, keep): keep where any rule kept the snapshot."""
    ids = None
    for k in kept:
        one = k.select("repo", "snapshot_id")
        ids = one if ids is None else ids.unionByName(one)
    if ids is None:
        return df.select("repo", "snapshot_id", F.lit(False).alias("keep"))
    ids = ids.distinct().withColumn("keep", F.lit(True))
    return df.select("repo", "snapshot_id").join(ids, ["repo", "snapshot_id"], "left").select("repo", "snapshot_id", F.coalesce("keep", F.lit(False)).alias("keep"))


def latest(df: DataFrame) -> DataFrame:
    """The newest snapshot of each repo, by one aggregate."""
    return df.groupBy("repo").agg(F.max(F.struct("ts", "snapshot_id")).alias("x")).select("repo", "x.snapshot_id", "x.ts")


def find_by_prefix(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """(prefix, n_matches, status): ok, none, ambiguous, or invalid for an empty or too long prefix; letter case does not count."""
    asked = df.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(prefixes)], "prefix string")
    lengths = sorted({len(p) for p in prefixes if 0 < len(p) <= 64}) or [64]
    cut = F.explode(F.array(*[F.substring(F.lower("snapshot_id"), 1, n) for n in lengths])).alias("cut")
    hits = asked.join(df.select("snapshot_id", cut).distinct(), F.lower("prefix") == F.col("cut"), "left")
    found = hits.groupBy("prefix").agg(F.count("snapshot_id").alias("n_matches"))
    status = F.when((F.length("prefix") == 0) | (F.length("prefix") > 64), "invalid").when(F.col("n_matches") == 0, "none").when(F.col("n_matches") == 1, "ok").otherwise("ambiguous")
    return found.withColumn("status", status)
