"""What changed between consecutive full snapshots, as one merge over sorted ranges.

The versions of all keys are range-partitioned by (group, key) and sorted by (group, key, version). Within a range the
rows of a key follow each other in version order, so comparing a row with the row before it is the two-pointer merge of
every version with the one before it, in one pass and one exchange: no version is read twice. Ranges hold any number of
groups or a part of one, so a group with a third of all rows spreads over ranges like the rest.

Inputs: ``rows`` has the columns group, key, version (int, 0 for the first version of its group, without gaps) and a
state column; ``last`` is the column with the group's last version number. Rows repeated under one (group, key, version)
count once, the earliest by the ``order`` column (nulls last). A null group, key or version takes no part. Two null
states are equal. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_versions(rows: DataFrame, group: str, key: str, version: str, last: str, state: str, order: str) -> DataFrame:
    """(group, key, version, change): change ``added``, ``removed`` or ``changed`` of a key in ``version`` against the version before."""
    df = rows.select(
        F.col(group).alias("g"), F.col(key).alias("k"), F.col(version).alias("v"), F.col(last).alias("top"), F.col(state).alias("s"),
        F.col(order).alias("o"),
    ).where("g is not null and k is not null and v is not null")
    df = df.repartitionByRange("g", "k")
    w = Window.partitionBy("g", "k").orderBy("v", F.col("o").asc_nulls_last())
    df = df.withColumn("again", F.lag("v").over(w) == F.col("v")).where("again is null or not again")
    df = df.select(
        "g", "k", "v", "top", "s",
        F.lag("v").over(w).alias("pv"), F.lag("s").over(w).alias("ps"), F.lead("v").over(w).alias("nv"), F.col("o"),
    )
    here = F.when(F.col("v") > 0, F.when(F.col("pv").isNull() | (F.col("pv") < F.col("v") - 1), F.lit("added")).when(~F.col("ps").eqNullSafe(F.col("s")), F.lit("changed")))
    gone = F.when((F.col("v") < F.col("top")) & (F.col("nv").isNull() | (F.col("nv") > F.col("v") + 1)), F.lit("removed"))
    events = F.filter(F.array(F.struct(F.col("v").alias("version"), here.alias("change")), F.struct((F.col("v") + 1).alias("version"), gone.alias("change"))), lambda x: x["change"].isNotNull())
    out = df.select("g", "k", events.alias("e")).where("size(e) > 0").select("g", "k", F.inline("e"))
    return out.select(F.col("g").alias(group), F.col("k").alias(key), F.col("version").alias(version), "change")
