"""Difference of two listings: one full outer join on the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields whose change makes a node changed.
COMPARED = ["modified_time", "size", "mode"]


def changed(fields: list[str], a: str = "p", b: str = "n") -> Column:
    """Null-safe inequality of any field."""
    out = F.lit(False)
    for f in fields:
        out = out | ~F.col(f"{a}_{f}").eqNullSafe(F.col(f"{b}_{f}"))
    return out


def diff_nodes(prev: DataFrame, nxt: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(path, status, symbol, p_*, n_*) for listings with path, node_type, content_id, size and the compared fields.

    status: new, deleted, changed, unchanged. symbol: + and - for new and deleted; for changed T where the type differs,
    M where the content does, m otherwise; for unchanged U, or ? where the content differs all the same. Rows repeated
    under one path are joined as they are: listings have each path once. Null paths match nothing.
    """
    fields = fields or COMPARED
    cols = list(dict.fromkeys(["node_type", "content_id", "size", *fields]))
    a = prev.select(F.col("path").alias("p_path"), *[F.col(c).alias(f"p_{c}") for c in cols])
    b = nxt.select(F.col("path").alias("n_path"), *[F.col(c).alias(f"n_{c}") for c in cols])
    j = a.join(b, F.col("p_path") == F.col("n_path"), "full_outer")
    status = F.when(F.col("p_path").isNull(), "new").when(F.col("n_path").isNull(), "deleted").when(changed(fields), "changed").otherwise("unchanged")
    same = F.col("p_content_id").eqNullSafe(F.col("n_content_id"))
    symbol = (
        F.when(status == "new", "+").when(status == "deleted", "-")
        .when(status == "changed", F.when(~F.col("p_node_type").eqNullSafe(F.col("n_node_type")), "T").when(same, "m").otherwise("M"))
        .otherwise(F.when(same, "U").otherwise("?"))
    )
    return j.select(F.coalesce("n_path", "p_path").alias("path"), status.alias("status"), symbol.alias("symbol"), *[f"{s}_{c}" for s in "pn" for c in cols])


def diff_counts(diff: DataFrame) -> DataFrame:
    """(symbol, n, bytes): bytes of the later state, of the earlier one for deleted nodes."""
    return diff.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("n_size", "p_size")).alias("bytes"))


def diff_by_kind(diff: DataFrame) -> DataFrame:
    """Counts of each status for files and directories; every node that is no directory counts as a file."""
    kind = F.coalesce("n_node_type", "p_node_type")
    return diff.groupBy("status", F.when(kind == "directory", "dir").otherwise("file").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def apply_diff(prev: DataFrame, diff: DataFrame, nxt: DataFrame) -> DataFrame:
    """The later listing, rebuilt from the earlier one and the rows of ``nxt`` that the diff names as new or changed."""
    keep = prev.join(diff.where("status = 'unchanged'").select("path"), "path", "left_semi")
    fresh = nxt.join(diff.where("status in ('new', 'changed')").select("path"), "path", "left_semi")
    return keep.unionByName(fresh)
