"""References to records that do not exist, on single or composite keys with nulls in them.

References are grouped by which of their key columns are null (the null mask, a column beside the key); each mask meets
the targets on its non-null columns only, under declared match semantics:

* ``simple``  - a reference with any null column refers to nothing and is never reported;
* ``partial`` - the non-null columns must all be found together in some target; all null is never reported;
* ``full``    - all columns null is fine, some null is reported as ``malformed``.

All masks share one scan and one join: a target counts once for each mask that the references have, with the columns outside
the mask taken away, and targets are reduced to one row per mask and key (earliest time, any live) before they meet the
references. The join carries
a hash of the key as a further join column: both inputs then come straight from their own exchange, which is what
adaptive execution needs to split the reference side of a key that a large part of all rows names.

Null times never make a reference late. Empty inputs give empty results. Repeated references stay repeated rows.
Columns of the references pass through whatever they are called; target columns do not appear in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def find_orphans(
    refs: DataFrame,
    targets: DataFrame,
    on: list[tuple[str, str]],
    match: str = "simple",
    ref_time: str | None = None,
    target_time: str | None = None,
    target_live: Column | None = None,
    status_col: str = "status",
) -> DataFrame:
    """The references without a good target, with ``status_col``: missing, deleted (targets, none live), late (live, but every target came after the reference) or malformed."""
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    n = len(on)
    # the references' columns travel in one struct, so that no name of theirs meets a name of ours
    held = refs.select(
        F.struct(*[F.col(f"`{c}`") for c in refs.columns]).alias("__ref"), *[F.col(f"`{r}`").alias(f"__k{i}") for i, (r, _) in enumerate(on)],
        (F.col(f"`{ref_time}`") if ref_time else F.lit(None).cast("timestamp_ntz")).alias("__at"),
    )
    ref_keys = [F.col(f"__k{i}") for i in range(n)]
    mask = sum((k.isNotNull().cast("int") * (1 << i) for i, k in enumerate(ref_keys)), F.lit(0))
    everything = (1 << n) - 1
    held = held.withColumn("__mask", mask)
    facts = targets.select(
        *[F.col(f"`{t}`").alias(f"__t{i}") for i, (_, t) in enumerate(on)],
        (F.coalesce(target_live, F.lit(False)) if target_live is not None else F.lit(True)).alias("__live"),
        (F.col(f"`{target_time}`") if target_time else F.lit(None).cast("timestamp_ntz")).alias("__first"),
    )
    if match == "partial" and n > 1:
        masks = sorted(r["__mask"] for r in held.select("__mask").distinct().collect() if r["__mask"])  # at most 2^n - 1 numbers
    else:
        masks = [everything]
    target_keys = [F.col(f"__t{i}") for i in range(n)]
    if masks == [everything]:
        facts = facts.where(" and ".join(f"__t{i} is not null" for i in range(n))).withColumn("__tm", F.lit(everything))
    else:
        facts = facts.withColumn("__tm", F.explode(F.array(*[F.lit(m) for m in masks] or [F.lit(everything)])))
        inside = [F.col("__tm").bitwiseAND(F.lit(1 << i)) != 0 for i in range(n)]
        whole = F.lit(True)
        for k, i in zip(target_keys, inside):
            whole = whole & (k.isNotNull() | ~i)
        facts = facts.where(whole)
        for i in range(n):
            facts = facts.withColumn(f"__t{i}", F.when(inside[i], target_keys[i]))
    cols = [f"__t{i}" for i in range(n)]
    found = facts.groupBy("__tm", *cols).agg(F.max("__live").alias("__live"), F.min("__first").alias("__first")).withColumn("__h", F.xxhash64("__tm", *cols))
    own = held.where(F.col("__mask") == everything) if masks == [everything] else held.where(F.col("__mask") != 0)
    left = own.withColumn("__rh", F.xxhash64("__mask", *ref_keys))
    same = [left[f"__k{i}"] == found[f"__t{i}"] if masks == [everything] else left[f"__k{i}"].eqNullSafe(found[f"__t{i}"]) for i in range(n)]
    hit = left.join(found, [left["__rh"] == found["__h"], left["__mask"] == found["__tm"], *same], "left")
    late = F.col("__first") > F.col("__at") if ref_time and target_time else F.lit(False)
    status = F.when(F.col("__live").isNull(), "missing").when(~F.col("__live"), "deleted").when(late, "late")
    out = [hit.withColumn("__status", status).where("__status is not null").select("__ref.*", F.col("__status").alias(status_col))]
    if match == "full" and n > 1:
        nulls = sum((c.isNull().cast("int") for c in ref_keys), F.lit(0))
        out.append(held.where((nulls > 0) & (nulls < n)).select("__ref.*", F.lit("malformed").alias(status_col)))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def orphan_summary(found: DataFrame) -> DataFrame:
    """Counts of orphans per table, field, period and status."""
    return found.groupBy("ref_table", "ref_field", "period", "status").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("missing_key").alias("n_keys"))
