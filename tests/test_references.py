from datetime import datetime

import pytest

from snapweave.functions.ids import id_key, id_text
from snapweave.operators.references import find_orphans, orphan_summary

T = [datetime(2024, 1, d) for d in range(1, 10)]
REFS = "n int, a string, b int, at timestamp_ntz, __t0 string"
TARGETS = "a string, b int, at timestamp_ntz, live boolean, n string"


def statuses(spark, refs, targets, **kw):
    r, t = spark.createDataFrame([(*x, "clash") for x in refs], REFS), spark.createDataFrame([(*x, "clash") for x in targets], TARGETS)
    found = find_orphans(r, t, [("a", "a"), ("b", "b")], ref_time="at", target_time="at", target_live=t["live"], **kw)
    assert found.columns == [*r.columns, "status"]
    return sorted((x["n"], x["status"]) for x in found.collect())


TARGET_ROWS = [("x", 1, T[2], True), ("x", 1, T[1], False), ("y", 2, T[1], False), ("z", 3, T[5], True), (None, 4, T[0], True), ("u", None, T[0], True), ("v", 9, None, None)]


def test_statuses_and_nulls(spark):
    refs = [(1, "x", 1, T[3]), (2, "y", 2, T[3]), (3, "z", 3, T[3]), (4, "q", 1, T[3]), (5, None, 1, T[3]), (6, "x", None, T[3]), (7, None, None, T[3]), (8, "z", 3, None), (9, "v", 9, T[3])]
    assert statuses(spark, refs, TARGET_ROWS) == [(2, "deleted"), (3, "late"), (4, "missing"), (9, "deleted")]
    assert statuses(spark, refs, TARGET_ROWS, match="full") == [(2, "deleted"), (3, "late"), (4, "missing"), (5, "malformed"), (6, "malformed"), (9, "deleted")]


def test_partial_match_uses_the_columns_that_are_known(spark):
    refs = [(1, None, 4, T[8]), (2, None, 7, T[8]), (3, "u", None, T[8]), (4, "w", None, T[8]), (5, None, 2, T[8]), (6, None, None, T[8]), (7, "x", 1, T[8])]
    assert statuses(spark, refs, TARGET_ROWS, match="partial") == [(2, "missing"), (4, "missing"), (5, "deleted")]


def test_repeats_stay_and_empty_inputs(spark):
    assert statuses(spark, [(1, "q", 1, T[0])] * 3, []) == [(1, "missing")] * 3
    assert statuses(spark, [], TARGET_ROWS) == []
    with pytest.raises(ValueError):
        statuses(spark, [], [], match="some")


def test_ids_in_either_case_and_malformed(spark):
    ids = ["AB" * 32, "ab" * 32, "ab" * 31, "zz" * 32, "", None, "é" * 64, "ab" * 40]
    rows = spark.createDataFrame([(i,) for i in ids], "i string").select("i", id_key("i").alias("k"), id_text(id_key("i")).alias("t")).collect()
    assert [r["t"] for r in rows] == [None if i is None else i.lower() for i in ids]
    assert rows[0]["k"] == rows[1]["k"] and len({bytes(r["k"]) for r in rows if r["k"] is not None}) == 6


def test_summary(spark):
    df = spark.createDataFrame([("t", "f", "r1", "k", "2024-01", "late"), ("t", "f", "r2", "k", "2024-01", "late")], "ref_table string, ref_field string, record_key string, missing_key string, period string, status string")
    assert [(r["n_refs"], r["n_keys"]) for r in orphan_summary(df).collect()] == [(2, 1)]


def test_a_hot_key_is_split_among_tasks(spark):
    """A third of all references name one key: adaptive execution must split that side of the join, in the executed plan."""
    from pyspark.sql import functions as F

    from snapweave.operators.compaction import blocks_with_file_bytes

    conf = {"skewJoin.skewedPartitionThresholdInBytes": "200k", "advisoryPartitionSizeInBytes": "200k", "skewJoin.skewedPartitionFactor": "2"}
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 20_000)
        key = lambda c: F.sha2(c.cast("string"), 256).cast("binary")
        refs = spark.range(240_000).select(F.sha2(F.col("id").cast("string"), 512).alias("n"), key(hot).alias("key"))  # n does not compress
        targets = spark.range(16_000).where("id <> 7").select(key(F.col("id")).alias("key"))
        blocks = spark.range(240_000).select(hot.cast("string").alias("f"), F.sha2(F.col("id").cast("string"), 512).alias("b"), F.lit(10).alias("n"))
        wanted = refs.join(targets, "key", "left_anti").count()
        for df, column, count in ((find_orphans(refs, targets, [("key", "key")]), "n", wanted), (blocks_with_file_bytes(blocks, "f", "b", "n"), "b", 240_000)):
            one = df.agg(F.max(column), F.count(F.lit(1)).alias("c"))
            assert one.collect()[0]["c"] == count
            final = one._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert "skew=true" in final
    finally:
        for k in conf:
            spark.conf.unset(f"spark.sql.adaptive.{k}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
