import random

from snapweave.operators.snapshot_changes import merge_versions

SCHEMA = "g string, k string, v int, top int, s string, o int, change string"


def brute(rows):
    first = {}
    for g, k, v, top, s, o, _ in rows:
        if None not in (g, k, v):
            key = (g, k, v)
            rank = (o is None, o)
            if key not in first or rank < first[key][0]:
                first[key] = (rank, s, top)
    out = []
    for (g, k, v), (_, s, top) in first.items():
        if v > 0:
            if (g, k, v - 1) not in first:
                out.append((g, k, v, "added"))
            elif first[(g, k, v - 1)][1] != s:
                out.append((g, k, v, "changed"))
        if v < top and (g, k, v + 1) not in first:
            out.append((g, k, v + 1, "removed"))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in merge_versions(df, "g", "k", "v", "top", "s", "o").collect())


def test_changes_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, f"k{k}", v, 5, rng.choice(["a", "b", None]), rng.choice([1, 2, None]), "x") for g in ("one", "two") for k in range(12) for v in range(6) if rng.random() < 0.7]
    rows += [(g, k, v, top, s, 9, "later") for g, k, v, top, s, o, _ in rows[::3] if o is not None]
    assert run(spark, rows) == brute(rows)


def test_nulls_one_version_and_empty(spark):
    rows = [(None, "k", 0, 1, "a", 1, ""), ("g", None, 0, 1, "a", 1, ""), ("g", "k", None, 1, "a", 1, ""), ("h", "k", 0, 0, "a", 1, "")]
    assert run(spark, rows) == []
    assert run(spark, []) == []
    assert run(spark, [("g", "k", 0, 1, None, 1, ""), ("g", "k", 1, 1, None, 1, "")]) == []


def test_both_ways_of_joining_versions_give_the_same(spark, monkeypatch):
    """Versions are broadcast only if they are measured to be small; the way beyond the limit is taken here with a limit of nothing."""
    from snapweave import session
    from snapweave.plans.store_checks import p5_found

    def found():
        df = p5_found(spark, "/root/testdata/sf0.001")
        return df._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, df.collect()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan, small = found()
        assert "BroadcastHashJoin" in plan and small
        monkeypatch.setattr(session, "BROADCAST_LIMIT", 0)
        plan, large = found()
        assert "BroadcastHashJoin" not in plan and large == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
