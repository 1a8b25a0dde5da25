import random

from snapweave.llm import mixing as M

COUNTS = "id long, source_name string, n_tokens long"
TARGETS = "source_name string, target_share double, max_repeats int"


def run(spark, counts, targets):
    c, t = spark.createDataFrame(counts, COUNTS), spark.createDataFrame(targets, TARGETS)
    plan = M.mixing_plan(c, t)
    chosen = M.mix(c, plan, range_rows=100)
    return {r["source_name"]: r.asDict() for r in plan.collect()}, chosen.collect(), {r["source_name"]: r.asDict() for r in M.actual_shares(chosen, plan).collect()}


def test_budgets_are_met_to_one_document(spark):
    rng = random.Random(1)
    counts = [(i, rng.choice(["a"] * 8 + ["b", "c"]), rng.randint(1, 50)) for i in range(2000)] + [(9999, "other", 10)]
    plan, chosen, shares = run(spark, counts, [(" A ", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 3), ("none", 0.0, 5)])
    budget = sum(n for _, s, n in counts if s != "other")
    size = {s: sum(n for _, x, n in counts if x == s) for s in "abc"}
    assert plan["b"]["reachable"] == (size["b"] * 2 >= 0.4 * budget) and plan["none"]["reachable"]
    for s, p in plan.items():
        got = sum(r["n_tokens"] * r["copies"] for r in chosen if r["source_name"] == s)
        assert p["taken"] - 50 <= got <= p["taken"] and shares[s]["tokens"] == got
        assert shares[s]["short"] == (not p["reachable"])
    assert all(r["copies"] <= 2 for r in chosen if r["source_name"] == "b")
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    again = run(spark, counts[::-1], [("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 3), ("none", 0.0, 5)])[1]
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))


def test_joins_without_broadcast(spark, monkeypatch):
    counts = [(i, "ab"[i % 3 == 0], 1 + i % 7) for i in range(300)]
    targets = [("a", 0.9, 1), ("b", 0.1, 2)]
    want = run(spark, counts, targets)
    monkeypatch.setattr(M, "BROADCAST_LIMIT", 0)
    got = run(spark, counts, targets)
    assert sorted(map(tuple, got[1])) == sorted(map(tuple, want[1])) and got[2]["a"]["short"] and not got[2]["b"]["short"]


def test_nulls_ties_and_empty(spark):
    plan, chosen, _ = run(spark, [(1, "a", 5)] * 4 + [(2, "b", 0)], [("a", 0.5, None), ("b", None, 2), (None, 0.5, 1)])
    assert not plan["a"]["reachable"] and plan["b"]["reachable"] and chosen == []
    plan, chosen, shares = run(spark, [], [("a", 1.0, 1)])
    assert chosen == [] and shares["a"]["actual_share"] is None
    assert run(spark, [(1, "a", 5)], [])[1] == []


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, " Wiki\n", "hello world"), (2, None, "x"), (3, "wiki", None), (4, " ", "x"), (5, "WIKI ", ""), (6, "wiki", "a" * 200_000)], "doc_id long, source string, text string").selectExpr("*", "1 as n_tokens")
    got = {r["id"]: (r["source_name"], r["n_tokens"]) for r in M.token_counts(docs, "doc_id", "source", "text").collect()}
    assert got[1] == ("wiki", 2) and got[3] == ("wiki", 0) and got[5] == ("wiki", 0) and got[6][1] > 1000 and set(got) == {1, 3, 5, 6}
