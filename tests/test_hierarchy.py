import random

import pytest

from snapweave.operators import hierarchy as H


def brute(links, roots):
    """Every position by walking from the roots."""
    below = {}
    for p, n, c in {(p, n or "", c) for p, n, c, _ in links if p is not None}:
        below.setdefault(p, []).append((n, c))
    out = []

    def walk(root, node, path, above):
        for n, c in below.get(node, ()):
            closes = c in above
            out.append((root, "/".join([*path, n]), len(path) + 1, closes))
            if c is not None and not closes:
                walk(root, c, [*path, n], above | {c})

    for r in {r for r in roots if r is not None}:
        walk(r, r, [], {r})
    return sorted(out)


def run(spark, links, roots, rows):
    k = lambda x: None if x is None else x.encode()
    df = spark.createDataFrame([(k(p), n, k(c), at, "x") for p, n, c, at in links], "p binary, n string, c binary, at long, root string")
    rs = spark.createDataFrame([(k(r),) for r in roots], "r binary")
    got = H.expand_hierarchy(df, rs, "p", "n", "c", "at", "r", fragment_rows=rows)
    return sorted((bytes(x["root"]).decode(), x["label"], x["depth"], x["closes"]) for x in got.collect())


CASES = {
    "chain": ([(f"t{i}", f"d{i}", f"t{i + 1}", i) for i in range(40)], ["t0", "t20", "t20"]),
    "shared and repeated": ([("a", "x", "s", 1), ("a", "y", "s", 2), ("s", "z", "u", 30), ("a", "x", "s", 55), ("b", "x", "s", 70)], ["a", "b"]),
    "cycles": ([("a", "x", "b", 1), ("b", "y", "c", 20), ("c", "z", "a", 40), ("c", "w", "b", 41), ("b", "self", "b", 21), ("e", "in", "c", 60)], ["a", "e", "c"]),
    "nulls": ([("a", None, "b", None), (None, "n", "b", 3), ("a", "leaf", None, 4), ("b", "unknown", "q", 90)], ["a", None, "none"]),
    "empty": ([], ["a"]),
    "no roots": ([("a", "x", "b", 1)], []),
    "wide": ([("a", f"n{i}", f"c{i % 7}", i) for i in range(60)] + [(f"c{i}", "k", f"g{i}", 100 + i) for i in range(7)], ["a"]),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("rows", [8, 100_000])
def test_against_walk(spark, name, rows):
    assert run(spark, *CASES[name], rows) == brute(*CASES[name])


def test_random_graphs_across_fragments(spark):
    rng = random.Random(4)
    links = [(f"n{i}", f"l{j}", f"n{min(14, i + rng.randint(1, 5))}" if rng.random() < 0.93 else f"n{rng.randint(0, i)}", rng.randint(0, 60)) for i in range(14) for j in range(rng.randint(0, 2))]
    assert run(spark, links, ["n0", "n3"], 10) == brute(links, ["n0", "n3"])


def test_without_locality_random_mates_contract(spark, monkeypatch):
    """Localities at random: no cut by ranges shrinks the graph, so kinship has to; with cycles and shared nodes in it."""
    rng = random.Random(5)
    links = [(f"n{i}", f"d{i}", f"n{i + 1}", rng.randint(0, 10**6)) for i in range(60)] + [("n7", "again", "n3", 5), ("n9", "side", "n40", 10**5), ("n12", "none", None, None)]
    used = []
    real = H._mated
    monkeypatch.setattr(H, "_mated", lambda df, n: used.append(n) or real(df, n))
    assert run(spark, links, ["n0", "n30"], 6) == brute(links, ["n0", "n30"])
    assert used


def test_descendants(spark):
    links = spark.createDataFrame([(b"a", "x", b"b", 1), (b"b", "y", b"c", 2)], "p binary, n string, c binary, at long")
    pos = H.expand_hierarchy(links, spark.createDataFrame([(b"a",)], "r binary"), "p", "n", "c", "at", "r")
    assert sorted((bytes(r["node"]).decode(), r["depth_below"]) for r in H.descendants(pos).collect()) == [("b", 1), ("c", 1), ("c", 2)]


@pytest.mark.parametrize("rows", [3, 100_000])
def test_reachable_nodes(spark, rows):
    from snapweave.operators.tree import reachable_nodes

    rng = random.Random(6)
    links = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 60)}", rng.choice([None, *range(40)])) for _ in range(45)] + [(f"c{i}", f"c{i + 1}", i) for i in range(25)] + [("c9", "c2", 9), (None, "x", 1), ("n1", None, 1)]
    roots = ["n1", "n5", "c3", "alone", None]
    below = {}
    for p, c, _ in links:
        below.setdefault(p, []).append(c)
    want, todo = set(), [r for r in roots if r]
    while todo:
        x = todo.pop()
        if x not in want:
            want.add(x)
            todo += [c for c in below.get(x, ()) if c]
    k = lambda x: None if x is None else x.encode()
    df = spark.createDataFrame([(k(p), k(c), at, "x") for p, c, at in links], "p binary, c binary, at long, node string")
    got = reachable_nodes(df, spark.createDataFrame([(k(r),) for r in roots], "r binary"), "p", "c", "at", "r", fragment_rows=rows).collect()
    assert sorted(bytes(r["node"]).decode() for r in got) == sorted(want)
