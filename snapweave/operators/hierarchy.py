"""Parent-child links of unknown depth to full paths, depths, roots and cycles.

Links (parent, label, child) are cut into fragments by a locality number (rows written together lie together). Inside
its fragment every chain is contracted: from each *entry* (a root, or a node that another fragment links to) all local
positions are walked, down to the exits that lead elsewhere. Entries and exits form a smaller quotient graph with
longer labels, which is solved by the same operator; its solution (root, entry, prefix) is joined with the local
positions of the entries to give all positions. Fragments hold a bounded number of links; a node whose links lie in
several fragments (a directory with very many children) is never walked through but entered in each of them. Where cutting
by locality no longer shrinks the graph, the next contraction cuts it by random mates: a hash of the round makes half of the
nodes take in their children of the other half, which joins about a quarter of all links whatever the locality.

Cycles: a position whose node already stands above it on its own path (the root counts) is kept with ``closes`` true
and is not descended into. Local walks compare full keys; across fragments the nodes above travel as 64-bit hashes,
which would have to collide between two nodes of one path to mislead.

Shared children give one position per path. Repeated links count once. Null labels become empty strings; links with a
null parent are ignored, with a null or unknown child they are leaves. A root without links has no positions. Empty
inputs give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.session import written

_OUT = "entry binary, label string, depth int, node binary, node_h long, via array<long>, leaves boolean, closes boolean, frag long"
_BATCH = 8192


def _walk_fragment(links: dict, entries: list, frag: int, sep: str) -> Iterator[tuple]:
    """Positions below each entry inside one fragment, in depth-first order."""
    for entry in entries:
        # a frame: the links still to follow, label and depth so far, hashes above, full keys above
        stack = [(iter(links.get(entry, ())), "", 0, [], frozenset((entry,)))]
        while stack:
            todo, label, depth, via, above = stack[-1]
            for name, child, child_h, d, seg, leaves in todo:
                if len(seg) > 1 and not set(via).isdisjoint(seg):
                    continue  # this segment passes a node above: the cycle closes inside it
                here, deep, below = (label + sep + name if depth else name), depth + d, via + seg
                closes = child is not None and (child in above or (len(seg) > 1 or len(below) > depth + d) and child_h in below)
                yield entry, here, deep, child, child_h, below, leaves and not closes, closes, frag
                if not closes and not leaves and child in links:
                    stack.append((iter(links[child]), here, deep, below, above | {child}))
                    break
            else:
                stack.pop()


def _walker(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("entry", pa.binary()), ("label", pa.string()), ("depth", pa.int32()), ("node", pa.binary()), ("node_h", pa.int64()), ("via", pa.list_(pa.int64())), ("leaves", pa.bool_()), ("closes", pa.bool_()), ("frag", pa.int64())])
        now, links, entries, out = None, {}, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            for row in _walk_fragment(links, entries, now, sep):
                out.append(row)
                if len(out) == _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out.clear()

        for b in batches:
            d = b.to_pydict()
            for frag, kind, parent, label, child, child_h, depth, via, leaves in zip(d["frag"], d["kind"], d["parent"], d["label"], d["child"], d["child_h"], d["depth"], d["via"], d["leaves"]):
                if frag != now:
                    if now is not None:
                        yield from flush()
                    now, links, entries = frag, {}, []
                if kind:
                    entries.append(parent)
                else:
                    links.setdefault(parent, []).append((label, child, child_h, depth, via, leaves))
        if now is not None:
            yield from flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _mated(links: DataFrame, round_no: int) -> DataFrame:
    """``links`` in fragments of random mates: half of all nodes, by a hash of the round, take in those of the other half
    that they link to, so a node and its children come to lie in one fragment wherever they were before."""
    heads = lambda c: F.pmod(F.xxhash64(F.lit(round_no), c), F.lit(2)) == 0
    mates = links.where(heads("parent") & ~heads("child")).groupBy("child_h").agg(F.min(F.xxhash64("parent")).alias("mate")).withColumnRenamed("child_h", "__node_h")
    near = links.join(mates, (F.xxhash64("parent") == F.col("__node_h")) & ~heads("parent"), "left")
    return near.withColumn("frag", -1 - F.pmod(F.coalesce("mate", F.xxhash64("parent")), F.lit(1 << 40))).drop("mate", "__node_h")


def _merged_ranges(links: DataFrame, fragment_rows: int) -> DataFrame:
    """``links`` with neighbouring fragments merged to about ``fragment_rows`` links each; fragments by locality (from 0 up) and those by
    hash (below 0) by their own density."""
    factor = {True: 2, False: 2}
    for r in links.groupBy((F.col("frag") < 0).alias("neg")).agg(F.min("frag").alias("lo"), F.max("frag").alias("hi"), F.count(F.lit(1)).alias("n")).collect():  # two rows
        factor[r["neg"]] = max(2, (r["hi"] - r["lo"] + 1) * fragment_rows // r["n"])
    down = -1 - F.floor((-1 - F.col("frag")) / F.lit(factor[True]))
    return links.withColumn("frag", F.when(F.col("frag") < 0, down).otherwise(F.floor(F.col("frag") / F.lit(factor[False]))).cast("long"))


def _positions(links: DataFrame, roots: DataFrame, sep: str, fragment_rows: int, before: float, round_no: int = 0) -> DataFrame:
    """(root, node, label, depth, above, closes) for every position below the roots; links: parent, label, child, child_h, depth, via, frag."""
    homes = links.groupBy("parent").agg(F.min("frag").alias("home"), F.max("frag").alias("__last"))
    homes = homes.select(F.col("parent").alias("__node"), "home", (F.col("home") != F.col("__last")).alias("split"), F.xxhash64("parent").alias("__h"))
    known = written(
        links.join(homes, (links["child_h"] == homes["__h"]) & (links["child"] == homes["__node"]), "left").select(
            *links.columns, (F.coalesce(F.col("split"), F.lit(False)) | (F.coalesce(F.col("home"), F.col("frag")) != F.col("frag"))).alias("leaves")
        ),
        "links",
    )
    entries = known.where("leaves").select(F.col("child").alias("parent")).unionByName(roots.select(F.col("root").alias("parent"))).distinct()
    entries = entries.join(known.select("parent", "frag").distinct(), "parent")
    rows = known.select("frag", F.lit(0).alias("kind"), "parent", "label", "child", "child_h", "depth", "via", "leaves").unionByName(
        entries.select("frag", F.lit(1).alias("kind"), "parent", F.lit("").alias("label"), F.lit(None).cast("binary").alias("child"), F.lit(0).cast("long").alias("child_h"), F.lit(0).alias("depth"), F.array().cast("array<long>").alias("via"), F.lit(False).alias("leaves"))
    )
    local = written(rows.repartition("frag").sortWithinPartitions("frag", "kind", "parent", "label", "child").mapInArrow(_walker(sep), _OUT), "local")
    own = roots.select("root", F.col("root").alias("entry"), F.lit("").alias("prefix"), F.lit(0).alias("over"), F.array().cast("array<long>").alias("before"))
    exits = local.where("leaves")
    n_exits = exits.count()
    if n_exits:
        quotient = exits.select(F.col("entry").alias("parent"), "label", F.col("node").alias("child"), F.col("node_h").alias("child_h"), "depth", "via", "frag")
        if n_exits <= fragment_rows:
            quotient = quotient.withColumn("frag", F.lit(0).cast("long"))
        elif n_exits > 0.7 * before:  # neighbours in locality lead nowhere near each other: cut by kinship instead
            quotient = _mated(quotient, round_no)
        else:
            quotient = _merged_ranges(quotient, fragment_rows)
        inner = _positions(quotient, roots, sep, fragment_rows, n_exits, round_no + 1)
        inner = inner.where("not closes").select("root", F.col("node").alias("entry"), F.col("label").alias("prefix"), F.col("depth").alias("over"), F.col("above").alias("before"))
        own = own.unionByName(inner)
    both = own.withColumn("__oh", F.xxhash64("entry")).join(local.withColumn("__lh", F.xxhash64("entry")).withColumnRenamed("entry", "__entry"), (F.col("entry") == F.col("__entry")) & (F.col("__oh") == F.col("__lh")))
    both = both.where("over = 0 or not arrays_overlap(before, via)")
    return both.select(
        "root", "node", F.when(F.col("over") > 0, F.concat("prefix", F.lit(sep), "label")).otherwise(F.col("label")).alias("label"), (F.col("over") + F.col("depth")).alias("depth"),
        F.concat("before", "via").alias("above"), (F.col("closes") | F.coalesce(F.array_contains("before", F.col("node_h")), F.lit(False))).alias("closes"),
    )


def expand_hierarchy(links: DataFrame, roots: DataFrame, parent: str, label: str, child: str, locality: str, root: str, sep: str = "/", fragment_rows: int = 65_536) -> DataFrame:
    """(root, node, label, depth, above, closes): one row per position below each distinct root; ``label`` is the path,
    ``above`` the hashes of the nodes above, the root first. ``locality`` is a long that is close for rows often
    reached together; ``fragment_rows`` values of it make a fragment; links without one are spread by hash. Keys are binary."""
    k = F.col(f"`{child}`").cast("binary")
    edges = links.where(F.col(f"`{parent}`").isNotNull()).groupBy(F.col(f"`{parent}`").cast("binary").alias("parent"), F.coalesce(F.col(f"`{label}`"), F.lit("")).alias("label"), k.alias("child")).agg(F.min(F.col(f"`{locality}`").cast("long")).alias("__at"))
    edges = edges.select(
        "parent", "label", "child", F.when(F.col("child").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("child")).alias("child_h"), F.lit(1).alias("depth"),
        F.array(F.xxhash64("parent")).alias("via"), F.coalesce(F.floor(F.abs("__at") / F.lit(fragment_rows)).cast("long"), -1 - F.pmod(F.xxhash64("parent"), F.lit(1 << 40))).alias("frag"),
    )
    starts = roots.where(F.col(f"`{root}`").isNotNull()).select(F.col(f"`{root}`").cast("binary").alias("root")).distinct()
    return _positions(edges, starts, sep, fragment_rows, float("inf"))


def descendants(positions: DataFrame) -> DataFrame:
    """(root, ancestor_h, node, depth_below): every node below every node above it, from positions; ancestors as hashes, the root's among them."""
    return positions.select("root", "node", "depth", F.posexplode("above").alias("__i", "ancestor_h")).select("root", "ancestor_h", "node", (F.col("depth") - F.col("__i")).alias("depth_below"))
