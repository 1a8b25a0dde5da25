"""Trees over paths: Merkle ids from the leaves up, listings, rewrites.

A tree's id is the hash of its children's lines (name, type and id, by name). Levels are closed from the deepest up,
one exchange each; every level is written to the shared folder, so plans stay short and lost executors cost one level.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapweave.functions.paths import ancestors, name_of, parent_of, path_included
from snapweave.session import written


def with_directories(files: DataFrame) -> DataFrame:
    """(path, node_type, size, content_id): the files and every directory above them, without the root."""
    own = files.where("path is not null").select("path", "node_type", "size", "content_id")
    dirs = own.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return own.unionByName(dirs.select("path", F.lit("directory").alias("node_type"), F.lit(None).cast(own.schema["size"].dataType).alias("size"), F.lit(None).cast("string").alias("content_id")))


def tree_ids(files: DataFrame) -> DataFrame:
    """(path, tree_id) of every directory above the files, the root as '/'."""
    own = files.where("path is not null").select(F.col("path"), F.size(F.split("path", "/")).alias("depth"), F.col("node_type").alias("kind"), F.coalesce("content_id", F.lit("")).alias("id"))
    waiting = written(own.repartition("depth", F.pmod(F.xxhash64("path"), F.lit(64))), "tree-files", ["depth"])  # a level reads its own folder only
    deepest = waiting.agg(F.max("depth")).first()[0]
    done: DataFrame | None = None
    above: DataFrame | None = None
    for depth in range(deepest or 1, 1, -1):
        level = waiting.where(F.col("depth") == depth).select("path", "kind", "id")
        if above is not None:
            level = level.unionByName(above.select("path", F.lit("directory").alias("kind"), F.col("tree_id").alias("id")))
        line = F.concat_ws("|", name_of(F.col("path")), "kind", "id")
        ids = level.groupBy(parent_of(F.col("path")).alias("parent")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("tree_id"))
        above = written(ids.select(F.col("parent").alias("path"), "tree_id"), "tree-level")
        done = above if done is None else done.unionByName(above)
    return done if done is not None else files.sparkSession.createDataFrame([], "path string, tree_id string")


def amend(files: DataFrame, exclude: list[str]) -> DataFrame:
    """(path, tree_id) of the tree without the excluded paths."""
    return tree_ids(files.where(path_included(F.col("path"), None, exclude)))


def list_directory(nodes: DataFrame, path: str, recursive: bool = False) -> DataFrame:
    """Children of ``path``, or all below it."""
    p = F.col("path")
    here = p.startswith(path.rstrip("/") + "/")
    return nodes.where(here if recursive else here & (parent_of(p) == (path.rstrip("/") or "/")))


def replace_children(children: DataFrame, tree_col: str, name_col: str, seq_col: str) -> DataFrame:
    """Each name of a tree once, the last put by ``seq_col``; columns stay. Rows tied on it are ranked by their hash."""
    others = [c for c in children.columns if c not in (tree_col, name_col, seq_col)]
    w = Window.partitionBy(tree_col, name_col).orderBy(F.desc(seq_col), F.xxhash64(*others) if others else F.lit(0))
    return children.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, frag) of all nodes reached from the entries of each fragment; rows come by fragment, links (kind 0) before entries (kind 1)."""
    now, links, reached = None, {}, set()

    def out() -> Iterator[pa.RecordBatch]:
        rows = list(reached)
        for at in range(0, len(rows), 8192):
            part = rows[at : at + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([now] * len(part), pa.int64())], names=["node", "frag"])

    for b in batches:
        for frag, kind, parent, child in zip(*(b.column(i).to_pylist() for i in range(4))):
            if frag != now:
                yield from out()
                now, links, reached = frag, {}, set()
            if not kind:
                links.setdefault(parent, []).append(child)
                continue
            todo = [parent]
            while todo:
                node = todo.pop()
                if node not in reached:
                    reached.add(node)
                    todo += links.get(node, ())
    yield from out()


def reachable_nodes(links: DataFrame, roots: DataFrame, parent: str, child: str, locality: str, root: str, fragment_rows: int = 65_536) -> DataFrame:
    """(node) of the roots and everything below them, each once. Keys are binary; nulls take no part; cycles do no harm.

    Links lie in fragments by locality. In each round the fragments that have new entries are searched from them, each by
    one task; what is reached enters the other fragments it has links in. A node is expanded once per fragment, however many
    paths lead to it, and the rounds are the crossings from fragment to fragment on the longest path, not its steps."""
    edges = links.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).groupBy(F.col(parent).alias("parent"), F.col(child).alias("child")).agg(F.min(F.col(locality).cast("long")).alias("at"))
    edges = written(edges.select(F.coalesce(F.floor(F.col("at") / F.lit(fragment_rows)).cast("long"), -1 - F.pmod(F.xxhash64("parent"), F.lit(1 << 20))).alias("frag"), F.lit(0).alias("kind"), "parent", "child"), "reach-links")
    homes = written(edges.select(F.col("parent").alias("node"), "frag").distinct(), "reach-homes")
    none = F.lit(None).cast("binary").alias("child")
    nodes = written(roots.select(F.col(root).alias("node")).where("node is not null").distinct(), "reach-roots")
    entries = written(nodes.join(homes, "node").select("node", "frag"), "reach-entries")
    seen: DataFrame | None = None  # (node, frag): reached and expanded there
    while not entries.isEmpty():
        rows = edges.join(entries.select("frag").distinct(), "frag", "left_semi").unionByName(entries.select("frag", F.lit(1).alias("kind"), F.col("node").alias("parent"), none))
        got = rows.repartition("frag").sortWithinPartitions("frag", "kind").select("frag", "kind", "parent", "child").mapInArrow(_spread, "node binary, frag long")
        got = written(got if seen is None else got.join(seen, ["node", "frag"], "left_anti"), "reached")
        seen = got if seen is None else seen.unionByName(got)
        entries = written(got.select("node").distinct().join(homes, "node").join(seen, ["node", "frag"], "left_anti").select("node", "frag"), "reach-entries")
    return nodes if seen is None else nodes.unionByName(seen.select("node")).distinct()
