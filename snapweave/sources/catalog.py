"""A store of snapshots as Parquet tables in one folder, with the commands on it.

Tables: snapshots (one row each, written last, so a snapshot is there whole or not at all), nodes (by snapshot), blobs
(bytes by id, in partitions of the pack's first hex digits), index (blob, pack, offset, length), removed (forgotten ids).
Ids of blobs are never reused; ``clean`` writes new index and blob tables beside the old ones and then moves the pointer.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.functions.paths import filter_paths
from snapweave.operators import chunking, dedup, diff, gc, packing, retention, tree
from snapweave.operators.compaction import _files
from snapweave.session import written

VERSION = 1
_NODES = "path string, node_type string, size long, mode int, modified_time timestamp_ntz, content_id string, snapshot_id string"
_SCHEMAS = {
    "snapshots": "snapshot_id string, repo long, ts timestamp_ntz, parent string, tree string, root string, paths array<string>, tags array<string>, description string, n_files long, bytes long, added_bytes long",
    "nodes": _NODES,
    "node_blobs": "path string, seq int, blob_id string, snapshot_id string",
    "index": "blob_id string, blob_type string, pack_id string, offset long, length long",
    "blobs": "blob_id string, content binary, prefix string",
    "removed": "snapshot_id string",
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, self.path = _files(self.root)
        state = self._state()
        if state["version"] != VERSION:
            raise ValueError(f"version {state['version']} is not supported")

    @classmethod
    def init(cls, spark: SparkSession, root: str, version: int = VERSION) -> Store:
        if version != VERSION:
            raise ValueError(f"version {version} is not supported")
        fs, path = _files(root.rstrip("/"))
        from pyarrow import fs as pafs

        if fs.get_file_info(f"{path}/manifest.json").type != pafs.FileType.NotFound:
            raise FileExistsError(root)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/manifest.json") as f:
            f.write(json.dumps({"version": version, "generation": 0}).encode())
        return cls(spark, root)

    def _state(self) -> dict:
        with self.fs.open_input_stream(f"{self.path}/manifest.json") as f:
            return json.loads(f.read())

    def _dir(self, table: str) -> str:
        return f"{self.root}/{table}-{self._state()['generation']}" if table in ("index", "blobs") else f"{self.root}/{table}"

    def table(self, name: str) -> DataFrame:
        from pyarrow import fs as pafs

        if self.fs.get_file_info(_files(self._dir(name))[1]).type == pafs.FileType.NotFound:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(_SCHEMAS[name]).parquet(self._dir(name))

    def _append(self, df: DataFrame, name: str, by: str | None = None) -> None:
        w = df.select(*[c.split()[0] for c in _SCHEMAS[name].split(", ")]).write.mode("append").option("compression", "zstd")
        (w.partitionBy(by) if by else w).parquet(self._dir(name))

    def snapshots(self) -> DataFrame:
        return self.table("snapshots").join(self.table("removed").distinct(), "snapshot_id", "left_anti")

    def select(self, which: str, repo: int = 0) -> str | None:
        """The id of "latest" or of a unique prefix; None when the store is empty and latest is asked."""
        if which.lower() == "latest":
            rows = retention.latest(self.snapshots().where(F.col("repo") == repo)).collect()
            return rows[0]["snapshot_id"] if rows else None
        rows = self.snapshots().where(F.col("snapshot_id").startswith(which.lower())).select("snapshot_id").limit(2).collect() if 0 < len(which) <= 64 else []
        if len(rows) != 1:
            raise KeyError(f"{which!r} names {'no' if not rows else 'more than one'} snapshot")
        return rows[0]["snapshot_id"]

    def nodes(self, snapshot_id: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        return filter_paths(self.table("nodes").where(F.col("snapshot_id") == snapshot_id), "path", include, exclude).drop("snapshot_id")

    def snapshot(self, files: DataFrame, ts: datetime, repo: int = 0, tags: list[str] | None = None, description: str | None = None, exclude: list[str] | None = None, parent: str | None = "latest", dry_run: bool = False, chunk_sizes: tuple[int, int, int] = (chunking.MIN_CHUNK, chunking.AVG_CHUNK, chunking.MAX_CHUNK)) -> dict:
        """Stores ``files`` (path, node_type, size, mode, modified_time, content). Only new and changed files are chunked;
        unchanged ones take the chunks of the parent. Returns the new id and what was added; a dry run writes nothing."""
        files = filter_paths(files, "path", None, exclude)
        files = files.withColumn("content", F.col("content").cast("binary")).withColumn("content_id", F.sha2("content", 256))
        before = self.select(parent, repo) if parent else None
        old = self.nodes(before) if before else self.spark.createDataFrame([], _NODES).drop("snapshot_id")
        changes = diff.diff_nodes(old, files)
        work = files.join(changes.where("status in ('new', 'changed')").select("path"), "path", "left_semi")
        cut = written(chunking.content_chunks(work.where("node_type = 'file'"), "path", F.col("content"), *chunk_sizes), "chunks")
        fresh = dedup.new_blobs(cut, self.table("index"), "chunk_id", "blob_id")
        totals = fresh.agg(F.sum("len")).first()[0] or 0
        summary = files.agg(F.count_if(F.col("node_type") == "file"), F.sum("size")).first()
        trees = tree.tree_ids(files)
        root_tree = (trees.where("path = '/'").select("tree_id").first() or [None])[0]
        ident = self.spark.range(1).select(F.sha2(F.concat_ws("|", F.lit(str(repo)), F.lit(ts.isoformat()), F.lit(before or ""), F.lit(root_tree or ""), F.lit(",".join(sorted(tags or []))), F.lit(description or "")), 256)).first()[0]
        report = {"snapshot_id": ident, "parent": before, "n_files": summary[0], "bytes": summary[1] or 0, "added_bytes": totals}
        if dry_run:
            return report
        data = cut.join(work.select("path", "content"), "path").select("chunk_id", F.substring(F.col("content"), F.col("offset").cast("int") + 1, F.col("len").cast("int")).alias("data"))
        placed = packing.assign_packs(fresh.withColumn("stream", F.lit("data")), "stream", "chunk_id", "len")
        placed = placed.withColumn("pack_id", F.sha2(F.concat_ws("|", F.lit(ident), "stream", F.col("pack").cast("string")), 256))
        placed = packing.with_offsets(placed, "pack_id", ["chunk_id"], "len")
        entries = written(placed.select(F.col("chunk_id").alias("blob_id"), F.lit("data").alias("blob_type"), "pack_id", "offset", F.col("len").alias("length")), "entries")
        stored = data.dropDuplicates(["chunk_id"]).join(entries.select(F.col("blob_id").alias("chunk_id"), "pack_id"), "chunk_id")
        self._append(stored.select(F.col("chunk_id").alias("blob_id"), F.col("data").alias("content"), F.substring("pack_id", 1, 2).alias("prefix")), "blobs", "prefix")
        self._append(entries, "index")
        carried = self.table("node_blobs").where(F.col("snapshot_id") == F.lit(before)).join(changes.where("status = 'unchanged'").select("path"), "path", "left_semi")
        lists = cut.select("path", "seq", F.col("chunk_id").alias("blob_id")).unionByName(carried.select("path", "seq", "blob_id"))
        self._append(lists.withColumn("snapshot_id", F.lit(ident)), "node_blobs", "snapshot_id")
        self._append(files.withColumn("snapshot_id", F.lit(ident)), "nodes", "snapshot_id")
        self._publish(ident, repo, ts, before, root_tree, tags, description, report)
        return report

    def _publish(self, ident, repo, ts, parent, root_tree, tags, description, report) -> None:
        row = [(ident, repo, ts, parent, root_tree, "/", ["/"], sorted(set(tags or [])), description, report["n_files"], report["bytes"], report["added_bytes"])]
        self._append(self.spark.createDataFrame(row, _SCHEMAS["snapshots"]).coalesce(1), "snapshots")

    def restore(self, snapshot_id: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        """(path, node_type, content): files put together from their chunks."""
        nodes = self.nodes(snapshot_id, include, exclude)
        parts = self.table("node_blobs").where(F.col("snapshot_id") == snapshot_id).join(nodes.select("path"), "path", "left_semi")
        parts = parts.join(self.table("blobs").select("blob_id", "content"), "blob_id")
        whole = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("p"))
        joined = whole.select("path", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["content"])).alias("content"))
        return nodes.select("path", "node_type").join(joined, "path", "left")

    def log(self, tags: list[str] | None = None) -> DataFrame:
        df = self.snapshots()
        return (df if tags is None else retention.keep_tags(df, tags)).orderBy("ts", "snapshot_id")

    def ls(self, snapshot_id: str, path: str = "/", recursive: bool = False) -> DataFrame:
        return tree.list_directory(tree.with_directories(self.nodes(snapshot_id)), path, recursive).orderBy(F.lower("path"))

    def diff(self, a: str, b: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        return diff.diff_nodes(self.nodes(a, include, exclude), self.nodes(b, include, exclude))

    def cat(self, kind: str, ident: str | None = None) -> DataFrame:
        """Objects as JSON text: manifest, snapshot, tree (a snapshot's nodes), index, pack (its entries) or blob."""
        if kind == "manifest":
            return self.spark.createDataFrame([(json.dumps(self._state()),)], "json string")
        name, column = {"snapshot": ("snapshots", "snapshot_id"), "tree": ("nodes", "snapshot_id"), "index": ("index", None), "pack": ("index", "pack_id"), "blob": ("blobs", "blob_id")}[kind]
        df = self.snapshots() if name == "snapshots" else self.table(name)
        df = df if column is None or ident is None else df.where(F.col(column) == ident.lower())
        return df.select(F.to_json(F.struct("*")).alias("json"))

    def forget(self, ids: DataFrame) -> None:
        """Marks snapshots (snapshot_id) as removed; their rows stay until ``clean``."""
        asked = written(ids.select(F.lower("snapshot_id").alias("snapshot_id")).where("snapshot_id is not null").distinct(), "asked")
        unknown = asked.join(self.snapshots().select("snapshot_id"), "snapshot_id", "left_anti").take(1)
        if unknown:
            raise KeyError(f"{unknown[0][0]!r} names no snapshot")
        self._append(asked, "removed")

    def forget_by(self, keep: list, dry_run: bool = False, clean: bool = False) -> DataFrame:
        """Forgets the snapshots that no rule keeps; ``keep``: functions from the snapshots to those kept, as in operators.retention.
        Returns the plan (snapshot_id, keep); a dry run changes nothing; ``clean`` collects the garbage at once."""
        known = self.snapshots()
        plan = written(retention.forget_plan(known, [rule(known) for rule in keep]).select("snapshot_id", "keep"), "forget")
        if not dry_run:
            self.forget(plan.where("not keep"))
            if clean:
                self.clean()
        return plan

    def amend(self, snapshot_id: str, ts: datetime, exclude: list[str] | None = None, tags: list[str] | None = None, description: str | None = None) -> str:
        """Writes the snapshot anew under a new id, without the excluded paths or with other tags; the old one is forgotten last."""
        old = self.snapshots().where(F.col("snapshot_id") == snapshot_id).first()
        nodes = written(self.nodes(snapshot_id, None, exclude), "amended")
        root_tree = (tree.tree_ids(nodes).where("path = '/'").select("tree_id").first() or [None])[0]
        tags, description = old["tags"] if tags is None else tags, old["description"] if description is None else description
        ident = self.spark.range(1).select(F.sha2(F.concat_ws("|", F.lit(snapshot_id), F.lit(ts.isoformat()), F.lit(root_tree or ""), F.lit(",".join(sorted(tags))), F.lit(description or "")), 256)).first()[0]
        lists = self.table("node_blobs").where(F.col("snapshot_id") == snapshot_id).join(nodes.select("path"), "path", "left_semi")
        self._append(written(lists.select("path", "seq", "blob_id"), "lists").withColumn("snapshot_id", F.lit(ident)), "node_blobs", "snapshot_id")
        self._append(nodes.withColumn("snapshot_id", F.lit(ident)), "nodes", "snapshot_id")
        totals = nodes.agg(F.count_if(F.col("node_type") == "file"), F.sum("size")).first()
        self._publish(ident, old["repo"], old["ts"], old["parent"], root_tree, tags, description, {"n_files": totals[0], "bytes": totals[1] or 0, "added_bytes": 0})
        self.forget(self.spark.createDataFrame([(snapshot_id,)], "snapshot_id string"))
        return ident

    def references(self) -> DataFrame:
        return self.table("node_blobs").join(self.snapshots().select("snapshot_id"), "snapshot_id", "left_semi").select("snapshot_id", "blob_id")

    def plan(self, tolerance: float = gc.TOLERANCE) -> DataFrame:
        return gc.gc_plan(self.table("index"), self.references(), tolerance=tolerance)

    def clean(self, tolerance: float = gc.TOLERANCE, dry_run: bool = False) -> DataFrame:
        """Drops unused packs and rewrites the live blobs of obsolete and small ones; the summary of the plan."""
        plan = written(self.plan(tolerance), "plan")
        if dry_run:
            return gc.plan_summary(plan)
        index, refs = self.table("index"), self.references()
        moving = gc.repack_set(index, refs, plan)
        stay = index.join(plan.where("status in ('kept', 'tolerated')").select("pack_id"), "pack_id", "left_semi")
        moved = index.join(moving, ["blob_id", "pack_id"]).dropDuplicates(["blob_id"]).join(stay.select("blob_id").distinct(), "blob_id", "left_anti")
        placed = packing.assign_packs(moved.withColumn("stream", F.col("blob_type")), "stream", "blob_id", "length")
        placed = placed.withColumn("pack_id", F.sha2(F.concat_ws("|", F.lit(f"generation {self._state()['generation'] + 1}"), "stream", F.col("pack").cast("string")), 256))
        placed = packing.with_offsets(placed, "pack_id", ["blob_id"], "length").select("blob_id", F.col("stream").alias("blob_type"), "pack_id", "offset", "length")
        entries = written(stay.select(placed.columns).unionByName(placed), "entries")
        state = self._state()
        state["generation"] += 1
        entries.write.option("compression", "zstd").parquet(f"{self.root}/index-{state['generation']}")
        live = entries.groupBy("blob_id").agg(F.min("pack_id").alias("pack_id"))
        blobs = self.table("blobs").select("blob_id", "content").dropDuplicates(["blob_id"]).join(live, "blob_id").select("blob_id", "content", F.substring("pack_id", 1, 2).alias("prefix"))
        blobs.repartition("prefix").write.option("compression", "zstd").partitionBy("prefix").parquet(f"{self.root}/blobs-{state['generation']}")
        with self.fs.open_output_stream(f"{self.path}/manifest.tmp") as f:
            f.write(json.dumps(state).encode())
        self.fs.move(f"{self.path}/manifest.tmp", f"{self.path}/manifest.json")
        return gc.plan_summary(plan)

    def unreferenced(self) -> DataFrame:
        """(blob_id): blobs of the index that no snapshot refers to."""
        return self.table("index").select("blob_id").distinct().join(self.references().select("blob_id"), "blob_id", "left_anti")

    def verify(self) -> DataFrame:
        """(snapshot_id, n_missing, n_corrupt) for each snapshot, however many of them share a bad blob."""
        refs = self.references()
        bad = self.table("blobs").where(F.sha2("content", 256) != F.col("blob_id")).select("blob_id").distinct().withColumn("bad", F.lit(True))
        corrupt = refs.join(bad, "blob_id", "left").groupBy("snapshot_id").agg(F.count_if("bad").alias("n_corrupt"))
        return gc.missing_references(self.table("index"), refs).join(corrupt, "snapshot_id")
