"""Queries of formats, orders and the store's commands over the derived inputs, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave import views as V
from snapweave.functions import paths as P
from snapweave.functions import scalars as S
from snapweave.operators import chunking, gc, packing, tree
from snapweave.session import new_path, read_table, written
from snapweave.sources import packfile
from snapweave.sources.catalog import Store
from snapweave.streaming.ingest import distinct_within
from snapweave.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_IX, _N1, _EV, _DOCS = with_views("ix"), with_views("nodes_v1"), with_views("snapshots_ev"), with_views("docs")


def _packs(spark: SparkSession, d: str) -> DataFrame:
    """A pack file for each order: a blob of ``length`` bytes for each line."""
    blobs = V.index_entries(spark, d).withColumn("content", F.encode(F.repeat(F.lit("x"), F.col("length").cast("int")), "UTF-8"))
    return packfile.build_packs(blobs, "pack_id", "seq", "blob_id", "blob_type", "content")


@query(_IX + "SELECT pack_id::VARCHAR AS pack, blob_id, blob_type, (sum(length) OVER (PARTITION BY pack_id ORDER BY seq, blob_id ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS pos, length FROM ix")
def pack_headers(spark, d):
    """Descriptors read back from the headers of pack files, without padding."""
    return packfile.scan_headers(_packs(spark, d), "pack", "content").select("pack", "blob_id", "blob_type", F.col("offset").alias("pos"), "length")


@query(_IX + "SELECT pack_id::VARCHAR AS pack, count(*) AS n FROM ix WHERE blob_id NOT IN (SELECT blob_id FROM ix WHERE pack_id % 9 <> 0) GROUP BY 1")
def dangling_headers(spark, d):
    """Blobs in pack headers that the index lacks."""
    found = packfile.scan_headers(_packs(spark, d), "pack", "content")
    return gc.dangling_blobs(found, V.index_entries(spark, d).where("pack_id % 9 <> 0")).groupBy("pack").agg(F.count(F.lit(1)).alias("n"))


@query(_IX + "SELECT pack_id, n, ((n + 63) // 64 * 64)::BIGINT AS padded, ((n + 63) // 64 * 64 * 37)::BIGINT AS header FROM (SELECT pack_id, count(*) AS n FROM ix GROUP BY 1)")
def header_sizes(spark, d):
    n = V.index_entries(spark, d).groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("pack_id", "n", S.padded_descriptors(F.col("n")).alias("padded"), S.header_bytes(F.col("n")).alias("header"))


@query(_N1 + "SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS position FROM nodes_v1")
def walk_order(spark, d):
    """Depth-first order: paths compare component by component."""
    return packing.ordered_positions(V.nodes_v1(spark, d).select("path"), [P.path_order(F.col("path"))])


@query(_N1 + "SELECT path, row_number() OVER (ORDER BY lower(path), path) - 1 AS position FROM (SELECT path FROM nodes_v1 UNION SELECT array_to_string(list_slice(l, 1, i), '/') FROM (SELECT l, unnest(range(2, len(l))) AS i FROM (SELECT string_split(path, '/') AS l FROM nodes_v1)))")
def ls_order(spark, d):
    return packing.ordered_positions(tree.with_directories(V.nodes_v1(spark, d)).select("path"), [F.lower("path"), F.col("path")])


@query(_EV + "SELECT snapshot_id, row_number() OVER (ORDER BY ts, snapshot_id) - 1 AS position FROM snapshots_ev")
def log_order(spark, d):
    return packing.ordered_positions(V.snapshots_ev(spark, d).select("snapshot_id", "ts"), [F.col("ts"), F.col("snapshot_id")]).select("snapshot_id", "position")


@query(with_views("chunks") + "SELECT doc_id, count(*) || CASE WHEN count(*) = 1 THEN ' chunk' ELSE ' chunks' END AS said FROM chunks GROUP BY doc_id")
def count_words(spark, d):
    n = V.chunks(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("doc_id", S.format_count(F.col("n"), "chunk", "chunks").alias("said"))


def _letter(r: int, w: int, x: int, special: int, low: str) -> str:
    last = f"CASE WHEN mode & {x} <> 0 AND mode & {special} <> 0 THEN '{low}' WHEN mode & {x} <> 0 THEN 'x' WHEN mode & {special} <> 0 THEN '{low.upper()}' ELSE '-' END"
    return f"CASE WHEN mode & {r} <> 0 THEN 'r' ELSE '-' END || CASE WHEN mode & {w} <> 0 THEN 'w' ELSE '-' END || {last}"


_KIND = "CASE mode & 61440 " + " ".join(f"WHEN {bits} THEN '{c}'" for bits, c in ((0o100000, "-"), (0o040000, "d"), (0o120000, "l"), (0o010000, "p"), (0o020000, "c"), (0o060000, "b"), (0o140000, "s"))) + " ELSE '?' END"


@query(f"SELECT node_type, mode, {_KIND} || {_letter(256, 128, 64, 2048, 's')} || {_letter(32, 16, 8, 1024, 's')} || {_letter(4, 2, 1, 512, 't')} AS perms, count(*) AS n FROM tree_nodes WHERE mode IS NOT NULL GROUP BY ALL")
def node_permissions(spark, d):
    rows = read_table(spark, d, "tree_nodes").where("mode is not null").groupBy("node_type", "mode").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("node_type", "mode", S.permissions(F.col("mode")).alias("perms"), "n")


@query("SELECT DISTINCT lower(snapshot_id) AS snapshot_id, CASE WHEN year(snap_time) >= 1970 THEN strftime(snap_time, '%Y-%m-%d %H:%M:%S') END AS shown FROM snapshots")
def shown_times(spark, d):
    return read_table(spark, d, "snapshots").select(F.lower("snapshot_id").alias("snapshot_id"), S.show_time(F.col("snap_time")).alias("shown")).distinct()


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 2) THEN 'local' WHEN doc_id % 4 = 1 THEN 'sftp' ELSE 'unsupported' END AS kind, CASE WHEN doc_id % 4 = 1 THEN 'me' END AS "user", CASE WHEN doc_id % 4 = 1 THEN 'host' END AS host,
CASE WHEN doc_id % 4 = 1 THEN CASE WHEN doc_id % 8 = 1 THEN 2200 ELSE 22 END END AS port, CASE doc_id % 4 WHEN 0 THEN 'store/' || doc_id WHEN 1 THEN 'data/' || doc_id WHEN 2 THEN '/data/' || doc_id END AS path FROM documents"""
)
def storage_places(spark, d):
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 4
    sftp = F.concat(F.lit("sftp://me@host"), F.when(F.col("doc_id") % 8 == 1, ":2200").otherwise(""), F.lit("/data/"), i)
    text = F.when(k == 0, F.concat(F.lit("store/"), i)).when(k == 1, sftp).when(k == 2, F.concat(F.lit("file:///data/"), i)).otherwise(F.concat(F.lit("ftp://host/"), i))
    return read_table(spark, d, "documents").select("doc_id", S.storage_place(text).alias("p")).select("doc_id", "p.kind", "p.user", "p.host", "p.port", "p.path")


@query(_DOCS + "SELECT doc_id, strlen(text) AS bytes, true AS gapless, true AS sized, true AS ids_hold FROM docs")
def cdc_contract(spark, d):
    """Content-defined chunks lie end to end, within the sizes, under the ids of their bytes."""
    docs = read_table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = chunking.content_chunks(docs, "doc_id", F.col("text"), 64, 256, 1024)
    parts = F.array_sort(F.collect_list(F.struct("seq", "offset", "len", "chunk_id")))
    whole = docs.join(cut.groupBy("doc_id").agg(parts.alias("p"), F.sum("len").alias("bytes")), "doc_id").withColumn("b", F.encode("text", "UTF-8"))
    ends = F.transform("p", lambda x: x["offset"] + x["len"])
    gapless = (F.element_at("p", 1)["offset"] == 0) & (F.slice(F.transform("p", lambda x: x["offset"]), 2, 1 << 30) == F.slice(ends, 1, F.size("p") - 1)) & (F.element_at(ends, -1) == F.octet_length("b"))
    sized = F.forall("p", lambda x: x["len"] <= 1024) & F.forall(F.slice("p", 1, F.size("p") - 1), lambda x: x["len"] >= 64)
    held = F.forall("p", lambda x: F.sha2(F.substring(F.col("b"), x["offset"].cast("int") + 1, x["len"].cast("int")), 256) == x["chunk_id"])
    return whole.select("doc_id", "bytes", gapless.alias("gapless"), sized.alias("sized"), held.alias("ids_hold"))


@query("SELECT DISTINCT event_id FROM events WHERE event_id IS NOT NULL")
def stream_claims(spark, d):
    """Events that come twice in a stream are claimed once."""
    source, target, state = (new_path(spark, x) for x in ("events", "claims", "claims-state"))
    events = read_table(spark, d, "events").where("event_id is not null").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    events.unionByName(events).repartition(4).write.parquet(source)
    stream = distinct_within(spark.readStream.schema(events.schema).parquet(source), "event_id", "ts", "10 minutes")
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(target).select("event_id")


def _store(spark: SparkSession, d: str) -> Store:
    """A store with two snapshots of the documents."""
    store = Store.init(spark, new_path(spark, "store"))
    for k, nodes in enumerate((V.nodes_v1(spark, d), V.nodes_v2(spark, d))):
        content = F.when(F.col("node_type") == "file", F.col("content"))
        files = written(nodes.select("path", "node_type", "size", "mode", "modified_time", content.alias("content")), "files")
        store.snapshot(files, datetime(2024, 1, 1 + k), chunk_sizes=(64, 256, 1024))
    return store


@query(with_views("nodes_v2") + "SELECT path, node_type, CASE WHEN node_type = 'file' THEN content_id END AS content_id FROM nodes_v2")
def store_restore(spark, d):
    """The latest snapshot, put together from its chunks; the files that did not change come from those of its parent."""
    store = _store(spark, d)
    return store.restore(store.select("Latest")).select("path", "node_type", F.sha2("content", 256).alias("content_id"))


@query(
    with_views("nodes_v1", "nodes_v2")
    + """SELECT 0::BIGINT AS position, false AS has_parent, (SELECT count(*) FROM nodes_v1 WHERE node_type = 'file') AS n_files, (SELECT sum(size)::BIGINT FROM nodes_v1) AS bytes, 0::BIGINT AS n_missing, 0::BIGINT AS n_corrupt
UNION ALL SELECT 1, true, (SELECT count(*) FROM nodes_v2 WHERE node_type = 'file'), (SELECT sum(size)::BIGINT FROM nodes_v2), 0, 0"""
)
def store_log(spark, d):
    """The log of the store with what its check finds."""
    store = _store(spark, d)
    rows = packing.ordered_positions(store.log().join(store.verify(), "snapshot_id"), [F.col("ts"), F.col("snapshot_id")])
    return rows.select(F.col("position").cast("long").alias("position"), F.col("parent").isNotNull().alias("has_parent"), "n_files", "bytes", "n_missing", "n_corrupt")
