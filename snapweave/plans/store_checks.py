"""Problem queries over the store's tables (general ones): p1, p3, p4, p5."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapweave.functions.ids import id_key, id_text
from snapweave.operators.compaction import blocks_with_file_bytes, compact_parquet, move_blocks, plan_block_moves
from snapweave.operators.hierarchy import descendants, expand_hierarchy
from snapweave.operators.references import MATCHES, find_orphans, orphan_summary
from snapweave.operators.snapshot_changes import merge_versions
from snapweave.session import delete_path, maybe_broadcast, new_path, read_table, written, written_small

#: Fixed values of the store: the largest pack and the share of it below which a pack is small.
MAX_PACK, SMALL_SHARE = 16_777_216, 0.05


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of snapshots, tree nodes and index entries.

    Repeated rows of a record carry the same references with later load times, so they are folded after the join,
    where only orphans are left: a record's earliest row is an orphan whenever any of its rows is.
    """
    snapshots, nodes = read_table(spark, sf_dir, "snapshots"), read_table(spark, sf_dir, "tree_nodes")
    entries, packs = read_table(spark, sf_dir, "index_entries"), read_table(spark, sf_dir, "index_packs")

    def refs(df: DataFrame, table: str, field: str, record, key) -> DataFrame:
        return df.select(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), record.alias("record"), key.alias("key"), "loaded_at")

    number = F.col("node_id").cast("string").cast("binary")
    blob_refs = (
        refs(snapshots, "snapshots", "tree", id_key("snapshot_id"), id_key("tree"))
        .unionByName(refs(nodes.where("size(blobs) > 0").select("node_id", "loaded_at", F.explode(F.array_distinct("blobs")).alias("blob")), "tree_nodes", "blobs", number, id_key("blob")))
        .unionByName(refs(nodes.where("node_type = 'directory'"), "tree_nodes", "tree", number, id_key("tree")))
    )
    blobs = entries.where("blob_type <> 'padding'").select(id_key("blob_id").alias("key"), "loaded_at", "deleted_at")
    lost_blobs = find_orphans(blob_refs, blobs, [("key", "key")], ref_time="loaded_at", target_time="loaded_at", target_live=F.col("deleted_at").isNull())
    lost_blobs = lost_blobs.groupBy("ref_table", "ref_field", "record", "key").agg(F.min(F.struct("loaded_at", "status")).alias("x"))
    part_a = lost_blobs.select(
        "ref_table", "ref_field",
        F.when(F.col("ref_table") == "snapshots", id_text("record")).otherwise(F.decode("record", "UTF-8")).alias("record_key"),
        id_text("key").alias("missing_key"), F.date_format("x.loaded_at", "yyyy-MM").alias("period"), F.col("x.status").alias("status"),
    )

    pack_refs = entries.where("deleted_at is null and not coalesce(is_pending, false) and blob_type <> 'padding'").select("entry_id", id_key("index_id").alias("index"), F.col("pack_array_index").alias("slot"), "loaded_at")
    slots = packs.select(id_key("index_id").alias("index"), F.col("pack_array_index").alias("slot"), "loaded_at", "deleted_at")
    lost_packs = find_orphans(pack_refs, slots, [("index", "index"), ("slot", "slot")], ref_time="loaded_at", target_time="loaded_at", target_live=F.col("deleted_at").isNull())
    lost_packs = lost_packs.groupBy("entry_id", "index", "slot").agg(F.min(F.struct("loaded_at", "status")).alias("x"))
    part_b = lost_packs.select(
        F.lit("index_entries").alias("ref_table"), F.lit("pack_array_index").alias("ref_field"), F.col("entry_id").cast("string").alias("record_key"),
        F.concat_ws(":", id_text("index"), F.col("slot").cast("string")).alias("missing_key"), F.date_format("x.loaded_at", "yyyy-MM").alias("period"), F.col("x.status").alias("status"),
    )
    return part_a.unionByName(part_b)


def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_summary(p1_found(spark, sf_dir))


def p1_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose references to a pack's place have lost one part or both, under each match semantics: cases by null mask and status."""
    entries, packs = read_table(spark, sf_dir, "index_entries"), read_table(spark, sf_dir, "index_packs")
    refs = entries.where("blob_type <> 'padding'").select(
        F.when(F.col("entry_id") % 7 != 0, F.lower("index_id")).alias("index"), F.when(F.col("entry_id") % 5 != 0, F.col("pack_array_index")).alias("slot"), "entry_id", "loaded_at"
    )
    slots = packs.select(F.lower("index_id").alias("index"), F.col("pack_array_index").alias("slot"), "loaded_at", "deleted_at")
    out: DataFrame | None = None
    for match in MATCHES:
        found = find_orphans(refs, slots, [("index", "index"), ("slot", "slot")], match, "loaded_at", "loaded_at", F.col("deleted_at").isNull())
        found = found.groupBy(F.lit(match).alias("match"), F.col("index").isNotNull().alias("has_index"), F.col("slot").isNotNull().alias("has_slot"), "status").agg(
            F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entry_id").alias("n_entries")
        )
        out = found if out is None else out.unionByName(found)
    return out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory positions below each distinct snapshot tree. Nodes are numbered as they were written, so the nodes of
    one backed-up set lie together: the locality of the links."""
    links = read_table(spark, sf_dir, "tree_nodes").where("node_type = 'directory'").select(id_key("tree_id").alias("parent"), "name", id_key("tree").alias("child"), "node_id")
    roots = read_table(spark, sf_dir, "snapshots").select(id_key("tree").alias("root"))
    found = expand_hierarchy(links, roots, "parent", "name", "child", "node_id", "root")
    return found.select(id_text("root").alias("root_tree"), F.col("label").alias("dir_path"), "depth", F.col("closes").cast("int").alias("closes_cycle"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many directories lie how far below the directories of each root: every node counts under each node above it."""
    links = read_table(spark, sf_dir, "tree_nodes").where("node_type = 'directory'").select(id_key("tree_id").alias("parent"), "name", id_key("tree").alias("child"), "node_id")
    roots = read_table(spark, sf_dir, "snapshots").select(id_key("tree").alias("root"))
    below = descendants(expand_hierarchy(links, roots, "parent", "name", "child", "node_id", "root"))
    return below.groupBy("root", "depth_below").agg(F.count(F.lit(1)).alias("n")).select(id_text("root").alias("root_tree"), "depth_below", "n")


def pack_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack, blob, blob_length, blob_offset) for each live entry and the pack it points to; repeated rows stay."""
    entries = read_table(spark, sf_dir, "index_entries").where("deleted_at is null and blob_type <> 'padding' and not coalesce(is_pending, false)")
    packs = read_table(spark, sf_dir, "index_packs").where("deleted_at is null")
    slots = packs.select(id_key("index_id").alias("index"), F.col("pack_array_index").alias("slot"), id_key("pack_id").alias("pack")).distinct()
    own = entries.select(id_key("index_id").alias("index"), F.col("pack_array_index").alias("slot"), id_key("blob_id").alias("blob"), "blob_length", "blob_offset")
    return own.join(slots, ["index", "slot"]).select("pack", "blob", "blob_length", "blob_offset")


def pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_places(spark, sf_dir).select("pack", "blob", "blob_length")


def blobs_to_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack, blob, blob_length): each distinct blob of a small pack once, from the smallest pack id.

    The listing of all packs is written with the bytes of its pack beside each blob, every task's file in order of them. Its
    compaction copies the encoded row groups of small packs, as the statistics in the footers tell them, into few files; what
    comes out is the listing of the small packs."""
    parts, whole = new_path(spark, "p4-parts"), new_path(spark, "p4-small")
    rows = blocks_with_file_bytes(pack_blocks(spark, sf_dir), "pack", "blob", "blob_length").sortWithinPartitions("file_bytes", "pack")
    rows.write.option("compression", "zstd").option("parquet.block.size", 1 << 20).parquet(parts)
    compact_parquet(spark, parts, whole, below=("file_bytes", math.ceil(MAX_PACK * SMALL_SHARE)))
    delete_path(spark, parts)
    small = spark.read.schema(rows.schema).parquet(whole)
    return small.groupBy("blob").agg(F.min(F.struct("pack", "blob_length")).alias("x")).select("x.pack", "blob", "x.blob_length")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewrite list of the small packs."""
    return blobs_to_rewrite(spark, sf_dir).select(id_text("pack").alias("pack_id"), id_text("blob").alias("blob_id"))


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_block_moves(blobs_to_rewrite(spark, sf_dir), "pack", "blob", "blob_length", MAX_PACK)


def p4_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs to write: blobs and bytes of each, from the planned place of every block."""
    return _moves(spark, sf_dir).groupBy("target_no").agg(F.count(F.lit(1)).alias("n_blobs"), F.sum("blob_length").alias("n_bytes"), F.max(F.col("target_offset") + F.col("blob_length")).alias("end_offset"))


def p4_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new packs made of the packs whose bytes are given: size and content of each."""
    packs = read_table(spark, sf_dir, "packs").where("data is not null").groupBy(id_key("pack_id").alias("pack")).agg(F.min("data").alias("data"))
    at = pack_places(spark, sf_dir).groupBy("pack", "blob").agg(F.min("blob_offset").alias("offset"))
    own = blobs_to_rewrite(spark, sf_dir).join(packs.select("pack"), "pack", "left_semi")
    made = move_blocks(plan_block_moves(own, "pack", "blob", "blob_length", MAX_PACK), at, packs, "pack", "blob", "blob_length")
    return made.select("target_no", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("content"))


def listing_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that have a listing: (snap, set, seq, last), numbered in order of time within their set."""
    snapshots, listed = read_table(spark, sf_dir, "snapshots"), read_table(spark, sf_dir, "snapshot_nodes")
    one = snapshots.groupBy(id_key("snapshot_id").alias("snap")).agg(F.min(F.struct("loaded_at", "repo_id", "root", "snap_time")).alias("x")).select("snap", "x.*")
    have = listed.where("path is not null").select(id_key("snapshot_id").alias("snap")).distinct()
    # a set is the hash of (repo_id, root); the two values stay in the partitioning, so that equal hashes never mix sets
    w = Window.partitionBy("repo_id", "root").orderBy("snap_time", "snap")
    out = one.join(have, "snap").withColumn("seq", F.row_number().over(w) - 1).withColumn("set_first", F.first("snap").over(w))
    return out.withColumn("last", F.count(F.lit(1)).over(Window.partitionBy("repo_id", "root")).cast("int") - 1).select("snap", F.col("set_first").alias("set"), "seq", "last")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed changes between consecutive listings. A set is named by its first snapshot; the state of a node is the text
    of its compared fields, with the SHA-256 of the blob list where that has more than one blob."""
    versions, small = written_small(listing_versions(spark, sf_dir), "p5-versions")
    blobs = F.lower(F.array_join("blobs", ",", "\\N"))
    state = F.concat_ws(
        "|", F.coalesce("node_type", F.lit("\\N")), F.coalesce(F.col("size").cast("string"), F.lit("\\N")), F.coalesce(F.unix_micros(F.col("modified_time").cast("timestamp")).cast("string"), F.lit("\\N")),
    )
    listed = read_table(spark, sf_dir, "snapshot_nodes").select(
        id_key("snapshot_id").alias("snap"), F.regexp_replace("path", r"^\./", "").alias("path"), "loaded_at",
        F.when(F.coalesce(F.size("blobs"), F.lit(0)) <= 0, F.encode(state, "UTF-8")).otherwise(F.concat(F.encode(state, "UTF-8"), F.unhex(F.sha2(blobs, 256)))).alias("state"),
    )
    # written: finding the ranges reads group and path only, and no state is computed twice
    rows = written(listed.join(maybe_broadcast(versions, small), "snap"), "p5-listings")
    changes = merge_versions(rows, "set", "path", "seq", "last", "state", "loaded_at")
    ends = versions.select("set", "seq", "snap")
    prev = ends.select("set", (F.col("seq") + 1).alias("seq"), F.col("snap").alias("prev"))
    pairs, few = written_small(ends.join(prev, ["set", "seq"]), "p5-pairs")
    return changes.join(maybe_broadcast(pairs, few), ["set", "seq"]).select(id_text("prev").alias("prev_snapshot"), id_text("snap").alias("next_snapshot"), "path", "change")


_REFS_SQL = """
WITH b AS (SELECT lower(blob_id) AS k, bool_or(deleted_at IS NULL) AS live, min(loaded_at) AS first FROM index_entries WHERE blob_type <> 'padding' GROUP BY 1),
p AS (SELECT lower(index_id) || ':' || pack_array_index AS k, bool_or(deleted_at IS NULL) AS live, min(loaded_at) AS first FROM index_packs WHERE index_id IS NOT NULL AND pack_array_index IS NOT NULL GROUP BY 1),
r AS (
  SELECT 'snapshots' AS ref_table, 'tree' AS ref_field, lower(snapshot_id) AS record_key, lower(tree) AS k, min(loaded_at) AS t FROM snapshots WHERE tree IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'tree_nodes', 'blobs', CAST(node_id AS VARCHAR), k, min(loaded_at) FROM (SELECT node_id, loaded_at, lower(unnest(blobs)) AS k FROM tree_nodes) WHERE k IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'tree_nodes', 'tree', CAST(node_id AS VARCHAR), lower(tree), min(loaded_at) FROM tree_nodes WHERE node_type = 'directory' AND tree IS NOT NULL GROUP BY ALL),
q AS (SELECT 'index_entries' AS ref_table, 'pack_array_index' AS ref_field, CAST(entry_id AS VARCHAR) AS record_key, lower(index_id) || ':' || pack_array_index AS k, min(loaded_at) AS t
  FROM index_entries WHERE deleted_at IS NULL AND NOT coalesce(is_pending, false) AND blob_type <> 'padding' AND index_id IS NOT NULL AND pack_array_index IS NOT NULL GROUP BY ALL),
f AS (
  SELECT r.*, CASE WHEN live IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN first > t THEN 'late' END AS status FROM r LEFT JOIN b USING (k)
  UNION ALL SELECT q.*, CASE WHEN live IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN first > t THEN 'late' END FROM q LEFT JOIN p USING (k))
"""

_P5_SQL = """
WITH s AS (SELECT id, repo_id, root, snap_time FROM (SELECT lower(snapshot_id) AS id, repo_id, root, snap_time, row_number() OVER (PARTITION BY lower(snapshot_id) ORDER BY loaded_at) AS rn FROM snapshots) WHERE rn = 1),
n AS (SELECT * FROM (SELECT lower(snapshot_id) AS id, regexp_replace(path, '^\\./', '') AS path, node_type, size, modified_time, coalesce(lower(array_to_string(blobs, ',')), '') AS bl,
  row_number() OVER (PARTITION BY lower(snapshot_id), regexp_replace(path, '^\\./', '') ORDER BY loaded_at) AS rn FROM snapshot_nodes WHERE path IS NOT NULL) WHERE rn = 1),
v AS (SELECT id, lag(id) OVER (PARTITION BY repo_id, root ORDER BY snap_time, id) AS prev FROM s WHERE id IN (SELECT id FROM n)),
a AS (SELECT v.prev, v.id AS next, n.* FROM v JOIN n ON n.id = v.prev), b AS (SELECT v.prev, v.id AS next, n.* FROM v JOIN n ON n.id = v.id WHERE v.prev IS NOT NULL)
SELECT coalesce(a.prev, b.prev) AS prev_snapshot, coalesce(a.next, b.next) AS next_snapshot, coalesce(a.path, b.path) AS path,
  CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.prev = b.prev AND a.next = b.next AND a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.node_type IS DISTINCT FROM b.node_type OR a.size IS DISTINCT FROM b.size OR a.modified_time IS DISTINCT FROM b.modified_time OR a.bl <> b.bl
"""

_P4_SQL = """
WITH h AS (SELECT lower(pack_id) AS pack_id, lower(blob_id) AS blob_id, max(coalesce(blob_length, 0)) AS len FROM index_entries e JOIN index_packs p ON lower(e.index_id) = lower(p.index_id) AND e.pack_array_index = p.pack_array_index
  WHERE e.deleted_at IS NULL AND p.deleted_at IS NULL AND blob_type <> 'padding' AND NOT coalesce(is_pending, false) AND pack_id IS NOT NULL AND blob_id IS NOT NULL GROUP BY ALL),
s AS (SELECT pack_id FROM h GROUP BY 1 HAVING sum(len) / 16777216 < 0.05)
SELECT min(pack_id) AS pack_id, blob_id FROM h WHERE pack_id IN (FROM s) GROUP BY blob_id
"""

_P4_MOVES = _P4_SQL.replace("SELECT min(pack_id) AS pack_id, blob_id FROM h WHERE pack_id IN (FROM s) GROUP BY blob_id", """,
w AS (SELECT min(pack_id) AS pack_id, blob_id, arg_min(len, pack_id)::BIGINT AS len FROM h WHERE pack_id IN (FROM s) GROUP BY blob_id{only}),
o AS (SELECT *, substr(sha256(unhex(pack_id)), 1, 3) || substr(sha256(unhex(blob_id)), 1, 1) AS r FROM w),
a AS (SELECT *, (sum(len) OVER (ORDER BY r, pack_id, blob_id ROWS UNBOUNDED PRECEDING) - len)::BIGINT AS pos FROM o),
m AS (SELECT *, pos // 16777216 AS target_no FROM a), f AS (SELECT *, pos - min(pos) OVER (PARTITION BY target_no) AS target_offset FROM m)
""")
_P4_GIVEN = """, d AS (SELECT lower(pack_id) AS pack_id, min(data) AS data FROM packs WHERE data IS NOT NULL GROUP BY 1),
b AS (SELECT lower(pack_id) AS pack_id, lower(blob_id) AS blob_id, min(blob_offset) AS pos_in FROM index_entries e JOIN index_packs p ON lower(e.index_id) = lower(p.index_id) AND e.pack_array_index = p.pack_array_index
  WHERE e.deleted_at IS NULL AND p.deleted_at IS NULL AND blob_type <> 'padding' AND NOT coalesce(is_pending, false) GROUP BY ALL)
"""

_P3_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT lower(tree_id) AS p, coalesce(name, '') AS name, lower(tree) AS c FROM tree_nodes WHERE node_type = 'directory' AND tree_id IS NOT NULL),
w(r, t, path, d, above, cyc) AS (
  SELECT DISTINCT lower(tree), lower(tree), '', 0, [lower(tree)], 0 FROM snapshots WHERE tree IS NOT NULL
  UNION ALL SELECT w.r, e.c, CASE WHEN d = 0 THEN e.name ELSE path || '/' || e.name END, d + 1, list_append(above, e.c), CASE WHEN list_contains(above, e.c) THEN 1 ELSE 0 END FROM w JOIN e ON e.p = w.t WHERE cyc = 0)
SELECT r AS root_tree, path AS dir_path, d AS depth, cyc AS closes_cycle FROM w WHERE d > 0
"""

_MASKS_SQL = """
WITH r AS (SELECT entry_id, loaded_at AS t, CASE WHEN entry_id % 7 <> 0 THEN lower(index_id) END AS i, CASE WHEN entry_id % 5 <> 0 THEN pack_array_index END AS s FROM index_entries WHERE blob_type <> 'padding'),
k AS (SELECT lower(index_id) AS i, pack_array_index AS s, deleted_at IS NULL AS live, loaded_at AS f FROM index_packs),
k3 AS (SELECT i, s, bool_or(live) AS live, min(f) AS f FROM k WHERE i IS NOT NULL AND s IS NOT NULL GROUP BY ALL),
k1 AS (SELECT i, bool_or(live) AS live, min(f) AS f FROM k WHERE i IS NOT NULL GROUP BY ALL), k2 AS (SELECT s, bool_or(live) AS live, min(f) AS f FROM k WHERE s IS NOT NULL GROUP BY ALL),
j AS (SELECT r.*, 3 AS mask, live, f FROM r LEFT JOIN k3 ON r.i = k3.i AND r.s = k3.s WHERE r.i IS NOT NULL AND r.s IS NOT NULL
  UNION ALL SELECT r.*, 1, live, f FROM r LEFT JOIN k1 ON r.i = k1.i WHERE r.i IS NOT NULL AND r.s IS NULL
  UNION ALL SELECT r.*, 2, live, f FROM r LEFT JOIN k2 ON r.s = k2.s WHERE r.i IS NULL AND r.s IS NOT NULL),
v AS (SELECT *, CASE WHEN live IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN f > t THEN 'late' END AS status FROM j),
m AS (SELECT 'partial' AS match, * FROM v UNION ALL SELECT x, v.* FROM v, (VALUES ('simple'), ('full')) q(x) WHERE mask = 3
  UNION ALL SELECT 'full', r.*, 0, NULL, NULL, 'malformed' FROM r WHERE (i IS NULL) <> (s IS NULL))
SELECT match, i IS NOT NULL AS has_index, s IS NOT NULL AS has_slot, status, count(*) AS n_rows, count(DISTINCT entry_id) AS n_entries FROM m WHERE status IS NOT NULL GROUP BY ALL
"""

SQL = {
    "p1_masks": _MASKS_SQL,
    "p3_descendants": _P3_SQL.replace("SELECT r AS root_tree, path AS dir_path, d AS depth, cyc AS closes_cycle FROM w WHERE d > 0", "SELECT root_tree, depth_below, count(*) AS n FROM (SELECT r AS root_tree, unnest(range(1, d + 1))::INT AS depth_below FROM w WHERE d > 0) GROUP BY ALL"),
    "p3_found": _P3_SQL,
    "p4_found": _P4_SQL,
    "p4_targets": _P4_MOVES.format(only="") + "SELECT target_no, count(*) AS n_blobs, sum(len)::BIGINT AS n_bytes, max(target_offset + len)::BIGINT AS end_offset FROM f GROUP BY 1",
    "p4_packs": _P4_MOVES.format(only=" HAVING min(pack_id) IN (SELECT lower(pack_id) FROM packs WHERE data IS NOT NULL)") + _P4_GIVEN
    + "SELECT target_no, sum(strlen(x) // 2)::BIGINT AS n_bytes, sha256(unhex(string_agg(x, '' ORDER BY target_offset, blob_id))) AS content FROM (SELECT *, substr(hex(data), 2 * pos_in + 1, 2 * len) AS x FROM f JOIN d USING (pack_id) JOIN b USING (pack_id, blob_id)) GROUP BY 1",
    "p5_found": _P5_SQL,
    "p1_found": _REFS_SQL + "SELECT ref_table, ref_field, record_key, k AS missing_key, strftime(t, '%Y-%m') AS period, status FROM f WHERE status IS NOT NULL",
    "p1_summary": _REFS_SQL + "SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS period, status, count(*) AS n_refs, count(DISTINCT k) AS n_keys FROM f WHERE status IS NOT NULL GROUP BY ALL",
}

QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_targets": p4_targets, "p4_packs": p4_packs, "p5_found": p5_found, "p3_descendants": p3_descendants, "p1_found": p1_found, "p1_summary": p1_summary, "p1_masks": p1_masks}
