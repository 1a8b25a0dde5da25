"""Queries of the store's own operators over the derived inputs, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave import views as V
from snapweave.functions import paths as P
from snapweave.functions import scalars as S
from snapweave.functions.ids import id_key, id_text
from snapweave.operators import chunking, dedup, diff, gc, packing, retention, tree
from snapweave.session import read_table, written
from snapweave.sources import packfile
from snapweave.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CHANGED = "(a.modified_time IS DISTINCT FROM b.modified_time OR a.size IS DISTINCT FROM b.size OR a.mode IS DISTINCT FROM b.mode)"
_DIFF = (
    with_views("nodes_v1", "nodes_v2")
    + f""", d AS (SELECT coalesce(b.path, a.path) AS path, a.size AS prev_size, b.size AS next_size, coalesce(b.node_type, a.node_type) AS kind,
  CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN {_CHANGED} THEN 'changed' ELSE 'unchanged' END AS status,
  CASE WHEN a.path IS NULL THEN '+' WHEN b.path IS NULL THEN '-' WHEN {_CHANGED} THEN CASE WHEN a.node_type <> b.node_type THEN 'T' WHEN a.content_id = b.content_id THEN 'm' ELSE 'M' END
    ELSE CASE WHEN a.content_id = b.content_id THEN 'U' ELSE '?' END END AS symbol
  FROM nodes_v1 a FULL JOIN nodes_v2 b ON a.path = b.path)
"""
)


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_nodes(V.nodes_v1(spark, d), V.nodes_v2(spark, d))


@query(_DIFF + "SELECT path, symbol, prev_size, next_size FROM d")
def snapshot_diff_rows(spark, d):
    return _diff(spark, d).select("path", "symbol", F.col("p_size").alias("prev_size"), F.col("n_size").alias("next_size"))


@query(_DIFF + "SELECT symbol, count(*) AS n, sum(coalesce(next_size, prev_size))::BIGINT AS bytes FROM d GROUP BY 1")
def snapshot_diff_counts(spark, d):
    return diff.diff_counts(_diff(spark, d))


@query(_DIFF + "SELECT status, CASE WHEN kind = 'directory' THEN 'dir' ELSE 'file' END AS kind, count(*) AS n FROM d GROUP BY ALL")
def snapshot_diff_kinds(spark, d):
    return diff.diff_by_kind(_diff(spark, d))


@query(_DIFF + "SELECT path, symbol FROM d WHERE (path = '/en' OR starts_with(path, '/en/')) AND NOT starts_with(path, '/en/issues/')")
def snapshot_diff_filtered(spark, d):
    cut = lambda df: P.filter_paths(df, "path", ["/en"], ["/en/issues"])
    return diff.diff_nodes(cut(V.nodes_v1(spark, d)), cut(V.nodes_v2(spark, d))).select("path", "symbol")


@query(
    _DIFF
    + """, c AS (SELECT path, count(*) AS n, sum(strlen(ch)) AS bytes FROM (SELECT path, unnest(list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN i < len(string_split(content, chr(10))) THEN x || chr(10) ELSE x END)) AS ch FROM nodes_v2) GROUP BY 1)
SELECT d.path, status, CASE WHEN status = 'unchanged' THEN 0 ELSE n END AS n_chunks, CASE WHEN status = 'unchanged' THEN 0 ELSE bytes END::BIGINT AS new_bytes FROM d JOIN c ON c.path = d.path WHERE status <> 'deleted'"""
)
def incremental_chunks(spark, d):
    """Only new and changed nodes are chunked; unchanged ones carry their chunks over."""
    rows = _diff(spark, d).where("status <> 'deleted'").select("path", "status")
    work = V.nodes_v2(spark, d).select("path", "content").join(rows.where("status <> 'unchanged'").select("path"), "path", "left_semi")
    made = chunking.delimiter_chunks(work, "path", "content").groupBy("path").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("len").alias("new_bytes"))
    return rows.join(made, "path", "left").na.fill(0, ["n_chunks", "new_bytes"])


_N1 = with_views("nodes_v1")


@query(_N1 + "SELECT path, (starts_with(path, '/en/') OR starts_with(path, '/de/forum/')) AND NOT starts_with(path, '/en/issues/') AS included FROM nodes_v1")
def path_filter(spark, d):
    return V.nodes_v1(spark, d).select("path", P.path_included(F.col("path"), ["/en", "/de/forum"], ["/en/issues"]).alias("included"))


@query(
    _N1
    + """, s AS (SELECT lang, string_split(min(path), '/') AS a, string_split(max(path), '/') AS b, count(DISTINCT path) AS n FROM (SELECT lang, path FROM nodes_v1) GROUP BY 1),
p AS (SELECT lang, path, string_split(path, '/') AS l FROM nodes_v1), m AS (SELECT lang, min(len(l)) AS k FROM p GROUP BY 1),
u AS (SELECT lang, l[i] AS c, i, count(DISTINCT path) AS n FROM (SELECT lang, path, l, unnest(range(1, len(l) + 1)) AS i FROM p) GROUP BY ALL),
t AS (SELECT lang, i, c FROM u JOIN (SELECT lang, count(DISTINCT path) AS total FROM p GROUP BY 1) USING (lang) WHERE n = total)
SELECT lang, CASE WHEN (SELECT count(DISTINCT path) FROM p q WHERE q.lang = t.lang) = 1 THEN regexp_replace(string_agg(c, '/' ORDER BY i), '/[^/]*$', '') ELSE string_agg(c, '/' ORDER BY i) END AS lcp FROM t GROUP BY lang"""
)
def path_lcp(spark, d):
    return P.common_prefix(V.nodes_v1(spark, d), "path", "lang")


@query(
    _N1
    + """, a AS (SELECT DISTINCT array_to_string(list_slice(l, 1, i), '/') AS child FROM (SELECT l, unnest(range(2, len(l) + 1)) AS i FROM (SELECT string_split(path, '/') AS l FROM nodes_v1)))
SELECT CASE WHEN regexp_matches(child, '^/[^/]+$') THEN '/' ELSE regexp_replace(child, '/[^/]*$', '') END AS parent, count(*) AS n_children FROM a GROUP BY 1"""
)
def path_children(spark, d):
    return P.children_counts(V.nodes_v1(spark, d), "path")


@query(_N1 + "SELECT path, substr(path, 5) AS stripped FROM nodes_v1 WHERE starts_with(path, '/en/')")
def path_strip_prefix(spark, d):
    return V.nodes_v1(spark, d).select("path", P.strip_prefix(F.col("path"), "/en").alias("stripped")).where("stripped is not null")


_ALL = (
    _N1
    + """, l AS (SELECT string_split(path, '/') AS l FROM nodes_v1),
t AS (SELECT path, 'file' AS node_type FROM nodes_v1 UNION ALL SELECT DISTINCT array_to_string(list_slice(l, 1, i), '/'), 'directory' FROM (SELECT l, unnest(range(2, len(l))) AS i FROM l))
"""
)


@query(_ALL + "SELECT path, len(string_split(path, '/')) - 1 AS depth, node_type FROM t WHERE path IN ('/en', '/de/forum', '/en/issues', '/no/where')")
def path_resolve(spark, d):
    nodes = tree.with_directories(V.nodes_v1(spark, d))
    return P.resolve(nodes, "path", ["/en", "/de/forum", "/en/issues", "/no/where"]).select("path", (F.size(F.split("path", "/")) - 1).alias("depth"), "node_type")


@query(_ALL + "SELECT (SELECT count(*) FROM t WHERE node_type = 'file') AS n_files, (SELECT count(*) FROM t WHERE node_type = 'directory') AS n_dirs, (SELECT sum(size)::BIGINT FROM nodes_v1) AS bytes")
def scan_totals(spark, d):
    t = tree.with_directories(V.nodes_v1(spark, d))
    return t.agg(F.count_if(F.col("node_type") != "directory").alias("n_files"), F.count_if(F.col("node_type") == "directory").alias("n_dirs"), F.sum(F.when(F.col("node_type") == "file", F.col("size"))).alias("bytes"))


def _merkle(where: str) -> str:
    line = "string_agg(regexp_extract({p}, '[^/]*$') || '|' || {k} || '|' || {i}, chr(10) ORDER BY regexp_extract({p}, '[^/]*$') || '|' || {k} || '|' || {i})"
    up = "regexp_replace({p}, '/[^/]*$', '')"
    f = line.format(p="path", k="node_type", i="content_id")
    g = line.format(p="path", k="'directory'", i="tree_id")
    return (
        _N1
        + f""", s3 AS (SELECT {up.format(p="path")} AS path, sha256({f}) AS tree_id FROM nodes_v1 WHERE {where} GROUP BY 1),
s2 AS (SELECT {up.format(p="s3.path")} AS path, sha256({g.replace("(path,", "(s3.path,")}) AS tree_id FROM s3 GROUP BY 1), s1 AS (SELECT '/' AS path, sha256({g.replace("(path,", "(s2.path,")}) AS tree_id FROM s2)
SELECT * FROM s3 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s1"""
    )


@query(_merkle("true"))
def tree_merkle(spark, d):
    return tree.tree_ids(V.nodes_v1(spark, d))


@query(_merkle("NOT starts_with(path, '/en/issues/')"))
def amend_exclude(spark, d):
    return tree.amend(V.nodes_v1(spark, d), ["/en/issues"])


def _size_sql(x: str) -> str:
    one = lambda p, u: f"printf('%.3f {u}', round_even({x}::DOUBLE / {1024**p}, 3))"
    return f"CASE WHEN {x} >= {1024**3} THEN {one(3, 'GiB')} WHEN {x} >= {1024**2} THEN {one(2, 'MiB')} WHEN {x} >= 1024 THEN {one(1, 'KiB')} ELSE {x} || ' B' END"


@query(_N1 + f"SELECT path, name, '-rw-r--r--' AS perms, {_size_sql('size')} AS size_h FROM nodes_v1 WHERE parent = '/en/forum'")
def ls_long(spark, d):
    rows = tree.list_directory(V.nodes_v1(spark, d), "/en/forum")
    mode = F.col("mode").bitwiseOR(F.lit(0o100000))
    return rows.select("path", "name", S.permissions(mode).alias("perms"), S.format_size(F.col("size")).alias("size_h")).orderBy(F.lower("name"))


_EV, _ORD = with_views("snapshots_ev"), with_views("snapshots_ord")


@query(_EV + "SELECT substr(snapshot_id, 1, 8) AS short_id, ts, size, array_to_string(list_sort(tags), ', ') AS tags FROM snapshots_ev")
def log_compact(spark, d):
    df = V.snapshots_ev(spark, d)
    return df.orderBy("ts", "snapshot_id").select(S.short_id(F.col("snapshot_id"), 4).alias("short_id"), "ts", "size", F.array_join(F.array_sort("tags"), ", ").alias("tags"))


@query(_EV + "SELECT snapshot_id, ts FROM snapshots_ev WHERE list_has_any(tags, ['error', 'signup']) OR len(tags) = 0")
def log_by_tag(spark, d):
    return retention.keep_tags(V.snapshots_ev(spark, d), ["error", "signup", "[]"]).select("snapshot_id", "ts")


@query(_EV + "SELECT repo, max_by(snapshot_id, (ts, snapshot_id)) AS snapshot_id, max(ts) AS ts FROM snapshots_ev GROUP BY repo")
def snapshot_latest(spark, d):
    return retention.latest(V.snapshots_ev(spark, d))


_PREFIXES = ["5feceb66", "6b", "", "zz", "4"]


@query(
    _EV
    + f""", q AS (SELECT unnest({_PREFIXES!r}) AS prefix)
SELECT prefix, CASE WHEN prefix = '' THEN 0 ELSE count(snapshot_id) END AS n_matches, CASE WHEN prefix = '' THEN 'invalid' WHEN count(snapshot_id) = 0 THEN 'none' WHEN count(snapshot_id) = 1 THEN 'ok' ELSE 'ambiguous' END AS status
FROM q LEFT JOIN snapshots_ev ON prefix <> '' AND starts_with(snapshot_id, prefix) GROUP BY prefix"""
)
def find_by_prefix(spark, d):
    return retention.find_by_prefix(V.snapshots_ev(spark, d), _PREFIXES)


_KEEP = "SELECT repo, snapshot_id FROM ({ranked}) WHERE {cond}"
_BUCKET = """SELECT repo, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY b DESC) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, b ORDER BY ts DESC, snapshot_id DESC) AS r FROM (SELECT *, {b} AS b FROM snapshots_ord)) WHERE r = 1) WHERE k <= {n}"""
_BUCKET_SQL = {"yearly": "year(ts)", "monthly": "strftime(ts, '%Y-%m')", "weekly": "isoyear(ts) * 100 + week(ts)", "daily": "strftime(ts, '%Y-%m-%d')"}
_LAST_SQL = "SELECT repo, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, snapshot_id DESC) AS r FROM snapshots_ord) WHERE r <= {n}"
_NOW, _WITHIN = datetime(2001, 8, 1), 730 * 86_400
_WITHIN_SQL = "SELECT repo, snapshot_id FROM snapshots_ord WHERE ts >= TIMESTAMP '2001-08-01' - INTERVAL 730 DAY"


@query(_ORD + _LAST_SQL.format(n=3))
def keep_last(spark, d):
    return retention.keep_last(V.snapshots_ord(spark, d), 3).select("repo", "snapshot_id")


@query(_ORD + _WITHIN_SQL)
def keep_within(spark, d):
    return retention.keep_within(V.snapshots_ord(spark, d), _WITHIN, _NOW).select("repo", "snapshot_id")


def _bucket_query(bucket: str, n: int):
    def f(spark, d):
        return retention.keep_bucket(V.snapshots_ord(spark, d), bucket, n).select("repo", "snapshot_id")

    f.__name__ = f"keep_{bucket}"
    query(_ORD + _BUCKET.format(b=_BUCKET_SQL[bucket], n=n))(f)


for _b, _n in (("yearly", 3), ("monthly", 4), ("weekly", 5), ("daily", 8)):
    _bucket_query(_b, _n)


@query(_EV + "SELECT repo, snapshot_id FROM snapshots_ev WHERE list_has_any(tags, ['purchase'])")
def keep_tags(spark, d):
    return retention.keep_tags(V.snapshots_ev(spark, d), ["purchase"]).select("repo", "snapshot_id")


@query(_ORD + f", k AS ({_LAST_SQL.format(n=4)} UNION {_WITHIN_SQL} UNION {_BUCKET.format(b='year(ts)', n=3)}) SELECT s.repo, s.snapshot_id, k.snapshot_id IS NOT NULL AS keep FROM snapshots_ord s LEFT JOIN k ON s.repo = k.repo AND s.snapshot_id = k.snapshot_id")
def forget_plan(spark, d):
    df = V.snapshots_ord(spark, d)
    return retention.forget_plan(df, [retention.keep_last(df, 4), retention.keep_within(df, _WITHIN, _NOW), retention.keep_bucket(df, "yearly", 3)])


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_id, strlen(coalesce(text, '')) AS size FROM documents")
def content_ids(spark, d):
    t = F.coalesce("text", F.lit(""))
    return read_table(spark, d, "documents").select("doc_id", S.content_hash(t).alias("content_id"), F.octet_length(t).cast("long").alias("size"))


_CH = with_views("chunks")


@query(_CH + "SELECT doc_id, seq, chunk_id, len FROM chunks")
def chunk_lines(spark, d):
    return V.chunks(spark, d).drop("chunk")


@query(_CH + "SELECT count(*) AS n_refs, count(DISTINCT chunk_id) AS n_unique, sum(len)::BIGINT AS raw_bytes, (SELECT sum(l)::BIGINT FROM (SELECT max(len) AS l FROM chunks GROUP BY chunk_id)) AS unique_bytes FROM chunks")
def dedup_stats(spark, d):
    return dedup.dedup_stats(V.chunks(spark, d))


_LINES = "SELECT sha256(ch) AS chunk_id, strlen(ch) AS len FROM (SELECT unnest(list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN i < len(string_split(content, chr(10))) THEN x || chr(10) ELSE x END)) AS ch FROM {v})"


@query(with_views("nodes_v1", "nodes_v2") + f", a AS ({_LINES.format(v='nodes_v1')}), b AS ({_LINES.format(v='nodes_v2')}) SELECT DISTINCT chunk_id, len FROM b WHERE chunk_id NOT IN (SELECT chunk_id FROM a)")
def dedup_new_blobs(spark, d):
    cut = lambda df: chunking.delimiter_chunks(df, "path", "content").select("chunk_id", "len")
    return dedup.new_blobs(cut(V.nodes_v2(spark, d)), cut(V.nodes_v1(spark, d)))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_id FROM documents")
def reassemble(spark, d):
    return chunking.reassemble(V.chunks(spark, d), "doc_id").select("doc_id", S.content_hash(F.col("content")).alias("content_id"))


_IX, _GC = with_views("ix"), with_views("ix", "refs")


@query(_GC + 'SELECT DISTINCT blob_id, pack_id, "offset" FROM (SELECT *, (sum(length) OVER (PARTITION BY pack_id ORDER BY seq, blob_id ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS "offset" FROM ix) WHERE blob_id IN (SELECT blob_id FROM refs)')
def blob_lookup(spark, d):
    located = packing.with_offsets(V.index_entries(spark, d), "pack_id", ["seq", "blob_id"], "length")
    return dedup.blob_lookup(V.refs(spark, d), located).select("blob_id", "pack_id", "offset")


@query(
    _IX
    + """, o AS (SELECT *, (sum(length) OVER (PARTITION BY pack_id ORDER BY seq, blob_id ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS pos FROM ix)
SELECT pack_id, count(*) AS n_blobs, sum(length)::BIGINT AS bytes, string_agg(pos || ':' || blob_id || ':' || blob_type || ':' || length, ',' ORDER BY pos, blob_id) AS blobs FROM o GROUP BY 1"""
)
def index_nested(spark, d):
    located = packing.with_offsets(V.index_entries(spark, d), "pack_id", ["seq", "blob_id"], "length")
    text = lambda x: F.concat_ws(":", x["offset"].cast("string"), x["blob_id"], x["blob_type"], x["length"].cast("string"))
    return packing.nested_index(located).select("pack_id", "n_blobs", "bytes", F.array_join(F.transform("blobs", text), ",").alias("blobs"))


@query(
    _IX
    + """, p AS (SELECT pack_id, count(DISTINCT blob_id) AS n_blobs, substr(sha256(pack_id::VARCHAR), 1, 3) AS r FROM ix GROUP BY ALL)
SELECT pack_id, n_blobs, ((sum(n_blobs) OVER (ORDER BY r, pack_id ROWS UNBOUNDED PRECEDING) - n_blobs) // 4096)::BIGINT AS index_no FROM p"""
)
def index_merge(spark, d):
    """Index files of 4,096 blobs each, so that there are several at every scale."""
    one = V.index_entries(spark, d)
    return packing.merge_indexes(one.unionByName(one.where("pack_id % 3 = 0")), most=4096)


@query(
    """WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, strlen(coalesce(text, '')) AS n FROM documents),
f(i, pack, fill, n) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL SELECT o.i, CASE WHEN f.fill > 20000 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.fill > 20000 THEN 0 ELSE f.fill END + o.n, o.n FROM f JOIN o ON o.i = f.i + 1)
SELECT pack, count(*) AS n, sum(n)::BIGINT AS bytes FROM f WHERE i > 0 GROUP BY pack"""
)
def pack_assign(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.lit("data").alias("blob_type"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return packing.assign_packs(docs, "blob_type", "doc_id", "size", most=20_000).groupBy("pack").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(_GC + "SELECT pack_id, count(*) AS n_ref FROM ix WHERE blob_id IN (SELECT blob_id FROM refs) GROUP BY 1")
def reachable_packs(spark, d):
    return gc.reachable_packs(V.index_entries(spark, d), V.refs(spark, d))


_PB = _GC + ", pb AS (SELECT pack_id, count(*) FILTER (u) AS n_ref, sum(length)::BIGINT AS total, coalesce(sum(length) FILTER (NOT u), 0)::BIGINT AS garbage FROM (SELECT *, blob_id IN (SELECT blob_id FROM refs) AS u FROM ix) GROUP BY 1)"
_PLAN = _PB + """, pl AS (SELECT *, CASE WHEN n_ref = 0 THEN 'unused' WHEN garbage / 300.0 > 0.05 THEN 'obsolete'
  WHEN total / 300.0 < 0.05 AND (SELECT count(*) FROM pb WHERE n_ref > 0 AND NOT garbage / 300.0 > 0.05 AND total / 300.0 < 0.05) > 1 THEN 'small' WHEN garbage > 0 THEN 'tolerated' ELSE 'kept' END AS status FROM pb)
"""


def _plan(spark, d):
    return gc.gc_plan(V.index_entries(spark, d), V.refs(spark, d), most=300)


@query(_PB + " SELECT pack_id, total, garbage FROM pb")
def gc_pack_bytes(spark, d):
    return gc.pack_bytes(V.index_entries(spark, d), V.refs(spark, d)).select("pack_id", "total", "garbage")


@query(_PLAN + "SELECT pack_id, status FROM pl")
def gc_plan(spark, d):
    return _plan(spark, d).select("pack_id", "status")


@query(_PLAN + "SELECT status, count(*) AS n FROM pl GROUP BY 1")
def gc_plan_summary(spark, d):
    return gc.plan_summary(_plan(spark, d))


@query(_PLAN + "SELECT blob_id, min(pack_id) AS pack_id FROM ix WHERE blob_id IN (SELECT blob_id FROM refs) AND pack_id IN (SELECT pack_id FROM pl WHERE status IN ('obsolete', 'small')) GROUP BY 1")
def gc_repack_set(spark, d):
    return gc.repack_set(V.index_entries(spark, d), V.refs(spark, d), _plan(spark, d))


@query(_GC + "SELECT snapshot_id, count(*) FILTER (blob_id NOT IN (SELECT blob_id FROM ix WHERE pack_id % 7 <> 0)) AS n_missing FROM refs GROUP BY 1")
def verify_links(spark, d):
    return gc.missing_references(V.index_entries(spark, d).where("pack_id % 7 <> 0"), V.refs(spark, d))


@query("SELECT doc_id, NOT (doc_id % 11 = 0 AND strlen(coalesce(text, '')) > 0) AS ok FROM documents")
def verify_hashes(spark, d):
    """Stored contents against their ids; every eleventh stored content was altered."""
    t = F.coalesce("text", F.lit(""))
    stored = F.when(F.col("doc_id") % 11 == 0, F.regexp_replace(t, r"^[\s\S]", "")).otherwise(t)
    return read_table(spark, d, "documents").select("doc_id", (S.content_hash(stored) == S.content_hash(t)).alias("ok"))


@query(_GC + "SELECT count(*) AS n_dangling FROM ix WHERE blob_id NOT IN (SELECT blob_id FROM refs)")
def dangling_blobs(spark, d):
    return gc.dangling_blobs(V.index_entries(spark, d), V.refs(spark, d)).agg(F.count(F.lit(1)).alias("n_dangling"))


@query(
    """SELECT doc_id, 'sftp' AS scheme, 'u' || doc_id % 7 AS username, 'host' || doc_id % 13 AS host, CASE WHEN doc_id % 2 = 0 THEN 1000 + doc_id % 90 END AS port, 'a b/' || doc_id || '/x' AS path FROM documents"""
)
def parse_url(spark, d):
    i = F.col("doc_id").cast("string")
    port = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(":"), (F.lit(1000) + F.col("doc_id") % 90).cast("string"))).otherwise(F.lit(""))
    url = F.concat(F.lit("SFTP://u"), (F.col("doc_id") % 7).cast("string"), F.lit("@Host"), (F.col("doc_id") % 13).cast("string"), port, F.lit("/a%20b/./gone/../"), i, F.lit("/x?q=1#f"))
    df = read_table(spark, d, "documents").select("doc_id", S.parse_url(url).alias("u"))
    return df.select("doc_id", "u.scheme", "u.username", "u.host", "u.port", F.array_join("u.path", "/").alias("path"))


_DUR = "array_to_string(list_slice(list_filter([CASE WHEN s // 86400 > 0 THEN s // 86400 || 'd' END, CASE WHEN s % 86400 // 3600 > 0 OR (s // 86400 > 0 AND s % 3600 // 60 > 0) THEN s % 86400 // 3600 || 'h' END, CASE WHEN s % 3600 // 60 > 0 THEN s % 3600 // 60 || 'm' END, CASE WHEN s % 60 > 0 THEN s % 60 || 's' END], lambda x: x IS NOT NULL), 1, 2), ' ')"


@query(f"SELECT l_orderkey, {_size_sql('b')} AS size_h, CASE WHEN s = 0 THEN '0s' ELSE {_DUR} END AS duration_h FROM (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) * 997 AS b, CAST(sum(l_quantity) AS BIGINT) * 641 AS s FROM lineitem GROUP BY 1)")
def format_values(spark, d):
    q = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    return q.select("l_orderkey", S.format_size(F.col("q") * 997).alias("size_h"), S.format_duration(F.col("q") * 641_000).alias("duration_h"))


@query("SELECT event_id, (event_id % 9)::BIGINT * 86400 + (event_id % 5) * 3600 + (event_id % 70) * 60 AS seconds, event_id % 13 <> 0 AS valid FROM events WHERE event_id % 13 <> 0 UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 13 = 0")
def parse_durations(spark, d):
    e = F.col("event_id")
    text = F.concat((e % 9).cast("string"), F.lit("d"), (e % 5).cast("string"), F.lit("h"), (e % 70).cast("string"), F.when(e % 13 == 0, "q").otherwise("m"))
    s = S.parse_duration(text)
    return read_table(spark, d, "events").select("event_id", s.alias("seconds"), s.isNotNull().alias("valid"))


@query("SELECT event_id, ['a' || event_id % 3, 'b'] AS tags FROM events")
def parse_tags(spark, d):
    a = F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string"))
    return read_table(spark, d, "events").select("event_id", S.parse_tags(F.concat(F.lit(" b,"), a, F.lit(", ,"), a)).alias("tags"))




@query()
def cdc_chunks(spark, d):
    return chunking.content_chunks(read_table(spark, d, "documents"), "doc_id", F.col("text"), 64, 256, 1024).select("doc_id", "seq", "len")


@query()
def zstd_sizes(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return packfile.compressed(docs, "content", "enc").select("doc_id", F.octet_length("content").alias("raw_len"), F.octet_length("enc").alias("enc_len"))


_STORED = """WITH one AS (SELECT lower(snapshot_id) AS snapshot_id, repo_id AS repo, snap_time AS ts, coalesce(tags, []) AS tags FROM snapshots QUALIFY row_number() OVER (PARTITION BY lower(snapshot_id) ORDER BY loaded_at) = 1)
"""


def _stored(spark, d):
    """The stored snapshots, each once at its earliest row."""
    df = read_table(spark, d, "snapshots").groupBy(F.lower("snapshot_id").alias("snapshot_id")).agg(F.min(F.struct("loaded_at", "repo_id", "snap_time", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))).alias("x"))
    return df.select("snapshot_id", F.col("x.repo_id").alias("repo"), F.col("x.snap_time").alias("ts"), F.col("x.tags").alias("tags"))


@query(_STORED + "SELECT repo, max_by(snapshot_id, (ts, snapshot_id)) AS snapshot_id, max(ts) AS ts FROM one GROUP BY repo")
def stored_latest(spark, d):
    return retention.latest(_stored(spark, d))


@query(_STORED + "SELECT snapshot_id FROM one WHERE len(tags) = 0 OR list_contains(tags, 'db')")
def stored_by_tag(spark, d):
    return retention.keep_tags(_stored(spark, d), ["db", "[]"]).select("snapshot_id")


@query("SELECT node_type, count(DISTINCT node_id) AS n FROM tree_nodes GROUP BY 1")
def node_kinds(spark, d):
    return read_table(spark, d, "tree_nodes").groupBy("node_type").agg(F.countDistinct("node_id").alias("n"))


@query("SELECT lower(pack_id) AS pack_id, lower(blob_id) AS blob_id, substr(hex(data), 2 * blob_offset + 1, 2 * blob_length) AS bytes FROM (SELECT DISTINCT lower(pack_id) AS pack_id, data FROM packs WHERE data IS NOT NULL) JOIN (SELECT DISTINCT lower(p.pack_id) AS pack_id, lower(blob_id) AS blob_id, blob_offset, blob_length FROM index_entries e JOIN index_packs p ON lower(e.index_id) = lower(p.index_id) AND e.pack_array_index = p.pack_array_index WHERE blob_type <> 'padding') USING (pack_id)")
def blob_read(spark, d):
    """Blobs read from the packs whose bytes are given: a slice of the pack at the index's offset and length."""
    low = lambda c: F.lower(c).alias(c)
    packs = read_table(spark, d, "packs").where("data is not null").select(low("pack_id"), "data").distinct()
    slots = read_table(spark, d, "index_packs").select(low("index_id"), "pack_array_index", low("pack_id")).distinct()
    entries = read_table(spark, d, "index_entries").where("blob_type <> 'padding'").select(low("index_id"), "pack_array_index", low("blob_id"), "blob_offset", "blob_length")
    at = entries.join(slots, ["index_id", "pack_array_index"]).select("pack_id", "blob_id", "blob_offset", "blob_length").distinct().join(packs, "pack_id")
    piece = F.substring(F.col("data"), F.col("blob_offset").cast("int") + 1, F.col("blob_length").cast("int"))
    return at.select("pack_id", "blob_id", F.hex(piece).alias("bytes"))


@query("SELECT lower(index_id) AS index_id, count(*) AS n_blobs, count(DISTINCT pack_array_index) AS n_packs, count(*) >= 65535 AS is_full FROM (SELECT DISTINCT lower(index_id) AS index_id, lower(blob_id) AS blob_id, pack_array_index FROM index_entries WHERE deleted_at IS NULL AND blob_type <> 'padding' AND index_id IS NOT NULL) GROUP BY 1")
def index_counts(spark, d):
    e = read_table(spark, d, "index_entries").where("deleted_at is null and blob_type <> 'padding' and index_id is not null")
    e = e.select(F.lower("index_id").alias("index_id"), F.lower("blob_id").alias("blob_id"), "pack_array_index").distinct()
    n = F.count(F.lit(1))
    return e.groupBy("index_id").agg(n.alias("n_blobs"), F.countDistinct("pack_array_index").alias("n_packs"), (n >= packing.MAX_INDEX_BLOBS).alias("is_full"))


@query("SELECT repo_id, count(*) AS n, sum(b)::BIGINT AS processed, sum(r)::BIGINT AS raw, sum(e)::BIGINT AS encoded FROM (SELECT DISTINCT lower(snapshot_id), repo_id, summary.processed_bytes AS b, summary.raw_bytes AS r, summary.encoded_bytes AS e FROM snapshots) GROUP BY 1")
def byte_accounts(spark, d):
    s = read_table(spark, d, "snapshots").select(F.lower("snapshot_id").alias("id"), "repo_id", "summary.processed_bytes", "summary.raw_bytes", "summary.encoded_bytes").distinct()
    return s.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.sum("processed_bytes").alias("processed"), F.sum("raw_bytes").alias("raw"), F.sum("encoded_bytes").alias("encoded"))


@query("SELECT t AS event_type, row_number() OVER (ORDER BY f, t) - 1 AS ordinal FROM (SELECT event_type AS t, min(event_id) AS f FROM events WHERE event_type IS NOT NULL GROUP BY 1)")
def first_seen(spark, d):
    return packing.first_seen_ordinals(read_table(spark, d, "events"), "event_type", "event_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def replace_by_name(spark, d):
    rows = read_table(spark, d, "events").select("user_id", "event_type", "event_id")
    return tree.replace_children(rows, "user_id", "event_type", "event_id")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT lower(tree_id) AS p, lower(tree) AS c FROM tree_nodes WHERE node_type = 'directory' AND tree IS NOT NULL),
w(t) AS (SELECT DISTINCT lower(tree) FROM snapshots UNION SELECT e.c FROM w JOIN e ON e.p = w.t)
SELECT DISTINCT lower(b) AS blob_id FROM (SELECT tree_id, unnest(blobs) AS b FROM tree_nodes) WHERE lower(tree_id) IN (SELECT t FROM w) UNION SELECT t FROM w"""
)
def reachable_blobs(spark, d):
    """Every blob that a snapshot needs: its trees and the blobs of their nodes."""
    nodes = read_table(spark, d, "tree_nodes")
    links = nodes.where("node_type = 'directory'").select(id_key("tree_id").alias("parent"), "name", id_key("tree").alias("child"), "node_id")
    roots = read_table(spark, d, "snapshots").select(id_key("tree").alias("root")).where("root is not null").distinct()
    trees = written(tree.reachable_nodes(links, roots, "parent", "child", "node_id", "root"), "trees")
    listed = nodes.select(id_key("tree_id").alias("node"), "blobs").join(trees, "node", "left_semi").select(F.explode("blobs").alias("b")).select(id_key("b").alias("node"))
    return trees.unionByName(listed).distinct().select(id_text("node").alias("blob_id"))


@query("SELECT lower(tree_id) AS tree_id, count(*) AS n FROM (SELECT DISTINCT tree_id, name, node_type FROM (SELECT lower(tree_id) AS tree_id, name, node_type FROM tree_nodes)) GROUP BY 1")
def tree_json(spark, d):
    """Trees as JSON lists of nodes by name, and back."""
    nodes = read_table(spark, d, "tree_nodes").select(F.lower("tree_id").alias("tree_id"), "name", "node_type").distinct()
    texts = nodes.groupBy("tree_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "node_type")))).alias("json"))
    return texts.select("tree_id", F.size(F.from_json("json", "array<struct<name: string, node_type: string>>")).cast("long").alias("n"))
