"""Derived inputs over the driver tables, as DataFrames and as the same SQL: listings, snapshots, chunks, index entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.functions.paths import name_of, parent_of
from snapweave.operators.chunking import delimiter_chunks
from snapweave.session import read_table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "documents")
    lang = F.coalesce("lang", F.lit("xx"))
    source = F.coalesce(F.nullif(F.regexp_replace(F.lower(F.coalesce("source", F.lit(""))), "[^a-z]", ""), F.lit("")), F.lit("none"))
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"), F.concat_ws("/", F.lit(""), lang, source, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))


def _nodes(df: DataFrame, kind, mode) -> DataFrame:
    return df.select(
        "doc_id", "lang", "path", parent_of(F.col("path")).alias("parent"), name_of(F.col("path")).alias("name"), kind.alias("node_type"), F.octet_length("text").cast("long").alias("size"), mode.alias("mode"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")).cast("timestamp_ntz").alias("modified_time"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_id"),
    )


def nodes_v1(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(_documents(spark, d).where("doc_id % 10 <> 3"), F.lit("file"), F.lit(420))


def nodes_v2(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 10
    df = _documents(spark, d).where(k != 7).withColumn("text", F.when(k == 5, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")))
    return _nodes(df, F.when(k == 6, "symlink").otherwise("file"), F.when(k == 6, 41471).when(k == 4, 384).otherwise(420))


def snapshots_ev(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "events")
    tags = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type"))
    return df.select(F.col("user_id").alias("repo"), F.sha2(F.col("event_id").cast("string"), 256).alias("snapshot_id"), "ts", tags.alias("tags"), F.floor("value").cast("long").alias("size"))


def snapshots_ord(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("ts"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return delimiter_chunks(_documents(spark, d), "doc_id", "text")


def index_entries(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "lineitem")
    blob = F.sha2(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), 256)
    return df.select(F.col("l_orderkey").alias("pack_id"), blob.alias("blob_id"), F.lit("data").alias("blob_type"), F.col("l_quantity").cast("long").alias("length"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("snapshot_id"))


def refs(spark: SparkSession, d: str) -> DataFrame:
    return index_entries(spark, d).where("flag <> 'R'").select("snapshot_id", "blob_id")


_DOC = """docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'xx') AS lang,
  '/' || coalesce(lang, 'xx') || '/' || coalesce(nullif(regexp_replace(lower(coalesce(source, '')), '[^a-z]', '', 'g'), ''), 'none') || '/' || doc_id || '.txt' AS path FROM documents)"""
_NODE = """doc_id, lang, path, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS name, {kind} AS node_type, strlen(t) AS size, {mode} AS mode,
  TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS modified_time, t AS content, sha256(t) AS content_id"""
#: Common table expressions by name; each lists those it needs.
VIEWS = {
    "docs": ([], _DOC),
    "nodes_v1": (["docs"], f"nodes_v1 AS (SELECT {_NODE.format(kind=chr(39) + 'file' + chr(39), mode='420')} FROM (SELECT *, text AS t FROM docs WHERE doc_id % 10 <> 3))"),
    "nodes_v2": (["docs"], "nodes_v2 AS (SELECT " + _NODE.format(kind="CASE WHEN doc_id % 10 = 6 THEN 'symlink' ELSE 'file' END", mode="CASE doc_id % 10 WHEN 6 THEN 41471 WHEN 4 THEN 384 ELSE 420 END") + " FROM (SELECT *, CASE WHEN doc_id % 10 = 5 THEN text || ' v2' ELSE text END AS t FROM docs WHERE doc_id % 10 <> 7))"),
    "snapshots_ev": ([], "snapshots_ev AS (SELECT user_id AS repo, sha256(CAST(event_id AS VARCHAR)) AS snapshot_id, ts, CASE WHEN event_id % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE [event_type] END AS tags, CAST(floor(value) AS BIGINT) AS size FROM events)"),
    "snapshots_ord": ([], "snapshots_ord AS (SELECT o_custkey AS repo, o_orderkey AS snapshot_id, o_orderdate AS ts FROM orders)"),
    "pieces": (["docs"], "pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq, len(string_split(text, chr(10))) AS n FROM docs)"),
    "chunks": (["pieces"], "chunks AS (SELECT doc_id, seq, chunk, sha256(chunk) AS chunk_id, strlen(chunk) AS len FROM (SELECT doc_id, seq, CASE WHEN seq < n - 1 THEN c || chr(10) ELSE c END AS chunk FROM pieces))"),
    "ix": ([], "ix AS (SELECT l_orderkey AS pack_id, sha256(l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber) AS blob_id, 'data' AS blob_type, CAST(l_quantity AS BIGINT) AS length, l_linenumber AS seq, l_returnflag AS flag, l_suppkey AS snapshot_id FROM lineitem)"),
    "refs": (["ix"], "refs AS (SELECT snapshot_id, blob_id FROM ix WHERE flag <> 'R')"),
}


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines the named views and what they need."""
    out: dict[str, str] = {}

    def add(n: str) -> None:
        for need in VIEWS[n][0]:
            add(need)
        out.setdefault(n, VIEWS[n][1])

    for n in names:
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(out.values()) + "\n"
