import hashlib
import os
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapweave.operators import chunking, dedup, diff, gc, packing, retention, tree
from snapweave.sources import filescan, packfile
from snapweave.sources.catalog import Store
from snapweave.streaming import ingest

NOW = datetime(2024, 5, 1)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000), st.integers(1, 64), st.integers(0, 200), st.integers(0, 800))
def test_chunks_put_together_give_the_content(data, least, more, most):
    average, greatest = least + more, least + more + most
    ends = chunking.cut_points(data, least, average, greatest)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and sum(sizes) == len(data)
    assert all(least <= s <= greatest for s in sizes[:-1]) and sizes[-1] <= greatest


def test_an_insertion_moves_few_chunks():
    data = b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(4000))
    cut = lambda d: {d[a:b] for e in [chunking.cut_points(d, 256, 1024, 8192)] for a, b in zip([0, *e], e)}
    a, b = cut(data), cut(data[:500] + b"!" + data[500:])
    assert len(a - b) <= 4 < len(a) / 4


def test_chunk_tables(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, None), (4, "é" * 300), (4, "x")], "i int, t string")
    lines = chunking.delimiter_chunks(df.where("i < 4"), "i", "t")
    assert sorted((r["i"], r["seq"], r["chunk"]) for r in lines.collect()) == [(1, 0, "a\n"), (1, 1, "b\n"), (1, 2, ""), (2, 0, "")]
    assert {r["i"]: r["content"] for r in chunking.reassemble(lines, "i").collect()} == {1: "a\nb\n", 2: ""}
    cut = chunking.content_chunks(df, "i", F.col("t"), 16, 32, 64).collect()
    assert sum(r["len"] for r in cut if r["i"] == 4) == 601 and [r["len"] for r in cut if r["i"] == 2] == [0]
    assert chunking.content_chunks(df.limit(0), "i", F.col("t")).collect() == []


NODE = "path string, node_type string, content_id string, size long, mode int, modified_time timestamp_ntz, status string"


def test_diff(spark):
    node = lambda p, kind="file", cid="c", size=1, mode=420, t=NOW: (p, kind, cid, size, mode, t, "clash")
    a = spark.createDataFrame([node("same"), node("gone"), node("mode"), node("text"), node("type"), node("odd"), node("null", t=None), node(None)], NODE)
    b = spark.createDataFrame([node("same"), node("new"), node("mode", mode=1), node("text", cid="d", size=2), node("type", kind="symlink", mode=2), node("odd", cid="e"), node("null", t=None)], NODE)
    got = {r["path"]: r["symbol"] for r in diff.diff_nodes(a, b).collect() if r["path"]}
    assert got == {"same": "U", "gone": "-", "new": "+", "mode": "m", "text": "M", "type": "T", "odd": "?", "null": "U"}
    assert {r["symbol"] for r in diff.diff_nodes(a, a).where("path is not null").collect()} == {"U"}
    back = {r["path"]: r["symbol"] for r in diff.diff_nodes(b, a).collect() if r["path"]}
    assert back["gone"] == "+" and back["new"] == "-"
    real = a.where("path <> 'odd'"), b.where("path <> 'odd'")
    rebuilt = diff.apply_diff(real[0].where("path is not null"), diff.diff_nodes(*real), real[1])
    assert sorted(map(tuple, rebuilt.collect()), key=str) == sorted(map(tuple, real[1].collect()), key=str)
    assert diff.diff_nodes(a.limit(0), b.limit(0)).collect() == []


def snaps(spark):
    days = [(1, "2023-01-02", ["x"]), (2, "2023-01-08", []), (3, "2023-01-22", ["y"]), (4, "2023-01-22", None), (5, "2023-12-31", []), (6, "2024-12-31", []), (7, "2025-05-25", ["x", "y"])]
    return spark.createDataFrame([(1, i, datetime.fromisoformat(t), tags) for i, t, tags in days], "repo int, snapshot_id int, ts timestamp_ntz, tags array<string>")


def ids(df):
    return sorted(r["snapshot_id"] for r in df.collect())


def test_retention(spark):
    df = snaps(spark)
    assert ids(retention.keep_last(df, 3)) == [5, 6, 7]
    assert ids(retention.keep_bucket(df, "yearly", 3)) == [5, 6, 7]
    assert ids(retention.keep_bucket(df, "daily", 4)) == [4, 5, 6, 7]  # of equal times the greater id
    assert ids(retention.keep_bucket(df, "weekly", 2)) == [6, 7]  # the last day of 2024 is in week 1 of 2025
    assert ids(retention.keep_within(df, 730 * 86_400, datetime(2025, 5, 25))) == [5, 6, 7]
    assert ids(retention.keep_tags(df, ["x"])) == [1, 7]
    assert ids(retention.keep_tags(df, ["[]"])) == [2, 4, 5, 6]
    assert ids(retention.keep_tags(df, [])) == []
    plan = retention.forget_plan(df, [retention.keep_last(df, 1), retention.keep_tags(df, ["y"])])
    assert sorted(r["snapshot_id"] for r in plan.collect() if r["keep"]) == [3, 7]
    assert ids(retention.forget_plan(df, []).where("keep")) == []
    assert retention.latest(df.limit(0)).collect() == []


def test_packs(spark):
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate([5, 5, 1, 20, None, 3])] + [("t", 0, 100)], "kind string, i int, n long")
    got = sorted((r["kind"], r["i"], r["pack"]) for r in packing.assign_packs(df, "kind", "i", "n", most=10).collect())
    assert got == [("d", 0, 0), ("d", 1, 0), ("d", 2, 0), ("d", 3, 1), ("d", 4, 2), ("d", 5, 2), ("t", 0, 0)]
    entries = spark.createDataFrame([(f"p{i}", f"b{i}{j}") for i in range(40) for j in range(5)] * 2, "pack_id string, blob_id string")
    files = packing.merge_indexes(entries, most=20).collect()
    assert len(files) == 40 and all(r["n_blobs"] == 5 for r in files)
    by = {}
    for r in files:
        by[r["index_no"]] = by.get(r["index_no"], 0) + r["n_blobs"]
    assert max(by.values()) <= 20 + 5


def test_gc(spark):
    index = spark.createDataFrame([("p1", "a", "data", 10), ("p1", "b", "data", 90), ("p2", "c", "data", 100), ("p3", "d", "data", 3), ("p4", "e", "data", 4), ("p5", "f", "data", 50), ("p6", "g", "data", 96), ("p6", "h", "data", 4)], "pack_id string, blob_id string, blob_type string, length long")
    refs = spark.createDataFrame([("s", x) for x in ("a", "c", "d", "e", "g", "a", None, "lost")], "snapshot_id string, blob_id string")
    plan = gc.gc_plan(index, refs, most=100, tolerance=0.05, small_factor=0.05)
    assert {r["pack_id"]: r["status"] for r in plan.collect()} == {"p1": "obsolete", "p2": "kept", "p3": "small", "p4": "small", "p5": "unused", "p6": "tolerated"}
    assert {tuple(r) for r in gc.repack_set(index, refs, plan).collect()} == {("a", "p1"), ("d", "p3"), ("e", "p4")}
    assert [tuple(r) for r in gc.missing_references(index, refs).collect()] == [("s", 1)]
    used = {r["pack_id"] for r in plan.where("status = 'unused'").collect()}
    assert not used & {r["pack_id"] for r in gc.reachable_packs(index, refs).collect()}
    assert gc.gc_plan(index.limit(0), refs, most=100).collect() == []
    assert {r["status"] for r in gc.gc_plan(index, refs.limit(0), most=100).collect()} == {"unused"}


def test_trees(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, node_type string, size long, content_id string")
    a = [("/x/a", "file", 1, "1"), ("/x/y/b", "file", 1, "2"), ("/c", "file", 1, None), (None, "file", 1, "3")]
    one = {r["path"]: r["tree_id"] for r in tree.tree_ids(files(a)).collect()}
    assert set(one) == {"/", "/x", "/x/y"}
    two = {r["path"]: r["tree_id"] for r in tree.tree_ids(files([("/x/y/b", "file", 1, "9"), *a[:1], *a[2:]])).collect()}
    assert all(one[p] != two[p] for p in one)
    cut = {r["path"]: r["tree_id"] for r in tree.amend(files(a), ["/x/y"]).collect()}
    assert set(cut) == {"/", "/x"}
    assert tree.tree_ids(files([])).collect() == []
    assert {r["path"] for r in tree.list_directory(tree.with_directories(files(a)), "/").collect()} == {"/x", "/c"}


def test_pack_files(spark):
    blobs = [(hashlib.sha256(x).digest(), k, x) for x, k in ((b"one", "data"), (b"", "tree"), (b"three", "data"))]
    pack = packfile.build_pack(blobs)
    assert [(i, k, pack[o : o + n]) for i, k, o, n in packfile.read_header(pack)] == blobs
    assert packfile.build_pack([]) == b"" and packfile.read_header(b"") == []
    df = spark.createDataFrame([("p", bytearray(pack)), ("bad", bytearray(b"\xff\xff\xff\xff")), ("none", None)], "p string, c binary")
    rows = packfile.scan_headers(df, "p", "c").collect()
    assert len([r for r in rows if r["pack"] == "p"]) == 3 and [r["error"] is not None for r in rows if r["pack"] == "bad"] == [True]
    texts = spark.createDataFrame([("a" * 999,), ("",), (None,)], "t string")
    back = packfile.decompressed(packfile.compressed(texts, "t", "z"), "z", "b").collect()
    assert [None if r["b"] is None else bytes(r["b"]).decode() for r in back] == ["a" * 999, "", None]
    key = F.lit(b"0123456789abcdef")
    again = texts.select("t", packfile.decrypted(packfile.encrypted(F.col("t").cast("binary"), key), key).cast("string").alias("u"))
    assert all(r["t"] == r["u"] for r in again.collect())


def test_store_round_trip(spark, tmp_path):
    src = tmp_path / "src"
    for p, text in {"0/file0.txt": "zero", "0/00/deep.txt": "deep " * 50, "1/one.txt": "one", "file.txt": "top", "2/empty": ""}.items():
        (src / p).parent.mkdir(parents=True, exist_ok=True)
        (src / p).write_text(text)
    os.symlink("nowhere", src / "broken")
    listed = filescan.scan_files(spark, [str(src), str(src / "0")], exclude=[str(src / "2")])
    paths = {r["path"][len(str(src)) :]: r["node_type"] for r in listed.collect()}
    assert paths == {"": "directory", "/0": "directory", "/0/00": "directory", "/1": "directory", "/0/file0.txt": "file", "/0/00/deep.txt": "file", "/1/one.txt": "file", "/file.txt": "file", "/broken": "symlink"}
    with pytest.raises(FileNotFoundError):
        filescan.scan_files(spark, [str(src / "none")])
    files = filescan.with_contents(spark, listed.where("node_type = 'file'"), [str(src)]).select("path", "node_type", "size", "mode", "modified_time", "content")

    store = Store.init(spark, str(tmp_path / "store"))
    with pytest.raises(FileExistsError):
        Store.init(spark, str(tmp_path / "store"))
    sizes = (16, 32, 64)
    dry = store.snapshot(files, NOW, dry_run=True, chunk_sizes=sizes)
    assert store.snapshots().isEmpty() and store.select("latest") is None
    one = store.snapshot(files, NOW, tags=["first"], chunk_sizes=sizes)
    assert one["added_bytes"] == dry["added_bytes"] > 0 and one["n_files"] == 4
    two = store.snapshot(files.where("path not like '%one.txt'"), NOW + timedelta(days=1), chunk_sizes=sizes)
    assert two["added_bytes"] == 0 and two["parent"] == one["snapshot_id"]
    assert store.select("latest") == two["snapshot_id"] == store.select(two["snapshot_id"][:12])
    with pytest.raises(KeyError):
        store.select("")

    target = tmp_path / "out"
    done = filescan.write_files(store.restore(one["snapshot_id"]), str(target), prefix=str(src)).collect()
    assert {r["action"] for r in done} == {"written"}
    for p in ("0/file0.txt", "0/00/deep.txt", "1/one.txt", "file.txt"):
        assert (target / p).read_bytes() == (src / p).read_bytes()
    assert {r["action"] for r in filescan.write_files(store.restore(one["snapshot_id"]), str(target), str(src), "skip").collect()} == {"skipped"}

    assert [r["snapshot_id"] for r in store.log().collect()] == [one["snapshot_id"], two["snapshot_id"]]
    assert store.log(["first"]).count() == 1
    assert {r["symbol"]: 1 for r in store.diff(one["snapshot_id"], two["snapshot_id"]).collect()} == {"U": 1, "-": 1}
    assert store.ls(one["snapshot_id"], str(src)).count() == 3
    assert all(store.cat(k).count() > 0 for k in ("manifest", "snapshot", "tree", "index", "pack", "blob"))
    assert {(r["n_missing"], r["n_corrupt"]) for r in store.verify().collect()} == {(0, 0)}

    third = store.amend(two["snapshot_id"], NOW, exclude=[str(src / "0")], tags=["short"])
    assert store.log().count() == 2 and store.restore(third).count() == 1
    with pytest.raises(KeyError):
        store.forget(spark.createDataFrame([("ab" * 32,)], "snapshot_id string"))
    last = lambda known: retention.keep_last(known, 1)
    plan = {r["snapshot_id"]: r["keep"] for r in store.forget_by([last], dry_run=True).collect()}
    assert list(plan.values()).count(True) == 1 and store.snapshots().count() == len(plan)
    before = store.unreferenced().count()
    store.forget(spark.createDataFrame([(one["snapshot_id"],)], "snapshot_id string"))
    assert store.unreferenced().count() >= before
    before = store.table("blobs").count()
    assert {r["status"] for r in store.clean(tolerance=0.0, dry_run=True).collect()}
    store.clean(tolerance=0.0)
    assert store.table("blobs").count() <= before
    assert [bytes(r["content"]) for r in store.restore(third).collect()] == [b"top"]
    assert [(r["n_missing"], r["n_corrupt"]) for r in store.verify().collect()] == [(0, 0)]


def test_streamed_ingest_appends_each_chunk_once(spark, tmp_path):
    schema = "i long, t string"
    land = str(tmp_path / "land")
    for k in range(2):
        spark.createDataFrame([(1, "same text " * 9), (2 + k, f"text {k} " * 9)], schema).write.mode("append").parquet(land)
        chunks = ingest.chunk_stream(spark, land, schema, "i", "t", (16, 32, 64))
        ingest.ingest(chunks.select("chunk_id", "len"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    want = {r["chunk_id"] for r in chunking.content_chunks(spark.read.parquet(land), "i", F.col("t"), 16, 32, 64).collect()}
    assert stored.count() == stored.select("chunk_id").distinct().count() == len(want)


def test_dedup(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "chunk_id string, len long")
    known = spark.createDataFrame([("b",), (None,)], "blob_id string")
    assert [r["chunk_id"] for r in dedup.new_blobs(df, known, "chunk_id", "blob_id").collect()] == ["a"]
    assert tuple(dedup.dedup_stats(df.where("chunk_id is not null")).first()) == (3, 2, 4, 3)
