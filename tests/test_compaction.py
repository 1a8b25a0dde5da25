import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from snapweave.operators import compaction as C
from snapweave.sources import parquet_footer as pf


def files_in(spark, folder):
    return sorted(r["path"] for r in C.list_parquet(spark, str(folder)).collect())


def rows_of(spark, folder):
    return sorted((r for p in files_in(spark, folder) for r in pq.read_table(p).to_pylist()), key=str)


def test_small_files_become_few_without_decoding(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "if(id % 7 = 0, null, concat('t', id)) as t", "array(id, null) as a", "named_struct('x', id, 'y', cast(null as string)) as s")
    df.repartition(25).write.parquet(str(tmp_path / "in"))
    df.limit(0).write.mode("append").parquet(str(tmp_path / "in"))
    report, n = C.compact_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"), target_bytes=60_000)
    assert n == 5000 and rows_of(spark, tmp_path / "in") == rows_of(spark, tmp_path / "out")
    files = files_in(spark, tmp_path / "out")
    assert len(files) < 10 and sum(r["files_in"] for r in report.collect()) == len(files_in(spark, tmp_path / "in"))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=str) == sorted(df.collect(), key=str)
    encoded = pq.ParquetFile(files[0]).metadata.row_group(0).column(0)
    assert encoded.compression == "SNAPPY"
    # the folders below are listed too, hidden files are not
    (tmp_path / "out" / "sub" / "deep").mkdir(parents=True)
    pq.write_table(pa.table({"a": [1]}), tmp_path / "out" / "sub" / "deep" / "x.parquet")
    pq.write_table(pa.table({"a": [1]}), tmp_path / "out" / "sub" / "_x.parquet")
    assert len(files_in(spark, tmp_path / "out")) == len(files) + 1


def test_only_blocks_below_a_limit(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id % 1000 as size", "id", "cast(sha2(cast(id as string), 256) as binary) as b").repartition(3).sortWithinPartitions("size")
    df.write.option("parquet.block.size", 20_000).parquet(str(tmp_path / "in"))
    report, n = C.compact_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"), below=("size", 333))
    want = sorted((r["id"], bytes(r["b"])) for r in df.where("size < 333").collect())
    got = spark.read.parquet(str(tmp_path / "out"))
    assert n == len(want) and sorted((r["id"], bytes(r["b"])) for r in got.collect()) == want
    # nearly all of it was copied encoded: one group a file was cut
    copied = report.where("files_in > 0").agg({"rows": "sum", "row_groups": "sum"}).first()
    assert copied["sum(rows)"] > 0.6 * n and copied["sum(row_groups)"] > 3
    none, n = C.compact_parquet(spark, str(tmp_path / "in"), str(tmp_path / "empty"), below=("size", 0))
    assert n == 0 and spark.read.schema(df.schema).parquet(str(tmp_path / "empty")).isEmpty()


def test_page_indexes_and_bloom_filters_are_kept(spark, tmp_path):
    df = spark.range(9000).selectExpr("id", "concat('v', id % 700) as v").coalesce(1).sortWithinPartitions("id")
    for k in range(2):
        df.write.mode("append").option("parquet.bloom.filter.enabled#v", "true").option("parquet.page.row.count.limit", 500).parquet(str(tmp_path / "in"))
    C.compact_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    path = files_in(spark, tmp_path / "out")[0]
    meta = pq.ParquetFile(path).metadata
    assert meta.num_row_groups == 2
    with open(path, "rb") as f:
        data = f.read()
        f.seek(0)
        footer = pf.read_footer(f, len(data))
        for group in footer[pf.ROW_GROUPS][1][1]:
            for chunk in group[pf.RG_COLUMNS][1][1]:
                side = pf.side_data(f, chunk)
                assert {"offsets", "columns"} <= set(side)
                pages = pf.read_struct(side["offsets"])[0][1][1][1]
                cm = chunk[pf.CC_META][1]
                assert len(pages) == 18 and pages[0][1][1] == cm[pf.CM_DATA_PAGE][1]
            assert "bloom" in side
    out = spark.read.parquet(str(tmp_path / "out"))
    # readers use the page index: few rows are taken from the file, and the right ones
    assert sorted(r["id"] for r in out.where("id between 4010 and 4012").collect()) == [4010, 4010, 4011, 4011, 4012, 4012]
    assert out.where("v = 'v13'").count() == 2 * 13 and out.where("v = 'none'").count() == 0


@pytest.mark.parametrize("options", [{"compression": "zstd", "use_dictionary": False, "write_page_index": True}, {"compression": "gzip", "row_group_size": 10, "data_page_version": "2.0"}])
def test_other_writers_and_many_row_groups(tmp_path, options):
    t = pa.table({"k": list(range(100)), "v": [None if i % 3 else "é" * (i % 50) for i in range(100)]})
    (tmp_path / "in").mkdir()
    for i in range(3):
        pq.write_table(t, tmp_path / "in" / f"{i}.parquet", **options)
    fs, _ = C._files(str(tmp_path))
    done = C.merge_files(fs, [str(tmp_path / "in" / f"{i}.parquet") for i in range(3)], str(tmp_path / "whole"))
    assert [d[3] for d in done] == [300]
    assert pq.read_table(done[0][0]).to_pylist() == t.to_pylist() * 3


def test_schemas_do_not_mix_and_broken_files_fail(spark, tmp_path):
    pq.write_table(pa.table({"a": [1]}), tmp_path / "1.parquet")
    pq.write_table(pa.table({"a": ["x"]}), tmp_path / "2.parquet")
    fs, _ = C._files(str(tmp_path))
    assert len(C.merge_files(fs, [str(tmp_path / "1.parquet"), str(tmp_path / "2.parquet")], str(tmp_path / "m"))) == 2
    (tmp_path / "bad.parquet").write_bytes(b"no parquet at all, just text")
    with pytest.raises(ValueError):
        C.merge_files(fs, [str(tmp_path / "bad.parquet")], str(tmp_path / "n"))
    (tmp_path / "none").mkdir()
    report, n = C.compact_parquet(spark, str(tmp_path / "none"), str(tmp_path / "none-out"))
    assert n == 0 and report.isEmpty()


def test_footer_round_trip(tmp_path):
    pq.write_table(pa.table({"a": list(range(40)), "b": [True, False] * 20}), tmp_path / "f.parquet")
    data = (tmp_path / "f.parquet").read_bytes()
    with open(tmp_path / "f.parquet", "rb") as f:
        meta = pf.read_footer(f, len(data))
    assert data.endswith(pf.footer_bytes(meta))


def test_block_moves_lose_nothing(spark):
    rows = [(f"p{i % 5}", f"b{i}", None if i % 11 == 0 else i % 40, "x") for i in range(300)] + [("p1", "b1", 1, "x")]
    df = spark.createDataFrame(rows, "f string, b string, n long, target_no string")
    moves = C.plan_block_moves(df, "f", "b", "n", 500)
    assert C.check_moves(df, moves, "f", "b", "n")
    assert not C.check_moves(df, moves.withColumn("b", moves["f"]), "f", "b", "n")
    by = {}
    for r in moves.collect():
        by.setdefault(r["target_no"], []).append((r["target_offset"], r["n"]))
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end = at + n
        assert end < 500 + 40


def test_blocks_are_moved_as_they_are(spark):
    packs = [(f"p{k}", bytes([k]) * 3 + bytes([100 + k]) * 4) for k in range(5)]
    places = [(f"p{k}", f"b{k}{x}", n, at) for k in range(5) for x, n, at in ((0, 3, 0), (1, 4, 3))]
    blocks = spark.createDataFrame(places, "f string, b string, n long, offset long")
    moves = C.plan_block_moves(blocks, "f", "b", "n", 12)
    made = {r["target_no"]: bytes(r["data"]) for r in C.move_blocks(moves, blocks.select("f", "b", "offset"), spark.createDataFrame(packs, "f string, data binary"), "f", "b", "n").collect()}
    whole = dict(packs)
    for r in moves.collect():
        k, x = int(r["b"][1]), int(r["b"][2])
        piece = whole[f"p{k}"][3 * x : 3 * x + r["n"]]
        assert made[r["target_no"]][r["target_offset"] : r["target_offset"] + r["n"]] == piece
    assert sum(map(len, made.values())) == 35


def test_bytes_of_files(spark):
    rows = [("p", "a", 3), ("p", "a", 5), ("p", "b", None), ("q", "a", 60), (None, "a", 1), ("r", None, 1)]
    df = spark.createDataFrame(rows, "f string, b string, n long")
    assert sorted(tuple(r) for r in C.blocks_with_file_bytes(df, "f", "b", "n").collect()) == [("p", "a", 5, 5), ("p", "b", 0, 5), ("q", "a", 60, 60)]
