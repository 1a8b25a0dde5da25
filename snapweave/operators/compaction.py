"""Far too many small files: fewer, well-sized ones with no record lost and none twice.

Two forms of one method, which never decodes what it moves:

* ``compact_parquet`` copies the encoded column chunks of small Parquet files byte for byte into larger files and writes
  new footers, with page indexes and Bloom filters. Files join only files of the same schema; row groups, rows and bytes are
  counted on the way and the written footers are read back and compared before a file is put in place. With ``below`` it
  takes only the row groups whose statistics say that a column lies below a limit; the one group of a file in which
  the limit lies is the only thing decoded, to be cut there.
* ``plan_block_moves`` does the same for packs: the descriptors of encoded blobs get a target pack and offset by a
  distributed prefix sum; ``move_blocks`` cuts the encoded bytes out of the old packs and puts the new ones together;
  ``check_moves`` compares counts, bytes and an order-free hash.

Folders are listed by the tasks, level by level, and files get their bins by a prefix sum over ranges of their paths; the
driver sees counts only. A target file is written by one task under a name of its own and renamed when complete, so a task
that runs again after a lost executor repeats its work without doubling rows. The source files stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapweave.session import written
from snapweave.sources import parquet_footer as pf

_COPY = 8 << 20


def _files(uri: str):
    from pyarrow import fs

    filesystem, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return filesystem, path


def list_parquet(spark: SparkSession, uri: str) -> DataFrame:
    """(path, bytes) of the Parquet files under ``uri``; hidden and temporary files are left out. Each level of folders is listed by tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        filesystem, _ = _files(uri)
        for pdf in batches:
            for folder in pdf["path"]:
                infos = [i for i in filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.base_name[:1] not in ("", ".", "_")]
                rows = [(i.path, i.size if i.type == fs.FileType.File else -1) for i in infos if i.type == fs.FileType.Directory or i.path.endswith(".parquet")]
                yield pd.DataFrame(rows, columns=["path", "bytes"])

    level = spark.createDataFrame([(_files(uri)[1],)], "path string")
    out: DataFrame | None = None
    while True:
        level = written(level.repartition("path").mapInPandas(run, "path string, bytes long"), "files")
        out = level.where("bytes >= 0") if out is None else out.unionByName(level.where("bytes >= 0"))
        level = level.where("bytes < 0").select("path")
        if level.isEmpty():
            return out


def _footer(filesystem, path: str) -> tuple[dict, int]:
    size = filesystem.get_file_info(path).size
    with filesystem.open_input_file(path) as f:
        return pf.read_footer(f, size), size


def _schema_of(meta: dict) -> bytes:
    """Bytes that are equal for files whose row groups may share a footer: the schema and its key-value metadata."""
    out = bytearray()
    pf.write_struct({k: meta[k] for k in (pf.SCHEMA, pf.KEY_VALUES) if k in meta}, out)
    return bytes(out)


def _chosen(meta: dict, below: tuple[str, int] | None) -> tuple[list[dict], list[int]]:
    """The row groups to copy, and the numbers of those to be cut."""
    groups = meta[pf.ROW_GROUPS][1][1]
    if below is None:
        return groups, []
    ranges = [pf.bounds(g, below[0]) for g in groups]
    return [g for g, r in zip(groups, ranges) if r and r[1] < below[1]], [i for i, r in enumerate(ranges) if r is None or r[0] < below[1] <= r[1]]


def _cut_groups(filesystem, path: str, numbers: list[int], below: tuple[str, int], target: str) -> list[tuple[str, int, int, int]]:
    """The rows below the limit of row groups that have others too, as a file of their own."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    with filesystem.open_input_file(path) as f:
        table = pq.ParquetFile(f).read_row_groups(numbers)
    table = table.filter(pc.less(table.column(below[0]), below[1]))
    if not table.num_rows:
        return []
    temporary = target.rsplit("/", 1)[0] + f"/_tmp-{uuid.uuid4().hex}"
    with filesystem.open_output_stream(temporary) as out:
        pq.write_table(table, out, compression="zstd")
    filesystem.move(temporary, target)
    return [(target, 0, 1, table.num_rows)]


def merge_files(filesystem, paths: list[str], target: str, below: tuple[str, int] | None = None) -> list[tuple[str, int, int, int]]:
    """Copies row groups of ``paths`` into files ``target``-k, a new one where the schema changes; (file, files in, row groups, rows) of each."""
    done: list[tuple[str, int, int, int]] = []
    by_schema: dict[bytes, list[tuple[str, dict]]] = {}
    for n, p in enumerate(paths):
        meta, _ = _footer(filesystem, p)
        by_schema.setdefault(_schema_of(meta), []).append((p, meta))
        if cut := _chosen(meta, below)[1]:
            done += _cut_groups(filesystem, p, cut, below, f"{target}-cut{n}.parquet")
    for k, members in enumerate(by_schema.values()):
        final = f"{target}-{k}.parquet"
        temporary = final.rsplit("/", 1)[0] + f"/_tmp-{uuid.uuid4().hex}"
        groups, sides, rows, stated = [], [], 0, 0
        with filesystem.open_output_stream(temporary) as out:
            out.write(pf.MAGIC)
            at = 4
            for p, meta in members:
                with filesystem.open_input_file(p) as f:
                    for group in _chosen(meta, below)[0]:
                        deltas, side = [], []
                        for chunk in group[pf.RG_COLUMNS][1][1]:
                            if pf.CC_FILE_PATH in chunk:
                                raise ValueError(f"{p}: column chunks in another file")
                            cm = chunk[pf.CC_META][1]
                            start, left = pf.chunk_start(cm), cm[pf.CM_COMPRESSED][1]
                            deltas.append(at - start)
                            data = pf.side_data(f, chunk)
                            if "offsets" in data:
                                data["offsets"] = pf.moved_offsets(data["offsets"], at - start)
                            side.append(data)
                            f.seek(start)
                            while left:
                                block = f.read(min(left, _COPY))
                                if not block:
                                    raise ValueError(f"{p}: a column chunk ends beyond the file")
                                out.write(block)
                                left -= len(block)
                                at += len(block)
                        groups.append(pf.move_row_group(group, deltas, len(groups)))
                        sides.append(side)
                        rows += group[pf.RG_ROWS][1]
                stated += meta[pf.NUM_ROWS][1]
            pf.put_side_data(out, at, groups, sides)
            first = dict(members[0][1])
            first[pf.NUM_ROWS] = (pf.I64, rows)
            first[pf.ROW_GROUPS] = (pf.LIST, (pf.STRUCT, groups))
            out.write(pf.footer_bytes(first))
        back, _ = _footer(filesystem, temporary)
        found = sum(g[pf.RG_ROWS][1] for g in back[pf.ROW_GROUPS][1][1])
        if _schema_of(back) != _schema_of(first) or len(back[pf.ROW_GROUPS][1][1]) != len(groups) or not rows == found == back[pf.NUM_ROWS][1] or (below is None and rows != stated):
            raise ValueError(f"{final}: schema, blocks or rows differ from those of its sources")
        if rows or below is None:
            filesystem.move(temporary, final)
        else:
            filesystem.delete_file(temporary)
        done.append((final, len(members), len(groups), rows))
    return done


def _bins(files: DataFrame, target_bytes: int) -> DataFrame:
    """(bin, files): the files of each bin, in order of path. A bin ends with the file that begins before ``target_bytes`` are full."""
    placed = written(files.repartitionByRange("path").withColumn("__p", F.spark_partition_id()), "placed")
    sums = placed.groupBy("__p").agg(F.sum("bytes").alias("t"))
    base = sums.select("__p", (F.sum("t").over(Window.partitionBy(F.lit(0)).orderBy("__p")) - F.col("t")).alias("base"))  # one row per range of paths
    inside = F.sum("bytes").over(Window.partitionBy("__p").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    at = placed.withColumn("inside", inside).join(base, "__p").select(F.floor((F.col("base") + F.col("inside")) / F.lit(target_bytes)).alias("bin"), "path")
    return at.groupBy("bin").agg(F.array_sort(F.collect_list("path")).alias("files"))


def compact_parquet(spark: SparkSession, source: str, target: str, target_bytes: int = 256 << 20, below: tuple[str, int] | None = None) -> tuple[DataFrame, int]:
    """Merges the Parquet files under ``source`` into files of about ``target_bytes`` under ``target``; the report
    (file, files_in, row_groups, rows) and the number of rows. ``below``: (column of 64-bit integers, limit): only rows with less.
    No files: an empty report."""
    filesystem, out = _files(target)
    filesystem.create_dir(out, recursive=True)
    listed = written(list_parquet(spark, source), "listed")
    bins = written(_bins(listed, target_bytes), "bins")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs_here, out_here = _files(target)
        for pdf in batches:
            made = []
            for n, files in zip(pdf["bin"], pdf["files"]):
                made += merge_files(fs_here, list(files), f"{out_here}/part-{n:08d}", below)
            yield pd.DataFrame(made, columns=["file", "files_in", "row_groups", "rows"])

    schema = "file string, files_in int, row_groups int, rows long"
    report = written(bins.repartition(min(max(bins.count(), 1), 10_000), "bin").mapInPandas(run, schema), "report")
    merged, rows = report.agg(F.coalesce(F.sum("files_in"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if merged != listed.count():
        raise ValueError("not every source file was merged")
    return report, rows


def plan_block_moves(blocks: DataFrame, file_col: str, block_col: str, length_col: str, target_bytes: int) -> DataFrame:
    """Where each encoded block goes: the columns named plus target_no (long) and target_offset (long).

    Blocks are laid end to end in the order (three hex digits of the SHA-256 of the file, one of that of the block, file,
    block) and cut every ``target_bytes``; a block belongs to the target in which it begins, so a target exceeds the size by
    less than one block. The blocks of a file lie in at most sixteen places near each other, so that a file with a large
    part of all blocks is spread over sixteen ranges. The prefix sum has two levels: bytes per range first (at most 65,536
    rows, which are broadcast), then within a range, so no task sees all blocks.
    Null lengths count as 0 bytes. Equal blocks stay separate rows.
    """
    digits = lambda c, n: F.substring(F.sha2(F.col(c).cast("binary"), 256), 1, n)
    df = blocks.select(file_col, block_col, F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias(length_col), F.concat(F.coalesce(digits(file_col, 3), F.lit("000")), F.coalesce(digits(block_col, 1), F.lit("0"))).alias("__r"))
    starts = df.groupBy("__r").agg(F.sum(length_col).alias("__b"))
    starts = starts.select("__r", (F.sum("__b").over(Window.partitionBy(F.lit(0)).orderBy("__r")) - F.col("__b")).alias("__base"))
    inside = F.sum(length_col).over(Window.partitionBy("__r").orderBy(file_col, block_col).rowsBetween(Window.unboundedPreceding, 0)) - F.col(length_col)
    placed = df.withColumn("__in", inside).join(F.broadcast(starts), "__r").withColumn("__at", F.col("__in") + F.col("__base"))
    placed = written(placed.withColumn("target_no", F.floor(F.col("__at") / F.lit(target_bytes)).cast("long")).drop("__r", "__in", "__base"), "moves")
    first = placed.groupBy("target_no").agg(F.min("__at").alias("__first"))
    return placed.join(first, "target_no").withColumn("target_offset", F.col("__at") - F.col("__first")).select(file_col, block_col, length_col, "target_no", "target_offset")


def move_blocks(moves: DataFrame, places: DataFrame, contents: DataFrame, file_col: str, block_col: str, length_col: str) -> DataFrame:
    """(target_no, data): the new packs. ``places``: file, block, offset in the file; ``contents``: file, data. A block is cut out of
    its old file as it is, encoded. A new pack is put together in one task, as large as a pack may be."""
    cut = moves.join(places, [file_col, block_col]).join(contents, file_col)
    cut = cut.select("target_no", "target_offset", block_col, F.substring(F.col("data"), F.col("offset").cast("int") + 1, F.col(length_col).cast("int")).alias("piece"))
    whole = cut.groupBy("target_no").agg(F.array_sort(F.collect_list(F.struct("target_offset", block_col, "piece"))).alias("p"))
    return whole.select("target_no", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["piece"])), "")).alias("data"))


def blocks_with_file_bytes(blocks: DataFrame, file_col: str, block_col: str, length_col: str) -> DataFrame:
    """(file, block, length, file_bytes): each distinct block of a file at its greatest length, with the bytes of the file's blocks.
    Sums use a partial aggregate, and the join back carries a hash of the file beside the file itself, so that adaptive
    execution can split a file with very many blocks."""
    one = blocks.where(F.col(file_col).isNotNull() & F.col(block_col).isNotNull()).groupBy(file_col, block_col).agg(F.max(F.coalesce(F.col(length_col), F.lit(0))).cast("long").alias(length_col))
    sums = one.groupBy(F.col(file_col).alias("__f")).agg(F.sum(length_col).alias("file_bytes")).select("__f", "file_bytes", F.xxhash64("__f").alias("__h"))
    left = one.withColumn("__lh", F.xxhash64(file_col))
    return left.join(sums, (left["__lh"] == sums["__h"]) & (left[file_col] == sums["__f"])).select(file_col, block_col, length_col, "file_bytes")


def check_moves(blocks: DataFrame, moves: DataFrame, file_col: str, block_col: str, length_col: str) -> bool:
    """Whether ``moves`` has the blocks of ``blocks``, each as often: counts, bytes and the sum of a hash of each row are compared."""
    length = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    facts = lambda df: df.agg(F.count(F.lit(1)), F.sum(length), F.sum(F.xxhash64(file_col, block_col, length).cast("decimal(38,0)"))).first()
    return tuple(facts(blocks)) == tuple(facts(moves))
