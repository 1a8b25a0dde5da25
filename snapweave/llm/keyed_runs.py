"""Sorted runs of fixed-width records with an index of their own: looking a key up reads a few hundred bytes, however long the run is.

A run is a folder with one sub-folder for each bucket of its keys (the top bits of the 64-bit key); the number of buckets
follows the rows of the run, so that a bucket stays near ``BUCKET_ROWS``. A file in it holds

    payloads | records (key, a, b: 24 bytes each, sorted by key, then a) | every 64th key | number of records, bytes of payloads

A reader takes the tail of a file, finds the blocks of 64 records that can hold the wanted keys, and reads those only. A key
with very many records is read in pieces. Writers are tasks over a range of (kind, key, a), so the records of one hot key
are split among tasks; each puts its file in place by a rename, so a task that runs again replaces its own file.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.operators.compaction import _files
from snapweave.session import pieces

BUCKET_ROWS, BLOCK, PIECE = 32_768, 64, 4096
_RECORD = np.dtype([("key", "<u8"), ("a", "<i8"), ("b", "<i8")])
#: Rows to write: kind (int), key, a, b (long), payload (binary or null).
COLUMNS = ["kind", "key", "a", "b", "payload"]


def bits_for(rows: int) -> int:
    return max(0, (max(1, rows) - 1) // BUCKET_ROWS).bit_length()


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _write_file(fs, path: str, keys: np.ndarray, a: np.ndarray, b: np.ndarray, payload: list) -> None:
    """One file; of records equal in key, a and b one stays."""
    order = np.lexsort((b, a, keys))
    rec = np.empty(len(order), _RECORD)
    rec["key"], rec["a"], rec["b"] = keys[order], a[order], b[order]
    keep = np.ones(len(rec), bool)
    keep[1:] = rec[1:] != rec[:-1]
    rec, order = rec[keep], order[keep]
    folder = path.rsplit("/", 1)[0]
    fs.create_dir(folder, recursive=True)
    temporary = f"{folder}/_tmp-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        at = 0
        if payload:
            for k, i in enumerate(order):
                if (data := payload[i]) is not None:
                    rec["b"][k] = at
                    out.write(struct.pack("<I", len(data)) + data)
                    at += 4 + len(data)
                else:
                    rec["b"][k] = -1
        out.write(rec.tobytes() + rec["key"][::BLOCK].tobytes() + struct.pack("<QQ", len(rec), at))
    fs.move(temporary, path)


def write_runs(rows: DataFrame, targets: dict[int, tuple[str, int]], n_rows: int) -> None:
    """Writes ``rows`` (COLUMNS) as one run per kind; ``targets``: kind -> (folder, bits). Rows of kinds with payloads give -1
    for ``b``, which becomes the place of the payload."""
    from pyspark import TaskContext

    n = pieces(n_rows, 400_000, least=min(rows.sparkSession.sparkContext.defaultParallelism, pieces(n_rows, 20_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now: tuple | None = None
        part = TaskContext.get().partitionId()
        done = 0

        def flush() -> None:
            kind, bucket = now
            folder, _ = targets[kind]
            fs, path = _files(f"{folder}/{bucket:06d}")
            payload = [p for h in held for p in h[3]]
            _write_file(fs, f"{path}/part-{part:06d}.run", *(np.concatenate([h[i] for h in held]) for i in range(3)), payload if any(p is not None for p in payload) else [])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            a, b, payload = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_pylist()
            buckets = np.zeros(len(keys), np.int64)
            for k in np.unique(kinds):
                own = kinds == k
                buckets[own] = bucket_of(keys[own], targets[int(k)][1])
            cuts = [0, *(np.flatnonzero((np.diff(buckets) != 0) | (np.diff(kinds) != 0)) + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                here = (int(kinds[lo]), int(buckets[lo]))
                if now is not None and here != now:
                    flush()
                    held, done = [], done + 1
                now = here
                held.append((keys[lo:hi], a[lo:hi], b[lo:hi], payload[lo:hi]))
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    rows.select(COLUMNS).repartitionByRange(n, "kind", "key", "a").sortWithinPartitions("kind", "key", "a").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


class RunFile:
    """An open file of a run; ``read`` counts the records taken from it."""

    def __init__(self, fs, path: str, size: int):
        self.f, self.read = fs.open_input_file(path), 0
        tail = self.f.read_at(min(size, 1 << 14), max(0, size - (1 << 14)))
        self.n, self.base = struct.unpack("<QQ", tail[-16:])
        fences = 8 * -(-self.n // BLOCK)
        if fences + 16 > len(tail):
            tail = self.f.read_at(fences + 16, size - fences - 16)
        self.fences = np.frombuffer(tail[len(tail) - fences - 16 : len(tail) - 16], "<u8")

    def records(self, block: int, end: int) -> np.ndarray:
        """The records of blocks block .. end - 1."""
        lo, hi = block * BLOCK, min(end * BLOCK, self.n)
        self.read += hi - lo
        return np.frombuffer(self.f.read_at((hi - lo) * 24, self.base + lo * 24), _RECORD)

    def find(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``keys``, records) of what is there of ``keys`` (sorted, distinct); a hot key comes in pieces, in order of a."""
        first = np.maximum(np.searchsorted(self.fences, keys, "left").astype(np.int64) - 1, 0)
        last = np.searchsorted(self.fences, keys, "right").astype(np.int64)
        hot = last - first > PIECE // BLOCK
        few, f, e = np.flatnonzero(~hot & (last > first)), first[~hot & (last > first)], last[~hot & (last > first)]
        if len(few):
            # neighbouring blocks are read together
            starts = np.concatenate([[True], f[1:] > np.maximum.accumulate(e)[:-1]])
            ends = np.append(np.flatnonzero(starts)[1:], len(f)) - 1
            top = np.maximum.accumulate(e)
            rec = np.concatenate([self.records(int(x), int(y)) for x, y in zip(f[starts], top[ends])])
            lo, hi = np.searchsorted(rec["key"], keys[few], "left"), np.searchsorted(rec["key"], keys[few], "right")
            some = hi > lo
            if some.any():
                count = (hi - lo)[some]
                at = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                yield np.repeat(few[some], count), rec[at]
        for i in np.flatnonzero(hot):
            for block in range(int(first[i]), int(last[i]), PIECE // BLOCK):
                rec = self.records(block, min(block + PIECE // BLOCK, int(last[i])))
                rec = rec[rec["key"] == keys[i]]
                if len(rec):
                    yield np.full(len(rec), i), rec

    def payload(self, at: int) -> bytes | None:
        if at < 0:
            return None
        head = self.f.read_at(1024, at)
        n = struct.unpack("<I", head[:4])[0]
        return head[4 : 4 + n] if n <= len(head) - 4 else self.f.read_at(n, at + 4)


class Runs:
    """Lookups in several runs (folder, bits), for a task."""

    def __init__(self, runs: list[tuple[str, int]]):
        self.runs, self.open, self.rows, self.files = runs, {}, 0, 0

    def _bucket(self, k: int, bucket: int) -> list[RunFile]:
        from pyarrow import fs as pafs

        old, held = self.open.get(k, (None, []))
        if old != bucket:
            self._close(held)
            fs, path = _files(f"{self.runs[k][0]}/{bucket:06d}")
            infos = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
            held = [RunFile(fs, i.path, i.size) for i in sorted(infos, key=lambda i: i.path) if os.path.basename(i.path).startswith("part-")]
            self.files += len(held)
            self.open[k] = (bucket, held)
        return held

    def _close(self, held: list[RunFile]) -> None:
        for f in held:
            self.rows += f.read
            f.f.close()

    def find(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, RunFile]]:
        """(places in ``keys``, records, file) in every run; ``keys`` sorted and distinct."""
        for k, (_, bits) in enumerate(self.runs):
            buckets = bucket_of(keys, bits)
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    for f in self._bucket(k, int(buckets[lo])):
                        for places, rec in f.find(keys[lo:hi]):
                            yield places + lo, rec, f

    def close(self) -> None:
        for _, held in self.open.values():
            self._close(held)
        self.open = {}


def read_run(spark, runs: list[tuple[str, int]], kind: int) -> DataFrame:
    """All records of ``runs`` as rows (COLUMNS): what a merge of runs reads. Buckets are read by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        for b in batches:
            for k, bucket in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = _files(f"{runs[k][0]}/{bucket:06d}")
                for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
                    if os.path.basename(i.path).startswith("part-"):
                        f = RunFile(fs, i.path, i.size)
                        for block in range(0, -(-f.n // BLOCK), PIECE // BLOCK):
                            rec = f.records(block, min(block + PIECE // BLOCK, -(-f.n // BLOCK)))
                            data = [f.payload(x) if f.base else None for x in rec["b"].tolist()]
                            cols = [pa.array(np.full(len(rec), kind, np.int32)), pa.array(rec["key"].view(np.int64)), pa.array(rec["a"]), pa.array(np.full(len(rec), -1) if f.base else rec["b"]), pa.array(data, pa.binary())]
                            yield pa.RecordBatch.from_arrays(cols, names=COLUMNS)
                        f.f.close()

    parts: DataFrame | None = None
    for k, (_, bits) in enumerate(runs):
        one = spark.range(1 << bits).select(F.lit(k).alias("run"), F.col("id").alias("bucket"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.mapInArrow(run, "kind int, key long, a long, b long, payload binary")
