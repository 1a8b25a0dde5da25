"""Cutting contents into chunks: at a delimiter, or by content (normalised gear hashing, after the published FastCDC papers).

Contract of both: the chunks of a content, in order of seq, put together give the content; an empty content is one empty
chunk; null content gives no chunks. Content-defined chunks lie between the least and the greatest size, except a last
one or a content below the least size, which is one chunk. Cutting depends on nothing but the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunk sizes in bytes, and the level of normalisation.
MIN_CHUNK, AVG_CHUNK, MAX_CHUNK, LEVEL = 512 << 10, 1 << 20, 8 << 20, 1


def gear_table() -> list[int]:
    """256 64-bit numbers from a rule: the first eight bytes of the SHA-256 of each byte."""
    return [int.from_bytes(hashlib.sha256(b"gear" + bytes([i])).digest()[:8], "big") for i in range(256)]


GEAR = gear_table()
_GEAR = np.array(GEAR, np.uint64)


def _rolling(numbers: np.ndarray) -> np.ndarray:
    """The hash after each byte of a run: shifted out after 64 bytes, so six doublings of the window give it for all bytes at once."""
    h = numbers.copy()
    for k in range(6):
        w = 1 << k
        if len(h) > w:
            h[w:] += h[:-w] << np.uint64(w)
    return h


def _mask(bits: int) -> int:
    """``bits`` ones spread over the upper 48 bits, which depend on many bytes."""
    return sum(1 << (63 - i * 48 // max(bits, 1)) for i in range(bits))


def cut_points(data: bytes, least: int = MIN_CHUNK, average: int = AVG_CHUNK, most: int = MAX_CHUNK, level: int = LEVEL) -> list[int]:
    """Ends of the chunks: a stricter mask before the average size, a looser one after it."""
    if not 0 < least <= average <= most:
        raise ValueError("0 < least <= average <= most")
    bits = average.bit_length() - 1
    strict, loose = np.uint64(_mask(bits + level)), np.uint64(_mask(max(1, bits - level)))
    ends, start, n = [], 0, len(data)
    numbers = _GEAR[np.frombuffer(data, np.uint8)] if n > least else _GEAR[:0]
    step = max(4096, average)
    while n - start > least:
        stop, middle, first = min(n, start + most), min(n, start + average), start + least
        end = stop
        for lo in range(first, stop, step):
            hi = min(lo + step, stop)
            h = _rolling(numbers[max(first, lo - 63) : hi])[lo - max(first, lo - 63) :]
            split = min(max(middle - lo, 0), len(h))
            hits = np.concatenate([np.flatnonzero(h[:split] & strict == 0), split + np.flatnonzero(h[split:] & loose == 0)])
            if len(hits):
                end = lo + int(hits[0]) + 1
                break
        ends.append(end)
        start = end
    if start < n or not ends:
        ends.append(n)
    return ends


def content_chunks(df: DataFrame, id_col: str, content: Column, least: int = MIN_CHUNK, average: int = AVG_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """(id, seq, offset, len, chunk_id) of each content (text or binary), chunk_id in hex."""
    own = df.select(F.col(f"`{id_col}`").alias("id"), content.cast("binary").alias("content")).where("content is not null")
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, data in enumerate(b.column(1).to_pylist()):
                start = 0
                for seq, end in enumerate(cut_points(data, least, average, most)):
                    ids.append(i)
                    rows.append((seq, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                    start = end
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["id", "seq", "offset", "len", "chunk_id"])

    return own.mapInArrow(run, f"id {kind}, seq int, offset long, len long, chunk_id string").withColumnRenamed("id", id_col)


def delimiter_chunks(df: DataFrame, id_col: str, text_col: str, delimiter: str = "\n") -> DataFrame:
    """(id, seq, chunk, chunk_id, len): the pieces between delimiters, each but the last with its delimiter."""
    import re

    cut = F.split(F.col(f"`{text_col}`"), re.escape(delimiter))
    out = df.select(F.col(f"`{id_col}`"), F.size(cut).alias("__n"), F.posexplode(cut).alias("seq", "__c"))
    chunk = F.when(F.col("seq") < F.col("__n") - 1, F.concat("__c", F.lit(delimiter))).otherwise(F.col("__c"))
    return out.select(F.col(f"`{id_col}`"), "seq", chunk.alias("chunk")).select("*", F.sha2("chunk", 256).alias("chunk_id"), F.octet_length("chunk").cast("long").alias("len"))


def reassemble(chunks: DataFrame, id_col: str) -> DataFrame:
    """(id, content): chunks put together in order of seq."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    return chunks.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda x: x["chunk"]), "").alias("content"))
