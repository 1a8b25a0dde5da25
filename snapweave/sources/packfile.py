"""Pack files: encoded blobs, then an encoded header of descriptors, then the header's length.

A descriptor is 37 bytes: id (32), length (4, little-endian), type (1). Headers are padded with random descriptors of the
padding type to a multiple of 64. Encoding is zstd, by executors in Arrow batches; encryption, where wanted, is a column
expression (AES-GCM) on the encoded bytes.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the pack format.
TYPES = {"data": 0x00, "tree": 0x01, "padding": 0xFF}
ENTRY, MULTIPLE = 37, 64


def type_name(code: int) -> str:
    """Unknown codes count as padding."""
    return {0x00: "data", 0x01: "tree"}.get(code, "padding")


def build_pack(blobs: list[tuple[bytes, str, bytes]]) -> bytes:
    """The bytes of a pack of (id, type, encoded bytes); empty for no blobs."""
    import zstandard

    if not blobs:
        return b""
    header = b"".join(i + struct.pack("<I", len(data)) + bytes([TYPES[kind]]) for i, kind, data in blobs)
    for _ in range(-len(blobs) % MULTIPLE):
        header += os.urandom(36) + bytes([TYPES["padding"]])
    encoded = zstandard.ZstdCompressor().compress(header)
    return b"".join(data for _, _, data in blobs) + encoded + struct.pack("<I", len(encoded))


def build_packs(blobs: DataFrame, pack_col: str, order_col: str, id_col: str, type_col: str, content_col: str) -> DataFrame:
    """(pack, content): the bytes of each pack of blobs (id in hex, type, encoded bytes), in order. A pack is put together in one task, as large as a pack may be."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(id_col).alias("i"), F.col(type_col).alias("t"), F.col(content_col).cast("binary").alias("c"))))
    own = blobs.groupBy(F.col(pack_col).cast("string").alias("pack")).agg(parts.alias("p")).select("pack", "p.i", "p.t", "p.c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packs = [build_pack([(bytes.fromhex(i), t, c) for i, t, c in zip(*x)]) for x in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packs, pa.binary())], names=["pack", "content"])

    return own.mapInArrow(run, "pack string, content binary")


def read_header(pack: bytes) -> list[tuple[bytes, str, int, int]]:
    """(id, type, offset, length) of the blobs of a pack, without padding."""
    import zstandard

    if not pack:
        return []
    n = struct.unpack("<I", pack[-4:])[0]
    if n + 4 > len(pack):
        raise ValueError("the header is longer than the pack")
    header = zstandard.ZstdDecompressor().decompress(pack[-4 - n : -4])
    if len(header) % ENTRY:
        raise ValueError("a header that is not made of whole descriptors")
    out, offset = [], 0
    for at in range(0, len(header), ENTRY):
        kind = type_name(header[at + 36])
        if kind != "padding":
            length = struct.unpack("<I", header[at + 32 : at + 36])[0]
            out.append((header[at : at + 32], kind, offset, length))
            offset += length
    return out


def scan_headers(packs: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(pack, blob_id, blob_type, offset, length, error) of pack files; a pack that cannot be read gives one row with its error."""
    own = packs.where(F.col(content_col).isNotNull()).select(F.col(id_col).cast("string").alias("pack"), F.col(content_col).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pack", "blob_id", "blob_type", "offset", "length", "error"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            rows = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(p, i.hex(), kind, o, n, None) for i, kind, o, n in read_header(data)]
                except Exception as e:
                    rows.append((p, None, None, None, None, str(e)[:200]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=names)

    return own.mapInArrow(run, "pack string, blob_id string, blob_type string, offset long, length long, error string")


def compressed(df: DataFrame, content_col: str, out_col: str, level: int = 3) -> DataFrame:
    """Adds the zstd bytes of a text or binary column; null stays null."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(content_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=level)
        for b in batches:
            made = [None if x is None else c.compress(x.encode() if isinstance(x, str) else x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, f"{kinds}, `{out_col}` binary")


def decompressed(df: DataFrame, content_col: str, out_col: str) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(content_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            made = [None if x is None else d.decompressobj().decompress(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, f"{kinds}, `{out_col}` binary")


def encrypted(c: Column, key: Column) -> Column:
    """AES-GCM with a random nonce in front; ``key`` has 16, 24 or 32 bytes."""
    return F.aes_encrypt(c, key, F.lit("GCM"))


def decrypted(c: Column, key: Column) -> Column:
    return F.aes_decrypt(c, key, F.lit("GCM"))


def pack_id(pack: bytes) -> str:
    return hashlib.sha256(pack).hexdigest()
