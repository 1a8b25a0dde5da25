"""Reading and writing Parquet footers (Thrift compact protocol) without touching the encoded pages.

A struct is a dict {field id: (wire type, value)}; lists are (element type, [values]). Only what a footer needs is
here; the footer's field ids used elsewhere are named below.
"""

from __future__ import annotations

import struct

MAGIC = b"PAR1"
# Fixed values of the Parquet format: field ids of FileMetaData, RowGroup, ColumnChunk, ColumnMetaData and Statistics.
SCHEMA, NUM_ROWS, ROW_GROUPS, KEY_VALUES = 2, 3, 4, 5
RG_COLUMNS, RG_ROWS, RG_FILE_OFFSET, RG_ORDINAL = 1, 3, 5, 7
CC_FILE_PATH, CC_FILE_OFFSET, CC_META, CC_INDEX_FIELDS = 1, 2, 3, (4, 5, 6, 7)
CM_PATH, CM_STATISTICS, ST_MAX, ST_MIN, ST_NULLS = 3, 12, 5, 6, 3
CM_VALUES, CM_COMPRESSED, CM_DATA_PAGE, CM_INDEX_PAGE, CM_DICT_PAGE, CM_BLOOM_FIELDS = 5, 7, 9, 10, 11, (14, 15)
# Fixed values of the compact protocol: wire types.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _read(kind: int, buf: bytes, at: int) -> tuple[object, int]:
    if kind in (I16, I32, I64):
        n, at = _varint(buf, at)
        return (n >> 1) ^ -(n & 1), at
    if kind == BINARY:
        n, at = _varint(buf, at)
        return buf[at : at + n], at + n
    if kind == STRUCT:
        return read_struct(buf, at)
    if kind in (LIST, SET):
        head = buf[at]
        at += 1
        n, of = head >> 4, head & 15
        if n == 15:
            n, at = _varint(buf, at)
        items = []
        for _ in range(n):
            x, at = _read(BYTE if of in (TRUE, FALSE) else of, buf, at)
            items.append(x)
        return (of, items), at
    if kind == DOUBLE:
        return buf[at : at + 8], at + 8
    if kind == BYTE:
        return buf[at], at + 1
    raise ValueError(f"wire type {kind} in a footer")


def read_struct(buf: bytes, at: int = 0) -> tuple[dict, int]:
    out: dict[int, tuple[int, object]] = {}
    field = 0
    while (head := buf[at]) != 0:
        at += 1
        kind, delta = head & 15, head >> 4
        if delta:
            field += delta
        else:
            n, at = _varint(buf, at)
            field = (n >> 1) ^ -(n & 1)
        if kind in (TRUE, FALSE):
            out[field] = (kind, kind == TRUE)
        else:
            value, at = _read(kind, buf, at)
            out[field] = (kind, value)
    return out, at + 1


def _put_varint(n: int, out: bytearray) -> None:
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _write(kind: int, value, out: bytearray) -> None:
    if kind in (I16, I32, I64):
        _put_varint((value << 1) ^ (value >> 63), out)
    elif kind == BINARY:
        _put_varint(len(value), out)
        out += value
    elif kind == STRUCT:
        write_struct(value, out)
    elif kind in (LIST, SET):
        of, items = value
        if len(items) < 15:
            out.append(len(items) << 4 | of)
        else:
            out.append(0xF0 | of)
            _put_varint(len(items), out)
        for x in items:
            _write(BYTE if of in (TRUE, FALSE) else of, x, out)
    elif kind == DOUBLE:
        out += value
    else:
        out.append(value)


def write_struct(fields: dict, out: bytearray) -> None:
    last = 0
    for field in sorted(fields):
        kind, value = fields[field]
        if kind in (TRUE, FALSE):
            kind = TRUE if value else FALSE
        if 0 < field - last <= 15:
            out.append(field - last << 4 | kind)
        else:
            out.append(kind)
            _put_varint((field << 1) ^ (field >> 63), out)
        if kind not in (TRUE, FALSE):
            _write(kind, value, out)
        last = field
    out.append(0)


def read_footer(f, size: int) -> dict:
    """The footer of an open Parquet file of ``size`` bytes; reads the tail only."""
    if size < 12:
        raise ValueError("not a Parquet file: too short")
    f.seek(max(0, size - (1 << 16)))
    tail = f.read(min(size, 1 << 16))
    if tail[-4:] != MAGIC:
        raise ValueError("not a plain Parquet file: no magic number at its end")
    n = struct.unpack("<I", tail[-8:-4])[0]
    if n + 8 > size:
        raise ValueError("not a Parquet file: its footer is longer than the file")
    if n + 8 > len(tail):
        f.seek(size - n - 8)
        tail = f.read(n + 8)
    return read_struct(tail[len(tail) - n - 8 : len(tail) - 8])[0]


def footer_bytes(meta: dict) -> bytes:
    out = bytearray()
    write_struct(meta, out)
    return bytes(out) + struct.pack("<I", len(out)) + MAGIC


def chunk_start(cm: dict) -> int:
    starts = [cm[i][1] for i in (CM_DATA_PAGE, CM_INDEX_PAGE, CM_DICT_PAGE) if i in cm and (i == CM_DATA_PAGE or cm[i][1] > 0)]
    return min(starts)


def bounds(group: dict, column: str) -> tuple[int, int] | None:
    """Least and greatest value of a 64-bit integer column in a row group, if its statistics are there and it has no nulls."""
    for chunk in group[RG_COLUMNS][1][1]:
        cm = chunk[CC_META][1]
        if [x.decode() for x in cm[CM_PATH][1][1]] == [column] and CM_STATISTICS in cm:
            st = cm[CM_STATISTICS][1]
            if ST_MIN in st and ST_MAX in st and len(st[ST_MIN][1]) == len(st[ST_MAX][1]) == 8 and st.get(ST_NULLS, (I64, 0))[1] == 0:
                return struct.unpack("<q", st[ST_MIN][1])[0], struct.unpack("<q", st[ST_MAX][1])[0]
    return None


def side_data(f, chunk: dict) -> dict[str, bytes]:
    """The bytes of a column chunk that lie outside it: its column index, offset index and Bloom filter, those there are."""
    cm, out = chunk[CC_META][1], {}
    for name, (at, length), where in (("offsets", (4, 5), chunk), ("columns", (6, 7), chunk), ("bloom", CM_BLOOM_FIELDS, cm)):
        if at in where and length in where:
            f.seek(where[at][1])
            out[name] = f.read(where[length][1])
    return out


def moved_offsets(offsets: bytes, delta: int) -> bytes:
    """An offset index whose pages lie ``delta`` bytes further on."""
    index = read_struct(offsets)[0]
    pages = [dict(p) | {1: (I64, p[1][1] + delta)} for p in index[1][1][1]]
    out = bytearray()
    write_struct(index | {1: (LIST, (STRUCT, pages))}, out)
    return bytes(out)


def put_side_data(out, at: int, groups: list[dict], sides: list[list[dict[str, bytes]]]) -> int:
    """Writes the side data of moved row groups at ``at`` and points their chunks to it; the place after it."""
    for group, side in zip(groups, sides):
        for chunk, data in zip(group[RG_COLUMNS][1][1], side):
            for name, (where, length), to in (("bloom", CM_BLOOM_FIELDS, chunk[CC_META][1]), ("columns", (6, 7), chunk), ("offsets", (4, 5), chunk)):
                if name in data:
                    out.write(data[name])
                    to[where], to[length] = (I64, at), (I32, len(data[name]))
                    at += len(data[name])
    return at


def move_row_group(group: dict, delta_of: list[int], ordinal: int) -> dict:
    """``group`` with its column chunks moved by ``delta_of`` bytes each, as yet without references to page indexes and Bloom filters."""
    columns = []
    for chunk, delta in zip(group[RG_COLUMNS][1][1], delta_of):
        chunk = {k: v for k, v in chunk.items() if k not in CC_INDEX_FIELDS}
        cm = {k: v for k, v in chunk[CC_META][1].items() if k not in CM_BLOOM_FIELDS}
        for i in (CM_DATA_PAGE, CM_INDEX_PAGE, CM_DICT_PAGE):
            if i in cm and (i == CM_DATA_PAGE or cm[i][1] > 0):
                cm[i] = (I64, cm[i][1] + delta)
        chunk[CC_META] = (STRUCT, cm)
        chunk[CC_FILE_OFFSET] = (I64, chunk_start(cm))
        columns.append(chunk)
    out = dict(group)
    out[RG_COLUMNS] = (LIST, (STRUCT, columns))
    if columns:
        out[RG_FILE_OFFSET] = (I64, chunk_start(columns[0][CC_META][1]))
    out[RG_ORDINAL] = (I16, ordinal)
    if ordinal > 32767:
        out.pop(RG_ORDINAL)
    return out
