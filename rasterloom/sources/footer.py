"""Just enough of Parquet's footer format to move encoded column chunks between files without decoding them.

A footer is a Thrift compact struct. It is read into generic values (field id -> (type, value)), changed where offsets,
row counts or the row group list differ, and written again; everything else stays byte for byte as the writer chose it.
"""

from __future__ import annotations

import io
import struct

MAGIC = b"PAR1"
#: Thrift compact type codes, fixed by the format.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT, UUID = range(1, 14)
# Field ids of parquet.thrift, fixed by the format.
FILE_VERSION, FILE_SCHEMA, FILE_ROWS, FILE_GROUPS, FILE_KV, FILE_CREATED, FILE_ORDERS = range(1, 8)
GROUP_COLUMNS, GROUP_BYTES, GROUP_ROWS, GROUP_SORTING, GROUP_OFFSET, GROUP_COMPRESSED, GROUP_ORDINAL = range(1, 8)
CHUNK_PATH, CHUNK_OFFSET, CHUNK_META, CHUNK_OI_AT, CHUNK_OI_LEN, CHUNK_CI_AT, CHUNK_CI_LEN = range(1, 8)
META_COMPRESSED, META_DATA_AT, META_INDEX_AT, META_DICT_AT, META_BLOOM_AT, META_BLOOM_LEN = 7, 9, 10, 11, 14, 15


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (TRUE, FALSE):
            return kind == TRUE
        if kind == BYTE:
            return self.byte()
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind in (DOUBLE, UUID, BINARY):
            n = 8 if kind == DOUBLE else 16 if kind == UUID else self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (LIST, SET):
            head = self.byte()
            n, of = (self.varint() if head >> 4 == 15 else head >> 4), head & 15
            # In a list a boolean is a byte of its own.
            return of, [self.byte() if of in (TRUE, FALSE) else self.value(of) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            kinds = self.byte() if n else 0
            return kinds, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(n)]
        if kind == STRUCT:
            out, last = {}, 0
            while head := self.byte():
                last = last + (head >> 4) if head >> 4 else self.zigzag()
                out[last] = (head & 15, self.value(head & 15))
            return out
        raise ValueError(f"unknown type {kind} in a footer")


class Writer:
    def __init__(self) -> None:
        self.out = io.BytesIO()

    def varint(self, n: int) -> None:
        while n > 0x7F:
            self.out.write(bytes([n & 0x7F | 0x80]))
            n >>= 7
        self.out.write(bytes([n]))

    def zigzag(self, n: int) -> None:
        self.varint(n << 1 if n >= 0 else (-n << 1) - 1)

    def value(self, kind: int, v) -> None:
        if kind in (TRUE, FALSE):
            return
        if kind == BYTE:
            self.out.write(bytes([v]))
        elif kind in (I16, I32, I64):
            self.zigzag(v)
        elif kind in (DOUBLE, UUID):
            self.out.write(v)
        elif kind == BINARY:
            self.varint(len(v))
            self.out.write(v)
        elif kind in (LIST, SET):
            of, items = v
            self.out.write(bytes([min(len(items), 15) << 4 | of]))
            if len(items) >= 15:
                self.varint(len(items))
            for x in items:
                if of in (TRUE, FALSE):
                    self.out.write(bytes([x]))
                else:
                    self.value(of, x)
        elif kind == MAP:
            kinds, items = v
            self.varint(len(items))
            if items:
                self.out.write(bytes([kinds]))
                for a, b in items:
                    self.value(kinds >> 4, a)
                    self.value(kinds & 15, b)
        elif kind == STRUCT:
            last = 0
            for fid in sorted(v):
                k, x = v[fid]
                if k in (TRUE, FALSE):
                    k = TRUE if x else FALSE
                if 0 < fid - last < 16:
                    self.out.write(bytes([fid - last << 4 | k]))
                else:
                    self.out.write(bytes([k]))
                    self.zigzag(fid)
                self.value(k, x)
                last = fid
            self.out.write(b"\0")


def encode(footer: dict) -> bytes:
    w = Writer()
    w.value(STRUCT, footer)
    return w.out.getvalue()


def decode(data: bytes) -> dict:
    return Reader(data).value(STRUCT)


def read_footer(f, size: int) -> dict:
    """The footer of an open file; ValueError for what is no whole, plain Parquet file."""
    if size < 12:
        raise ValueError("too short for a Parquet file")
    f.seek(size - 8)
    n, magic = struct.unpack("<I4s", f.read(8))
    if magic != MAGIC or n > size - 12:
        raise ValueError("no Parquet footer")
    f.seek(size - 8 - n)
    return decode(f.read(n))


def schema_key(footer: dict) -> bytes:
    """Files whose keys are equal have the same schema and writer metadata, so their row groups can share a file."""
    kept = {k: footer[k] for k in (FILE_SCHEMA, FILE_KV, FILE_ORDERS) if k in footer}
    return encode(kept)


def chunk_span(meta: dict) -> tuple[int, int]:
    """First byte and length of a column chunk: the dictionary page, where there is one, comes first."""
    starts = [meta[k][1] for k in (META_DATA_AT, META_DICT_AT, META_INDEX_AT) if k in meta and meta[k][1] > 0]
    return min(starts), meta[META_COMPRESSED][1]


def moved_group(group: dict, at: int, ordinal: int) -> tuple[dict, list[tuple[int, int]]]:
    """The row group as it reads once its chunks stand one after another from ``at``; the spans to copy.

    Page and bloom indexes stand outside the chunks and are optional, so their references are left out.
    """
    out = dict(group)
    spans, chunks, first = [], [], at
    for chunk in group[GROUP_COLUMNS][1][1]:
        if CHUNK_PATH in chunk:
            raise ValueError("a column chunk in another file")
        start, n = chunk_span(chunk[CHUNK_META][1])
        spans.append((start, n))
        meta = {k: v for k, v in chunk[CHUNK_META][1].items() if k not in (META_BLOOM_AT, META_BLOOM_LEN)}
        for k in (META_DATA_AT, META_INDEX_AT, META_DICT_AT):
            if k in meta and meta[k][1] > 0:
                meta[k] = (I64, meta[k][1] - start + at)
        new = {k: v for k, v in chunk.items() if k not in (CHUNK_OI_AT, CHUNK_OI_LEN, CHUNK_CI_AT, CHUNK_CI_LEN)}
        new[CHUNK_META] = (STRUCT, meta)
        new[CHUNK_OFFSET] = (I64, at if chunk[CHUNK_OFFSET][1] else 0)
        chunks.append(new)
        at += n
    out[GROUP_COLUMNS] = (LIST, (STRUCT, chunks))
    if GROUP_OFFSET in out:
        out[GROUP_OFFSET] = (I64, first)
    if GROUP_ORDINAL in out or ordinal < 32768:
        out[GROUP_ORDINAL] = (I16, ordinal)
    return out, spans
