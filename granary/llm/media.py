"""Media columns: ISO media files as rows, their tables read without decoding any payload.

``write_media`` stores bytes as 8-bit samples in one track: frames of ``frame`` samples, each a table entry, every
``sync``-th a sync frame. ``read_media`` walks the nested boxes (32- and 64-bit sizes, size 0: to the end), joins the
sample tables (stsz, stsc, stco or co64, stts, stss) and gives codec, duration, and the byte ranges of the
samples and keyframes. Tables are gathered track by track, so those of one track never meet another's: ``read_media`` gives
the first track that can be read, ``read_tracks`` all. Fragmented files (moof, trun) keep their samples in other tables and have none here.

Defined results: null bytes are the empty payload, padded with zero bytes to one unit of 64 (always a
positive multiple). A file that breaks off, nests deeper than ``DEPTH``, lacks a table or has one that claims more entries than
its box holds, or keyframes that are no samples, gives null codec and no ranges, never an exception.
Each row is handled by itself; equal texts give equal values. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

UNIT, FRAME, SYNC, RATE = 64, 64, 16, 8000
#: moov, trak, mdia, minf, stbl and a box in it are six; nothing known needs more than a few others around them.
DEPTH = 16
#: Boxes that hold only boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    return struct.pack(">I4s", n, kind) + b"".join(parts) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8) + b"".join(parts)


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def write_media(payload: bytes, frame: int = FRAME, sync: int = SYNC, rate: int = RATE) -> bytes:
    """payload: a positive multiple of frame bytes."""
    frames = len(payload) // frame
    syncs = np.arange(1, frames + 1, sync, dtype=">u4")
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, rate << 16 & 0xFFFFFFFF))

    def moov(start: int) -> bytes:
        offset = full(b"stco", struct.pack(">II", 1, start)) if start < 1 << 32 else full(b"co64", struct.pack(">IQ", 1, start))
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, frames, frame)),
            full(b"stss", struct.pack(">I", len(syncs)), syncs.tobytes()), full(b"stsc", struct.pack(">IIII", 1, 1, frames, 1)),
            full(b"stsz", struct.pack(">II", frame, frames)), offset,
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        length = min(frames * frame, 0xFFFFFFFF)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, length, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, length), bytes(8), struct.pack(">hhhh", 0, 0, 0x100, 0), MATRIX, bytes(8), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIHH", 0, 0, rate, length, 0x10000, 0x100, 0), bytes(8), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    wide = 8 * (len(payload) + 8 >= 1 << 32)
    start = len(head) + len(moov(0)) + 8 + wide
    if start >= 1 << 32:
        start = len(head) + len(moov(start)) + 8 + wide
    return b"".join((head, moov(start), box(b"mdat", payload)))


@dataclass
class Media:
    codec: str | None = None
    timescale: int = 0
    duration: float = 0.0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def payload(self, data: bytes) -> bytes:
        """The samples in order; neighbours are read as one run."""
        if not len(self.sizes):
            return b""
        ends = self.offsets + self.sizes
        first = np.flatnonzero(np.r_[True, self.offsets[1:] != ends[:-1]])
        return b"".join(data[a:b] for a, b in zip(self.offsets[first].tolist(), ends[np.r_[first[1:] - 1, len(ends) - 1]].tolist(), strict=True))


def walk(data: memoryview, lo: int, hi: int, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, end) of every box's content, depth first. Contents of leaves are not touched."""
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if lo + 16 > hi:
                return
            (size,), head = struct.unpack_from(">Q", data, lo + 8), 16
        end = hi if size == 0 else lo + size
        if size and size < head or end > hi:
            return
        yield (*path, kind), lo + head, end
        if kind in NESTED and len(path) < DEPTH:
            yield from walk(data, lo + head, end, (*path, kind))
        lo = end


def read_media(data: bytes) -> Media:
    """The first track that can be read."""
    return next(iter(read_tracks(data)), Media())


def read_tracks(data: bytes) -> list[Media]:
    """The tracks that can be read, in order."""
    view = memoryview(data)
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in walk(view, 0, len(view)):
        if path[-1] == b"trak":
            tracks.append({})
        elif b"trak" in path:
            tracks[-1].setdefault(path[-1], (a, b))
    out = []
    for found in tracks:
        try:
            out.append(_read(view, found))
        except (KeyError, struct.error, ValueError, IndexError):
            continue
    return out


def _read(data: memoryview, found: dict[bytes, tuple[int, int]]) -> Media:
    def numbers(kind: bytes, skip: int, n: int, each: str = ">u4") -> np.ndarray:
        lo, hi = found[kind]
        if n < 0 or lo + skip + n * np.dtype(each).itemsize > hi:
            raise ValueError("a table ends before its entries")
        return np.frombuffer(data[lo + skip : hi], each, n).astype(np.int64)

    def table_of(kind: bytes, width: int = 1, each: str = ">u4") -> np.ndarray:
        return numbers(kind, 8, width * int(numbers(kind, 4, 1)[0]), each)

    a, b = found[b"mdhd"]
    at = a + (20 if data[a:b] and data[a] == 1 else 12)
    if at + 4 > b:
        raise ValueError("mdhd is short")
    timescale = struct.unpack_from(">I", data, at)[0]
    codec = struct.pack(">I", int(numbers(b"stsd", 12, 1)[0])).decode("latin-1")
    fixed, n = numbers(b"stsz", 4, 2).tolist()
    if fixed and fixed * n > len(data):
        raise ValueError("the file breaks off")
    sizes = np.full(n, fixed, np.int64) if fixed else numbers(b"stsz", 12, n)
    stts = table_of(b"stts", 2).reshape(-1, 2)
    chunks = table_of(b"co64", 1, ">u8") if b"co64" in found else table_of(b"stco")
    runs = table_of(b"stsc", 3).reshape(-1, 3)
    spans = np.diff(np.r_[runs[:, 0], len(chunks) + 1])
    if len(runs) and (runs[0, 0] != 1 or (spans < 0).any()) or int((spans * runs[:, 1]).sum()) != n or stts[:, 0].sum() != n:
        raise ValueError("sample tables disagree")
    per_chunk = np.repeat(runs[:, 1], spans)
    of = np.repeat(np.arange(len(chunks)), per_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    offsets = chunks[of] + before - before[first[of]]
    if n and (int((offsets + sizes).max()) > len(data) or int(offsets.min()) < 0):
        raise ValueError("the file breaks off")
    keys = table_of(b"stss") - 1 if b"stss" in found else np.arange(n)
    if len(keys) and not (0 <= keys.min() and keys.max() < n):
        raise ValueError("a keyframe is no sample")
    return Media(codec, timescale, float((stts[:, 0] * stts[:, 1]).sum() / timescale) if timescale else 0.0, offsets, sizes, keys)


def feature(m: Media) -> str:
    ranges = np.stack([m.offsets[m.keys], m.sizes[m.keys]], 1).astype(">i8").tobytes()
    return f"{m.codec};duration={m.duration:.6f};samples={len(m.sizes)};keyframes={len(m.keys)};ranges={hashlib.md5(ranges).hexdigest()}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", bytes_col: str = "media") -> DataFrame:
    """(id, codec, duration, n_samples, keyframes array<struct<offset, length>>) of a binary column of media files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for i in range(batch.num_rows):
                m = read_media(batch.column(1)[i].as_py() or b"")
                ranges = [{"offset": o, "length": s} for o, s in zip(m.offsets[m.keys].tolist(), m.sizes[m.keys].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(i, 1), "codec": pa.array([m.codec], pa.string()), "duration": pa.array([m.duration if m.codec else None], pa.float64()),
                    "n_samples": pa.array([len(m.sizes)], pa.int64()), "keyframes": pa.array([ranges], kind),
                })

    schema = f"id {dict(docs.dtypes)[id_col]}, codec string, duration double, n_samples long, keyframes array<struct<offset: long, length: long>>"
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{bytes_col}`").cast("binary").alias("b")).mapInArrow(run, schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """Stores each text's bytes as media, reads them back and describes what was read. digest=False keeps the media column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lo in range(0, batch.num_rows, 64):
                rows: dict[str, list] = {c: [] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
                stored = []
                for x in texts.slice(lo, 64):
                    data = x.as_py() or b""
                    media = write_media(padded(data))
                    m = read_media(media)
                    back = m.payload(media)
                    values = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(m))
                    for c, v in zip(rows, values, strict=True):
                        rows[c].append(v)
                    if not digest:
                        stored.append(media)
                out = {"id": batch.column(0).slice(lo, 64), **{c: pa.array(v, pa.string() if c in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for c, v in rows.items()}}
                if not digest:
                    out["media"] = pa.array(stored, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = f"id {dict(docs.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * (not digest)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def op6_media(spark, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
