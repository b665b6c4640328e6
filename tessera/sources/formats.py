"""Byte formats: trace files, pack indexes and tar layers, read from a binary column and written to one.

Trace and pack layouts are fixed values that must match.
"""

from __future__ import annotations

import io
import struct
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Header of a trace (magic, version, block size, device blocks, start, name) and a record (block, op, span, elapsed).
TRACE_MAGIC, TRACE_VERSION = b"GLIDETRC", 1
TRACE_HEAD = struct.Struct("<8sIIQQ32s")
TRACE_RECORD = np.dtype([("block_index", "<u4"), ("op", "<u2"), ("span", "<u2"), ("elapsed_us", "<u8")])
#: An entry of a pack index (hash, chunk offset, offset, length) and the trailer (entries, reserved, magic).
PACK_ENTRY = np.dtype([("hash", "V16"), ("chunk_offset", "<u4"), ("offset", "<u4"), ("comp_length", "<u4")])
PACK_MAGIC, PACK_HEADER, TRAILER_MAGIC, TRAILER = b"GLPK", 16, b"GLIX", 8
TRACES = "volume string, block_size long, device_blocks long, start_us long, io_id long, block_index long, op int, span int, elapsed_us long"
ENTRIES = "pack string, chunk_offset long, hash string, offset long, comp_length long, problem string"
FILES = "layer string, ord long, name string, kind string, size long, mode long, link string, md5 string"


def trace_file(volume: str, block_size: int, device_blocks: int, start_us: int, records: np.ndarray) -> bytes:
    return TRACE_HEAD.pack(TRACE_MAGIC, TRACE_VERSION, block_size, device_blocks, start_us, volume.encode()[:32]) + records.astype(TRACE_RECORD).tobytes()


def parse_trace(data: bytes) -> tuple[tuple, np.ndarray] | None:
    """Header fields and records of a trace; a short, foreign or wrongly named one is none, a part of a last record is left out."""
    if len(data) < TRACE_HEAD.size:
        return None
    magic, version, block_size, device_blocks, start_us, name = TRACE_HEAD.unpack_from(data)
    try:
        volume = name.partition(b"\0")[0].decode()
    except UnicodeDecodeError:
        return None
    if magic != TRACE_MAGIC or version != TRACE_VERSION:
        return None
    n = (len(data) - TRACE_HEAD.size) // TRACE_RECORD.itemsize
    return (volume, block_size, device_blocks, start_us), np.frombuffer(data, TRACE_RECORD, n, TRACE_HEAD.size)


def read_traces(files: DataFrame) -> DataFrame:
    """The records of trace files (content)."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f["content"]:
                got = parse_trace(bytes(data or b""))
                if got:
                    (volume, block_size, device_blocks, start_us), r = got
                    yield pd.DataFrame({"volume": volume, "block_size": block_size, "device_blocks": device_blocks, "start_us": start_us, "io_id": np.arange(len(r)), "block_index": r["block_index"].astype("i8"), "op": r["op"].astype("i4"), "span": r["span"].astype("i4"), "elapsed_us": r["elapsed_us"].astype("i8")})

    return files.select("content").mapInPandas(rows, TRACES)


def write_traces(io_: DataFrame, block_size: int, device_blocks: int, ops: list[str]) -> DataFrame:
    """One trace file (volume, part, content) for every 65,536 operations of a volume, in io_id order."""

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("io_id")
        r = np.zeros(len(df), TRACE_RECORD)
        for c in ("block_index", "span", "elapsed_us"):
            r[c] = df[c].to_numpy()
        r["op"] = df["op"].map(ops.index).to_numpy()
        return pd.DataFrame({"volume": [df["volume"].iloc[0]], "part": [df["part"].iloc[0]], "content": [trace_file(df["volume"].iloc[0], block_size, device_blocks, 0, r)]})

    return io_.withColumn("part", F.expr("io_id div 65536")).groupBy("volume", "part").applyInPandas(pack, "volume string, part long, content binary")


def pack_footer(entries: np.ndarray) -> bytes:
    """The index of a pack: its entries, then the trailer."""
    return entries.tobytes() + struct.pack("<HH4s", len(entries), 0, TRAILER_MAGIC)


def parse_pack(data: bytes) -> tuple[np.ndarray, str | None]:
    """The entries of a pack or of its last bytes, and what is wrong with it."""
    none = np.zeros(0, PACK_ENTRY)
    if len(data) < TRAILER:
        return none, "too small for a trailer"
    if data[-4:] != TRAILER_MAGIC:
        return none, "wrong trailer"
    n = struct.unpack_from("<H", data, len(data) - TRAILER)[0]
    start = len(data) - TRAILER - n * PACK_ENTRY.itemsize
    if start < 0:
        return none, "too small for its index"
    return np.frombuffer(data, PACK_ENTRY, n, start), None


def read_packs(files: DataFrame) -> DataFrame:
    """The index entries of packs (pack, content); a pack that isn't valid gives one row with its problem."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["pack"], f["content"], strict=True):
                e, problem = parse_pack(bytes(data or b""))
                if problem:
                    yield pd.DataFrame([(name, None, None, None, None, problem)], columns=["pack", "chunk_offset", "hash", "offset", "comp_length", "problem"]).astype({c: "Int64" for c in ("chunk_offset", "offset", "comp_length")})
                else:
                    yield pd.DataFrame({"pack": name, "chunk_offset": e["chunk_offset"].astype("i8"), "hash": [bytes(h).hex() for h in e["hash"]], "offset": e["offset"].astype("i8"), "comp_length": e["comp_length"].astype("i8"), "problem": None})

    return files.select("pack", "content").mapInPandas(rows, ENTRIES)


def _entries(df: pd.DataFrame) -> np.ndarray:
    df = df.sort_values("chunk_offset")
    e = np.zeros(len(df), PACK_ENTRY)
    e["hash"] = np.frombuffer(bytes.fromhex("".join(df["hash"])), "V16")
    for c in ("chunk_offset", "comp_length"):
        e[c] = df[c].to_numpy()
    e["offset"] = PACK_HEADER + np.cumsum(e["comp_length"]) - e["comp_length"]
    return e


def write_packs(index: DataFrame) -> DataFrame:
    """The footers (pack, content) of packs of an index (chunk_idx, pack_ord, chunk_offset, hash, comp_length)."""

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pack": [f"{df['chunk_idx'].iloc[0]}/{df['pack_ord'].iloc[0]:016x}.pack"], "content": [pack_footer(_entries(df))]})

    return index.groupBy("chunk_idx", "pack_ord").applyInPandas(pack, "pack string, content binary")


def index_sizes(index: DataFrame) -> DataFrame:
    """Bytes of the index of every pack in eight encodings: whole entries, runs with one offset each, without offsets, with
    hash and place alone, and the first three and runs without offsets under zstandard (level 3)."""

    def measure(df: pd.DataFrame) -> pd.DataFrame:
        e = _entries(df)
        cut = np.flatnonzero(np.diff(e["chunk_offset"].astype("i8"), prepend=-9) != 1)
        n = np.diff(np.append(cut, len(e)))
        parts: dict[str, bytes] = {"raw": e.tobytes(), "implicit": e[["hash", "chunk_offset", "comp_length"]].astype([("h", "V16"), ("c", "<u4"), ("l", "<u4")]).tobytes()}
        for name, offsets in (("extents", True), ("hybrid", False)):
            out = []
            for a, m in zip(cut.tolist(), n.tolist(), strict=True):
                place = struct.pack("<I", int(e["chunk_offset"][a])) + (struct.pack("<H", m) if m > 1 else b"") + (struct.pack("<I", int(e["offset"][a])) if offsets else b"")
                body = b"".join(bytes(x["hash"]) + struct.pack("<I", int(x["comp_length"])) for x in e[a : a + m])
                out.append((b"\1" if m > 1 else b"\0") + place + body)
            parts[name] = b"".join(out)
        comp = zstandard.ZstdCompressor(level=3)
        row = {"chunk_idx": df["chunk_idx"].iloc[0], "pack_ord": df["pack_ord"].iloc[0], "entries": len(e), "raw_bytes": len(parts["raw"]), "extent_bytes": len(parts["extents"]), "no_offset_bytes": len(parts["implicit"]), "hash_bytes": 20 * len(e)}
        row |= {f"{k}_zstd": len(comp.compress(parts[k])) for k in ("raw", "implicit", "extents", "hybrid")} | {"hybrid_bytes": len(parts["hybrid"])}
        return pd.DataFrame([row])

    kind = "chunk_idx long, pack_ord long, entries long, raw_bytes long, extent_bytes long, no_offset_bytes long, hash_bytes long, raw_zstd long, implicit_zstd long, extents_zstd long, hybrid_zstd long, hybrid_bytes long"
    return index.groupBy("chunk_idx", "pack_ord").applyInPandas(measure, kind)


_KINDS = {tarfile.REGTYPE: "file", tarfile.AREGTYPE: "file", tarfile.GNUTYPE_SPARSE: "file", tarfile.SYMTYPE: "symlink", tarfile.LNKTYPE: "hardlink", tarfile.CHRTYPE: "char", tarfile.BLKTYPE: "block", tarfile.DIRTYPE: "dir", tarfile.FIFOTYPE: "fifo"}


def read_tars(layers: DataFrame) -> DataFrame:
    """The entries of tar layers (layer, content) in order; entries of other types are left out, a broken archive gives
    what stands before the break."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        names = [c.split()[0] for c in FILES.split(", ")]
        for f in frames:
            out = []
            for layer, data in zip(f["layer"], f["content"], strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(bytes(data or b""))) as tar:
                        for i, m in enumerate(tar):
                            if m.type in _KINDS:
                                body = tar.extractfile(m).read() if m.isreg() else None
                                out.append((layer, i, m.name, _KINDS[m.type], m.size, m.mode, m.linkname, hashlib.md5(body).hexdigest() if body is not None else None))
                except (tarfile.TarError, EOFError, OSError):
                    pass
            yield pd.DataFrame(out, columns=names)

    return layers.select("layer", "content").mapInPandas(rows, FILES)


def write_tars(files: DataFrame) -> DataFrame:
    """Tar layers (layer, content) of files (layer, name, data, mode), by name."""

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w", format=tarfile.PAX_FORMAT) as tar:
            for name, data, mode in sorted(zip(df["name"], df["data"], df["mode"], strict=True)):
                m = tarfile.TarInfo(name)
                m.size, m.mode = len(data), int(mode)
                tar.addfile(m, io.BytesIO(bytes(data)))
        return pd.DataFrame({"layer": [df["layer"].iloc[0]], "content": [raw.getvalue()]})

    return files.groupBy("layer").applyInPandas(pack, "layer string, content binary")
