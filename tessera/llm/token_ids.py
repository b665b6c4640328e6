"""Token ids in binary segments: id blocks transposed to bit or byte planes, each compressed with zstandard.

A *segment* holds the ids of consecutive documents, closed at the first document end past `segment_ids`. Its bytes:

    "TPL1" | bits per plane u8 (1 or 8) | planes u8 | block ids u32 | ids u64 | documents u32 | blocks u32
    chunk index: blocks x planes u32 compressed lengths (0: the plane is all zero)
    document ends: u32 compressed length, then zstandard of documents x u64
    compressed planes, block after block

A segment stands in one row of a Parquet table (part, seg, n_ids, n_docs, doc_ids, data), so that Spark's commit
protocol decides which attempt of a task counts and any file system serves. Parts ascend with doc_id, segments within
a part too, hence (part, seg) is the order of the ids.

Null or empty texts have the end id alone. Rows with a null doc_id come first; equal ids are ordered by text. An
empty table gives an empty table. Other columns are ignored, also those named like ours.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .text import SPACE, UnitCache, chunks, column, gather, trimmed

END_ID = 2
BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 20
FILE_SCHEMA = "part int, seg int, n_ids long, n_docs int, doc_ids array<long>, data binary"
_HEAD = struct.Struct("<4sBBIQII")

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POINT = np.zeros(256, bool)
_POINT[list(b'.,;:!?)"*%$&#')] = True
#: A non-ASCII character that may be white space has one of these bytes before its last.
_DOUBT = np.zeros(256, bool)
_DOUBT[[0xC2, 0x80, 0x81, 0x9A]] = True


def _solid(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether a character, by its last byte and the one before, can't be white space."""
    return np.where(last >= 0x80, ~_DOUBT[before], (last > 0x20) & (last != 0x7F))


def unit_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts where the byte-level pattern always cuts: before white space and before points that follow a letter.

    The ids of a text are those of its units, one after another.
    """
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    b1 = np.concatenate((np.zeros(1, np.uint8), buf[:-1]))
    b2 = np.concatenate((np.zeros(2, np.uint8), buf[:-2]))[:n]
    letter = _ALPHA[b1] | (b1 >= 0x80) & (b2 == 0xC3) & (b1 != 0x97) & (b1 != 0xB7)
    cut = SPACE[buf] & _solid(b1, b2) | _POINT[buf] & letter
    cut[offs[:-1][offs[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offs)


class Encoder:
    """The tokenizers library over distinct units; ids are kept for later batches of the same Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A token is written with one character a byte; added tokens are written as they are.
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max([*vocab.values(), *added]) + 1, np.int64)
        self.sizes[list(vocab.values())] = [len(x) for x in vocab]
        self.sizes[list(added)] = list(added.values())
        self.cache = UnitCache(self._encode)

    def _encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units that begin with a space and end so that a space after them is a cut go to the library in strings of
        many, which it cuts where they meet; the bytes of the ids tell them apart. Others go alone."""
        data = buf.tobytes()
        units = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        joins = SPACE[buf[starts]] & _solid(buf[ends - 1], buf[np.maximum(ends - 2, 0)])
        groups = [g for g in np.array_split(np.flatnonzero(joins), max(1, int(joins.sum()) // 256)) if len(g)]
        got: list = [None] * len(units)
        alone = np.flatnonzero(~joins).tolist()
        for g, e in zip(groups, self._batch([b"".join([units[i] for i in g.tolist()]) for g in groups]), strict=True):
            ids = np.array(e, np.int32)
            reach, wanted = np.cumsum(self.sizes[ids]), np.cumsum(ends[g] - starts[g])
            at = np.minimum(np.searchsorted(reach, wanted), len(ids) - 1)
            if (reach[at] != wanted).any():
                alone += g.tolist()
                continue
            cut = at + 1
            for i, a, b in zip(g.tolist(), [0, *cut[:-1].tolist()], cut.tolist(), strict=True):
                got[i] = ids[a:b]
        for i, e in zip(alone, self._batch([units[i] for i in alone]), strict=True):
            got[i] = np.array(e, np.int32)
        return np.concatenate([np.zeros(0, np.int32), *got]), np.array([len(x) for x in got], np.int64)

    def _batch(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every row with END_ID after each, and the row offsets."""
        starts, ends, uoffs = unit_spans(buf, offs)
        rows = self.cache.lookup(buf, starts, ends)
        at, ioffs = gather(rows, self.cache.offs)
        ids, doffs = self.cache.ids[at], ioffs[uoffs]
        return np.insert(ids, doffs[1:], END_ID), doffs + np.arange(len(doffs))


def pack(ids: np.ndarray, ends: np.ndarray, *, bits: int = 8, block: int = BLOCK_IDS, level: int = 3) -> bytes:
    """One segment of ids whose documents end at `ends`."""
    ids = ids.astype("<u4")
    width = max(1, int(ids.max(initial=0)).bit_length())
    planes = (width + 7) // 8 if bits == 8 else width
    comp = zstandard.ZstdCompressor(level=level)
    sizes, body = [], []
    for a in range(0, len(ids), block):
        part = ids[a : a + block]
        by_id = part.view(np.uint8).reshape(-1, 4)
        if bits == 1:
            by_id = np.unpackbits(by_id, axis=1, bitorder="little")
        for p in range(planes):
            plane = np.ascontiguousarray(by_id[:, p])
            raw = comp.compress((np.packbits(plane, bitorder="little") if bits == 1 else plane).tobytes()) if plane.any() else b""
            sizes.append(len(raw))
            body.append(raw)
    blocks = -(-len(ids) // block)
    tail = comp.compress(ends.astype("<u8").tobytes())
    head = _HEAD.pack(b"TPL1", bits, planes, block, len(ids), len(ends), blocks)
    return b"".join([head, np.array(sizes, "<u4").tobytes(), struct.pack("<I", len(tail)), tail, *body])


def unpack(data: bytes, only_block: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids and document ends of a segment, or the ids of one block, found by the chunk index."""
    magic, bits, planes, block, n, docs, blocks = _HEAD.unpack_from(data)
    if magic != b"TPL1":
        raise ValueError("not a segment of token ids")
    at = _HEAD.size
    sizes = np.frombuffer(data, "<u4", blocks * planes, at).astype(np.int64)
    at += sizes.nbytes // 2
    (size,) = struct.unpack_from("<I", data, at)
    dec = zstandard.ZstdDecompressor()
    ends = np.frombuffer(dec.decompress(data[at + 4 : at + 4 + size], max_output_size=8 * docs + 8), "<u8").astype(np.int64)
    offs = at + 4 + size + np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for b in range(blocks) if only_block is None else [only_block]:
        m = min(block, n - b * block)
        wide = np.zeros((m, 4 if bits == 8 else 32), np.uint8)
        for p in range(planes):
            lo, hi = int(offs[b * planes + p]), int(offs[b * planes + p + 1])
            if lo < hi:
                raw = np.frombuffer(dec.decompress(data[lo:hi], max_output_size=m + 8), np.uint8)
                wide[:, p] = np.unpackbits(raw, bitorder="little")[:m] if bits == 1 else raw
        out.append((np.packbits(wide, axis=1, bitorder="little") if bits == 1 else wide).reshape(-1).view("<u4"))
    return np.concatenate([np.zeros(0, "<u4"), *out]), ends


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, path: str, tokenizer: str, *, bits: int = 8, block: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode the texts of docs (doc_id, text) and write their segments to `path`, ascending by doc_id."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, enc = TaskContext.get().partitionId(), 0, _encoder(tokenizer)
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        names: list[pa.Array] = []

        def close() -> pa.RecordBatch:
            nonlocal seg
            ends = np.cumsum(np.concatenate(lens))
            keys = pa.concat_arrays(names)
            cols = [[part], [seg], [int(ends[-1])], [len(ends)], None, [pack(np.concatenate(ids), ends, bits=bits, block=block)]]
            arrays = [pa.array(c, k) if c is not None else pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), None, pa.binary()), strict=True)]
            seg += 1
            ids.clear(), lens.clear(), names.clear()
            return pa.RecordBatch.from_arrays(arrays, ["part", "seg", "n_ids", "n_docs", "doc_ids", "data"])

        held = 0
        for batch in batches:
            buf, offs = column(batch)
            for i, j in chunks(offs, 1 << 20):
                got, doffs = enc.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                ids.append(got), lens.append(np.diff(doffs)), names.append(batch.column(0).slice(i, j - i))
                held += len(got)
                if held >= segment_ids:
                    yield close()
                    held = 0
        if lens:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(trimmed(segments), FILE_SCHEMA).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the segments at `path`: doc_id, part, seg, at (position in the segment), ids."""
    return _documents(spark, path, True)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    seg = spark.read.schema(FILE_SCHEMA).parquet(path).select("part", "seg", "n_ids")
    parts = seg.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = seg.select("part", "seg", inside.alias("inside")).join(before, "part").select("part", "seg", (F.col("base") + F.col("inside")).alias("seg_start"))
    return _documents(spark, path, False).join(starts, ["part", "seg"]).select("doc_id", (F.col("seg_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _documents(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, seg, keys, data = (batch.column(k)[r] for k in range(4))
                ids, ends = unpack(data.as_py())
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                raw = ids.astype("<u4").tobytes()
                n = len(ends)
                cols = [keys.values, pa.array(np.full(n, part.as_py()), pa.int32()), pa.array(np.full(n, seg.as_py()), pa.int32()), pa.array(starts), pa.array(ends - starts)]
                cols.append(pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()))
                names = ["doc_id", "part", "seg", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, part int, seg int, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spark.read.schema(FILE_SCHEMA).parquet(path).select("part", "seg", "doc_ids", "data").mapInArrow(trimmed(rows), schema)


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.folder(spark, "token-ids")
    write(store.table(spark, sf_dir, "documents"), path, byte_bpe_path())
    return digests(spark, path)
