"""Functions over byte columns that Spark's own don't express: byte differences, content-defined chunks, codecs, CRC-32C."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differing_bytes(x: str, y: str) -> Column:
    """How many bytes of the common length differ."""

    @F.pandas_udf("long")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(p: bytes, q: bytes) -> int:
            n = min(len(p), len(q))
            return int((np.frombuffer(p, np.uint8, n) != np.frombuffer(q, np.uint8, n)).sum()) if n else 0

        return pd.Series([None if p is None or q is None else one(p, q) for p, q in zip(a, b, strict=True)], dtype="Int64")

    return count(x, y)


def differences(x: str, y: str, page: int = 4096) -> Column:
    """differing bytes, compared bytes, pages_changed and pages of two values, both filled up with zeros to the pages of
    the longer one."""

    @F.pandas_udf("differing long, compared long, pages_changed long, pages long")
    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(a, b, strict=True):
            p, q = p or b"", q or b""
            pages = -(-max(len(p), len(q)) // page)
            u, v = np.zeros((2, pages * page), np.uint8)
            u[: len(p)], v[: len(q)] = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
            unlike = u != v
            out.append((int(unlike.sum()), pages * page, int(unlike.reshape(pages, page).any(axis=1).sum()), pages))
        return pd.DataFrame(out, columns=["differing", "compared", "pages_changed", "pages"])

    return count(x, y)


def gear_table(seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """256 numbers of the splitmix64 sequence."""
    m, out, x = (1 << 64) - 1, [], seed
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & m
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


def cut_points(data: bytes, least: int, most: int, mask_bits: int, table: np.ndarray) -> list[int]:
    """Ends of gear chunks. The rolling sum of the last bytes is a sum of shifted table values, so that all candidates
    come from a few vector additions; the walk then only visits candidates."""
    a = table[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint64)
    h = np.zeros(len(a), np.uint64)
    for back in range(min(mask_bits, len(a))):  # a bit of the mask sees only so many bytes
        h[back:] += a[: len(a) - back] << np.uint64(back)
    hits = np.flatnonzero((h & np.uint64((1 << mask_bits) - 1)) == 0) + 1
    ends, start = [], 0
    while start < len(data):
        i = int(np.searchsorted(hits, start + least))
        end = int(hits[i]) if i < len(hits) else len(data)
        start = min(end, start + most, len(data))
        ends.append(start)
    return ends


def content_defined(rows: DataFrame, *, least: int = 16384, most: int = 1 << 20, mask_bits: int = 17) -> DataFrame:
    """doc_id, start, length and hash of the content-defined chunks of rows (doc_id, data)."""
    table = gear_table()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = 0
                for end in cut_points(data or b"", least, most, mask_bits, table):
                    for c, v in zip(out, (k, start, end - start, hashlib.md5(data[start:end]).hexdigest()), strict=True):
                        c.append(v)
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "start", "length", "hash"])

    return rows.mapInArrow(cut, "doc_id long, start long, length long, hash string")


def compression_probe(rows: DataFrame, levels: list[int]) -> DataFrame:
    """Raw and zstandard bytes of rows (data) at each level, and the ratio."""
    import zstandard

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, sums = 0, dict.fromkeys(levels, 0)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                raw += len(data or b"")
                for level in levels:
                    sums[level] += len(zstandard.ZstdCompressor(level=level).compress(data or b""))
        yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array([raw] * len(levels)), pa.array(list(sums.values()))], ["level", "raw_bytes", "zstd_bytes"])

    got = rows.mapInArrow(measure, "level int, raw_bytes long, zstd_bytes long").groupBy("level").agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("zstd_bytes").alias("zstd_bytes"))
    return got.withColumn("ratio", F.round(F.when(F.col("zstd_bytes") == 0, 0.0).otherwise(F.col("raw_bytes") / F.col("zstd_bytes")), 6))


_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0x82F63B78 if _c & 1 else 0)
    _CRC[_i] = _c


def crc32c_many(rows: list[bytes]) -> list[int]:
    """The checksums of several values, byte by byte through all that are long enough at once."""
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    lens = np.array([len(rows[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join(rows[i] for i in order), np.uint8)
    starts, c = np.cumsum(lens) - lens, np.full(len(rows), 0xFFFFFFFF, np.uint32)
    n = len(rows)
    for k in range(int(lens.max(initial=0))):
        n = int(np.searchsorted(-lens[:n], -k, "left"))
        c[:n] = _CRC[(c[:n] ^ data[starts[:n] + k]) & 255] ^ (c[:n] >> 8)
    out = np.empty(len(rows), np.int64)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out.tolist()


def crc32c(data: str) -> Column:
    """CRC-32C (Castagnoli), which isn't the polynomial of Spark's crc32."""

    @F.pandas_udf("long")
    def checksum(x: pd.Series) -> pd.Series:
        live = x.notna().to_numpy()
        got = iter(crc32c_many([bytes(v) for v in x[live]]))
        return pd.Series([next(got) if v else None for v in live], dtype="Int64")

    return checksum(data)
