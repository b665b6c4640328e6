"""Exact Jaccard join of word n-gram sets by T-occurrence search (DivideSkip), with its components.

1. One pass over the texts gives each document's set (64-bit hashes of distinct shingles), its size, a 128-bit key of
   the whole set and the set's *prefix* in hash order (six bytes of each hash, enough to sieve). Documents with equal
   keys are one class from here on.
2. Prefix filter. Of two sets with Jaccard >= s the prefixes of n - ceil(s n) + l hashes share at least l hashes, for
   the smaller l of both (l = 3 n / 10). A class stays only if that many of its prefix hashes occur in another class.
   Hashes travel in blocks (bucket, packed arrays); those that several documents of a block share are counted there,
   so that a very frequent shingle is sent once a block.
3. The sets of what stays are packed in blocks and ordered by document frequency, counted the same way: a block sends a
   shingle once and gets its count back once. Shingles of one class are dropped, and so are classes with less than
   ceil(s n) left.
4. Pivots. Of the classes that share a rare prefix shingle the one with the least share of shingles of its own is its hub
   (of a family of near copies that is the text that they were made of); every class is compared with the hub that it
   meets most often. Classes linked so carry one label. A prefix shingle whose classes all have one label can
   add no link between components; classes that share another, directly or by others, form a group. What a large family
   of near copies leaves of it is small, as its members are linked to their hub one by one.
5. In each group an inverted index is searched by every set, the smallest first: the longest lists are put aside, the
   short ones merged by a heap that skips ahead to where the needed count can be met, and the rest of the needed overlap
   is probed by bisection in the long lists, for all candidates at once. What is linked with the query is left out, as
   it can add no link. A group over `part_hashes` hashes is split: by prefix shingle, where each class goes to every
   shingle that it shares, or into parts that meet pair by pair, whichever makes fewer pairs of classes meet (chains of
   unlike texts the one, families of near copies the other).
6. Links between classes give components; copies get their class's.

Words are the runs of bytes other than space and 0x09-0x0D, A-Z in lower case. A text of 1 to n-1 words is one
shingle; without words the set is empty and linked with nothing. A null doc_id is a row like any other; rows that
repeat a doc_id are compared by their own texts. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .components import components
from .text import LOWER, chunks, column, gather, hash_spans, lists, mix, ngrams, row_unique, trimmed, word_spans

_SETS = "doc_id long, mark long, n long, key binary, prefix binary"
#: Hashes in a block of whole sets, about.
_BLOCK = 1 << 18


def _need(n: np.ndarray | int, pct: int) -> np.ndarray | int:
    """The least overlap of a set of n with any set of Jaccard >= pct / 100."""
    return -(-pct * n // 100)


def sets_of(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct shingle hashes of each text, and their offsets."""
    low = LOWER[buf]
    starts, ends, woffs = word_spans(low, offs)
    return row_unique(*ngrams(hash_spans(low, starts, ends), woffs, n))


def _key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _prefix_size(n: int, pct: int) -> int:
    return min(n, n - int(_need(n, pct)) + max(1, 3 * n // 10))


def _packed(hashes: np.ndarray) -> bytes:
    """Six bytes of each hash."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def signatures(docs: DataFrame, n: int, pct: int) -> DataFrame:
    """doc_id, mark (hash of the text), n (set size), key and prefix of every document; key and prefix are null for an empty set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = column(batch)
            for i, j in chunks(offs, 1 << 21):
                u, uo = sets_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                own = [u[a:b] for a, b in zip(uo[:-1].tolist(), uo[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(uo)), pa.array([_key(s) if len(s) else None for s in own], pa.binary()), pa.array([_packed(s[: _prefix_size(len(s), pct)] >> np.uint64(16)) if len(s) else None for s in own], pa.binary())],
                    ["doc_id", "mark", "n", "key", "prefix"],
                )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark")).mapInArrow(trimmed(rows), _SETS)


def _shared_counts(sets: DataFrame, parts: int) -> DataFrame:
    """The first half of a key (short) and an upper bound of how many hashes of its prefix stand in prefixes of other keys,
    from (key, prefix)."""
    buckets = 8 * parts  # small ones, as several may be dealt to one task

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, bytes] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.frombuffer(b"".join(k[:8] for k in held), ">i8").astype(np.int64)
            lens = np.array([len(x) // 6 for x in held.values()], np.int64)
            hashes, own = _unpacked(b"".join(held.values())), np.repeat(np.arange(len(keys)), lens)
            order = np.argsort(hashes, kind="stable")
            h, own = hashes[order], own[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            count = np.diff(np.append(first, len(h)))
            here = np.bincount(own[np.repeat(count > 1, count)], minlength=len(keys))
            # One row for each hash of this block: its only owner, or -1.
            one = np.where(count == 1, own[first], -1)
            h = h[first]
            # The order by hash is an order by bucket, as buckets are ranges of hashes.
            place = ((h >> np.uint64(24)).astype(np.int64) * buckets) >> 24
            cut = np.searchsorted(place, np.arange(buckets + 1))
            live = np.flatnonzero(np.diff(cut))
            out_h, out_o, out_k = [], [], []
            for b in live.tolist():
                o = one[cut[b] : cut[b + 1]]
                used, back = np.unique(o, return_inverse=True)
                out_h.append(_packed(h[cut[b] : cut[b + 1]]))
                out_o.append(back.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes())
                out_k.append(np.where(used < 0, 0, keys[used]).tobytes() + (b"\1" if used[0] < 0 else b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array(out_h, pa.binary()), pa.array(out_o, pa.binary()), pa.array(out_k, pa.binary())], ["bucket", "hashes", "own", "keys"])
            got = here > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(1, -1), pa.int32()), pa.array([here[got].astype(np.int64).tobytes()], pa.binary()), pa.array([None], pa.binary()), pa.array([keys[got].tobytes()], pa.binary())], ["bucket", "hashes", "own", "keys"])
            held.clear()

        for batch in batches:
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k not in held:
                    held[k] = p
                    size += len(p)
                if size > 1 << 23:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for b, h, o, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b < 0:
                    counts.append((np.frombuffer(k, np.int64), np.frombuffer(h, np.int64)))
                    continue
                by.setdefault(b, []).append((h, o, k))
        for b in list(by):
            parts = []
            for x, o, k in by.pop(b):
                back = np.frombuffer(o, np.uint16 if len(o) * 3 == len(x) else np.uint32)
                parts.append((_unpacked(x), np.frombuffer(k[:-1], np.int64)[back], (back == 0) & (k[-1] == 1)))
            h, k, many = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((k, h))
            h, k, many = h[order], k[order], many[order]
            new_h = np.concatenate(([True], h[1:] != h[:-1]))
            new_k = new_h | np.concatenate(([True], k[1:] != k[:-1]))
            group = np.cumsum(new_h) - 1
            shared = (np.bincount(group, weights=new_k & ~many) > 1) | (np.bincount(group, weights=many) > 0)
            keys, n = np.unique(k[shared[group] & new_k & ~many], return_counts=True)
            counts.append((keys, n))
        if counts:
            k, n = (np.concatenate(x) for x in zip(*counts, strict=True))
            keys, back = np.unique(k, return_inverse=True)
            yield packed(keys, np.bincount(back, weights=n).astype(np.int64))

    def packed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Counts as one row a slot of keys."""
        slot = (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        cut = np.searchsorted(slot[order], np.arange(parts + 1))
        live = np.flatnonzero(np.diff(cut)).tolist()
        return pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), *(pa.array([x[order][cut[i] : cut[i + 1]].tobytes() for i in live], pa.binary()) for x in (keys, n))], ["slot", "keys", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.frombuffer(x, np.int64) for c in b.columns[1:] for x in c.to_pylist()] for b in batches]
        half = [(x[: len(x) // 2], x[len(x) // 2 :]) for x in got]
        if half:
            k, n = (np.concatenate([y for h in half for y in h[i]]) for i in (0, 1))
            keys, back = np.unique(k, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(back, weights=n).astype(np.int64))], ["short", "c"])

    blocks = sets.select("key", "prefix").mapInArrow(trimmed(send), "bucket int, hashes binary, own binary, keys binary")
    met = blocks.repartition(parts, "bucket").mapInArrow(trimmed(meet), "slot int, keys binary, n binary")
    return met.repartition(parts, "slot").mapInArrow(trimmed(total), "short long, c long")


class _Index:
    """An inverted index over sets that grows with each search, and the links found so far: `root` names the component of
    every set."""

    def __init__(self, pct: int, most: int):
        self.pct, self.n = pct, 0
        self.sets: list[np.ndarray] = []
        self.root = np.arange(most)
        self.members: dict[int, list[int]] = {}
        self.lists: dict[int, array] = {}
        self.labels: dict[int, int] = {}

    def join(self, a: int, b: int) -> None:
        """One component of those of two sets; the smaller one is renamed."""
        x, y = sorted((int(self.root[a]), int(self.root[b])), key=lambda r: len(self.members[r]))
        if x != y:
            moved = self.members.pop(x)
            self.root[moved] = y
            self.members[y] += moved

    def linked(self, i: int, j: int, sizes: np.ndarray) -> bool:
        both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return 100 * both >= self.pct * (sizes[i] + sizes[j] - both)

    def search(self, own: np.ndarray, sizes: np.ndarray, label: int) -> None:
        """Link the set `own`, of a size (with shingles of no other class) no less than those before, and add it. Sets of
        one label are known to be linked."""
        q = self.n
        self.n += 1
        self.sets.append(own)
        self.members[q] = [q]
        if self.labels.setdefault(label, q) != q:
            self.join(q, self.labels[label])
        terms = own.tolist()
        known = [self.lists[t] for t in terms if t in self.lists]
        # A few likely partners first: what they link needs no search.
        for c in dict.fromkeys(x[-1] for x in known[:3]):
            if self.root[c] != self.root[q] and self.linked(q, c, sizes):
                self.join(q, c)
        least = int(_need(int(sizes[q]), self.pct))
        if len(known) >= least:
            self._divide_skip(q, [np.frombuffer(x, np.int32) for x in known], least, sizes)
        for t in terms:
            self.lists.setdefault(t, array("i")).append(q)

    def _divide_skip(self, q: int, lists: list[np.ndarray], least: int, sizes: np.ndarray) -> None:
        lists.sort(key=len)
        aside = min(least - 1, int(least / (0.01 * np.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[: len(lists) - aside - 1 : -1]
        ids, count = merged(short, max(1, least - aside))
        # What is linked with the query already can add no link.
        new = self.root[ids] != self.root[q]
        ids, count = ids[new], count[new]
        need = np.ceil(self.pct * (sizes[ids] + sizes[q]) / (100 + self.pct) - 1e-9).astype(np.int64)
        # The longest lists, which hold most candidates, come first; a candidate goes when too few are left for it.
        for k, x in enumerate(long):
            keep = count + len(long) - k >= need
            if not keep.all():
                ids, count, need = ids[keep], count[keep], need[keep]
            if not len(ids):
                return
            count += x[np.minimum(np.searchsorted(x, ids), len(x) - 1)] == ids
        for c in ids[count >= need].tolist():
            if self.root[c] != self.root[q]:
                self.join(q, c)


def merged(lists: list[np.ndarray], least: int, by_heap: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that stand in `least` or more of some ascending lists, and in how many. A heap with skips merges up to
    `by_heap` entries; more are merged by one sort, which takes a Python step for none of them."""
    if sum(map(len, lists)) <= by_heap:
        got = merge_skip([x.tolist() for x in lists], least)
        return np.array([v for v, _ in got], np.int64), np.array([n for _, n in got], np.int64)
    ids, count = np.unique(np.concatenate(lists), return_counts=True)
    keep = count >= least
    return ids[keep].astype(np.int64), count[keep].astype(np.int64)


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """The numbers that stand in `least` or more of some ascending lists, and in how many: a heap merges the lists; where
    too few have the smallest number, all that can't reach `least` is skipped by bisection."""
    heap = [(x[0], i) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    at, out = [0] * len(lists), []
    while len(heap) >= least:
        top, moved = heap[0][0], []
        while heap and heap[0][0] == top:
            moved.append(heapq.heappop(heap)[1])
        if len(moved) >= least:
            out.append((top, len(moved)))
            for i in moved:
                at[i] += 1
        else:
            while heap and len(moved) < least - 1:
                moved.append(heapq.heappop(heap)[1])
            if not heap:
                break
            for i in moved:
                at[i] = bisect_left(lists[i], heap[0][0], at[i])
        for i in moved:
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))
    return out


def link_group(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], pct: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that, with those of equal labels, join the components of a few sets (shingles that no other class has may be
    missing; sizes count them)."""
    order = np.lexsort((ids, sizes))
    index, by_size = _Index(pct, len(ids)), sizes[order]
    labels = ids if labels is None else labels
    for k in order.tolist():
        index.search(sets[k], by_size, int(labels[k]))
    own = ids[order]
    return [(a, b) for a, b in zip(own.tolist(), own[index.root].tolist(), strict=True) if a != b]


def _parts(spark: SparkSession, size: int) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), size // (1 << 23))


def _sieved(sets: DataFrame, pct: int) -> DataFrame:
    """key, n and a doc_id of the classes of which enough of the prefix stands in other classes."""
    own = sets.where("key is not null")
    classes = own.groupBy("key").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"))
    parts = _parts(sets.sparkSession, sets.agg(F.sum(F.length("prefix"))).first()[0] or 0)
    short = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    bound = F.greatest(F.lit(1), F.floor(3 * F.ceil(F.col("n") * pct / 100) / 10))
    return store.saved(classes.withColumn("short", short).join(_shared_counts(own, parts), "short").where(F.col("c") >= bound).select("key", "n", "doc_id"), "jaccard-left")


def _whole_sets(docs: DataFrame, left: DataFrame, n: int) -> DataFrame:
    """Blocks (block, keys, sizes, hashes) of the whole sets of the classes that are left, from the text of one document each."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        keys: list[bytes] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal made
            made += 1
            row = [[(part << 24) + made], [b"".join(keys)], [np.array([len(x) for x in held], np.int64).tobytes()], [np.concatenate(held).tobytes()]]
            keys.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int64(), *[pa.binary()] * 3), strict=True)], ["block", "keys", "sizes", "hashes"])

        size = 0
        for batch in batches:
            buf, offs = column(batch)
            wanted = batch.column(1).to_pylist()
            for i, j in chunks(offs, 1 << 21):
                u, uo = sets_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                for k, a, b in zip(wanted[i:j], uo[:-1].tolist(), uo[1:].tolist(), strict=True):
                    if b > a and _key(u[a:b]) == k:
                        keys.append(k), held.append(u[a:b].copy())
                        size += b - a
                        if size >= _BLOCK or len(keys) >= 1 << 16:
                            yield close()
                            size = 0
        if keys:
            yield close()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = texts.join(left.select("key", F.col("doc_id").alias("rep")).hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "key")
    return store.saved(whole.mapInArrow(trimmed(again), "block long, keys binary, sizes binary, hashes binary"), "jaccard-sets")


def _rare_first(blocks: DataFrame, pct: int) -> DataFrame:
    """id, key, n and the hashes shared with other sets, the rarest first, of sets with enough of them."""
    # Every block may send to every bucket: buckets follow the bytes alone, so that packets don't become many and small.
    parts = max(8, (blocks.agg(F.sum(F.length("hashes"))).first()[0] or 0) >> 22)
    buckets = 2 * parts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, n = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
                place = ((h >> np.uint64(40)).astype(np.int64) * buckets) >> 24
                cut = np.searchsorted(place, np.arange(buckets + 1))
                live = np.flatnonzero(np.diff(cut)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([block] * len(live), pa.int64()), *(pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in live], pa.binary()) for x in (h, n.astype(np.int32)))], ["bucket", "block", "hashes", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for batch in batches:
            for b, block, h, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(b, []).append((block, np.frombuffer(h, np.uint64), np.frombuffer(n, np.int32)))
        for b in list(by):
            rows = by.pop(b)
            h, back = np.unique(np.concatenate([x for _, x, _ in rows]), return_inverse=True)
            df = np.bincount(back, weights=np.concatenate([n for _, _, n in rows])).astype(np.int64)[back]
            out, at = [], 0
            for block, x, _ in rows:
                own = df[at : at + len(x)]
                at += len(x)
                if (own > 1).any():
                    out.append((block, x[own > 1].tobytes(), own[own > 1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["block", "hashes", "df"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, sizes, raw, met in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(raw, np.uint64)
                n = np.frombuffer(sizes, np.int64)
                known = np.concatenate([np.frombuffer(x["hashes"], np.uint64) for x in met])
                df = np.concatenate([np.frombuffer(x["df"], np.int64) for x in met])
                by = np.argsort(known)
                known, df = known[by], df[by]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                row = np.repeat(np.arange(len(n)), n)[hit]
                hit = hit[np.lexsort((h[hit], df[at[hit]], row))]
                offs = np.searchsorted(row, np.arange(len(n) + 1))
                live = np.flatnonzero(np.diff(offs) >= _need(n, pct))
                spots, out = gather(live, offs)
                yield pa.RecordBatch.from_arrays([pa.array((block << 16) + live), pa.array([keys[16 * i : 16 * i + 16] for i in live.tolist()], pa.binary()), pa.array(n[live]), lists(h[hit[spots]].view(np.int64), out, pa.int64())], ["id", "key", "n", "hashes"])

    counted = blocks.select("block", "hashes").mapInArrow(trimmed(send), "bucket int, block long, hashes binary, n binary").repartition(parts, "bucket").mapInArrow(trimmed(meet), "block long, hashes binary, df binary")
    met = counted.groupBy("block").agg(F.collect_list(F.struct("hashes", "df")).alias("met"))
    both = blocks.join(met.hint("shuffle_merge"), "block").select("block", "keys", "sizes", "hashes", "met")
    return store.saved(both.mapInArrow(trimmed(order), "id long, key binary, n long, hashes array<long>"), "jaccard-ordered")


def _with_pivots(ordered: DataFrame, prefix: DataFrame, pct: int) -> DataFrame:
    """id and pivot: the hub that the class meets most often, where the two are linked."""
    hubs = prefix.groupBy("h").agg(F.max("typical").alias("t"), F.count("*").alias("c")).where("c > 1").select("h", F.col("t.id").alias("hub"))
    met = prefix.join(hubs, "h").where("hub <> id").groupBy("id", "hub").agg(F.count("*").alias("times"))
    best = met.groupBy("id").agg(F.max(F.struct("times", "hub")).alias("b")).select("id", F.col("b.hub").alias("pivot"))
    mine = ordered.select("id", "n", "hashes").join(best, "id")
    theirs = ordered.select(F.col("id").alias("pivot"), F.col("n").alias("m"), F.col("hashes").alias("others"))
    both = mine.join(theirs, "pivot").select("id", "pivot", "n", "m", F.size(F.array_intersect("hashes", "others")).alias("both"))
    return store.saved(both.where(100 * F.col("both") >= pct * (F.col("n") + F.col("m") - F.col("both"))).select("id", "pivot"), "jaccard-pivots")


def links(ordered: DataFrame, *, pct: int = 80, part_hashes: int = 1_000_000) -> DataFrame:
    """Links (a, b) between sets (id, n, hashes, the rarest first) that have the components of all links of Jaccard >= pct / 100."""
    least = F.ceil(F.col("n") * pct / 100)
    # A typical class has few shingles of its own.
    typical = F.struct((F.size("hashes") / F.col("n")).alias("share"), "id")
    prefix = ordered.select("id", typical.alias("typical"), F.explode(F.slice("hashes", 1, F.greatest(F.lit(1), (F.size("hashes") - least + 1).cast("int")))).alias("h"))
    pivots = _with_pivots(ordered, prefix, pct)
    # Two steps from pivot to pivot: classes of one label are linked, not all that are linked have one.
    jump = pivots.select(F.col("id").alias("pivot"), F.col("pivot").alias("next"))
    once = pivots.join(jump, "pivot", "left").select("id", F.coalesce("next", "pivot").alias("pivot"))
    labels = once.join(jump, "pivot", "left").select("id", F.coalesce("next", "pivot").alias("to"))
    marked = prefix.join(labels, "id", "left").select("id", "h", F.coalesce("to", "id").alias("label"))
    mixed = marked.groupBy("h").agg(F.min("id").alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h", "hub")
    rare = store.saved(marked.join(mixed, "h").select("id", "h", "hub", "label"), "jaccard-mixed")
    groups = components(rare.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    own = rare.select("id", "label").distinct()
    members = ordered.select("id", "n", "hashes").join(own, "id").join(groups.select(F.col("node").alias("id"), F.col("root").alias("group")), "id")
    # A large group is dealt by shingle or into parts that meet pair by pair, whichever makes fewer pairs of sets meet.
    meets = rare.join(groups.select(F.col("node").alias("id"), F.col("root").alias("group")), "id").groupBy("group", "h").agg(F.count("*").cast("double").alias("c")).groupBy("group").agg(F.sum(F.col("c") * F.col("c")).alias("by_h"))
    sizes = members.groupBy("group").agg(F.ceil(F.sum(F.size("hashes")) / part_hashes).cast("int").alias("parts"), F.count("*").cast("double").alias("m"))
    sizes = sizes.join(meets, "group").select("group", "parts", ((F.col("parts") > 1) & (F.col("by_h") < F.col("m") * F.col("m"))).alias("by_shingle"))
    dealt = store.saved(members.join(sizes, "group"), "jaccard-members")
    # Part p meets every other part: pair (p, q) with p <= q once; an undivided group is pair (0, 0).
    pair = F.expr("transform(sequence(0, parts - 1), q -> struct(least(p, q) as p, greatest(p, q) as q))")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    whole = dealt.where("not by_shingle").withColumn("p", part).select(F.col("group").alias("at"), "id", "n", "hashes", "label", F.explode(pair).alias("pq"))
    by_shingle = dealt.where("by_shingle").select("id", "n", "hashes", "label").join(rare.select("id", "h"), "id")
    counts = by_shingle.groupBy("h").agg(F.ceil(F.sum(F.size("hashes")) / part_hashes).cast("int").alias("parts"))
    split = by_shingle.join(counts, "h").withColumn("p", part).select(F.col("h").alias("at"), "id", "n", "hashes", "label", F.explode(pair).alias("pq"))
    whole, split = (x.select("at", "id", "n", "hashes", "label", "pq.p", "pq.q") for x in (whole, split))

    def search(df: pd.DataFrame) -> pd.DataFrame:
        got = link_group(df["id"].to_numpy(), df["n"].to_numpy(), [np.asarray(x) for x in df["hashes"]], pct, df["label"].to_numpy())
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    kind = "a long, b long"
    found = whole.groupBy("at", "p", "q").applyInPandas(search, kind).unionByName(split.groupBy("at", "p", "q").applyInPandas(search, kind))
    out = found.unionByName(pivots.select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    out.written = [pivots, rare, dealt]
    return out


def _classes(docs: DataFrame, n: int, pct: int, part_hashes: int) -> DataFrame:
    """What classes() returns, with mark and `group`, which names the component (null: no words)."""
    spark = docs.sparkSession
    sets = store.saved(signatures(docs, n, pct), "jaccard-sets")
    left = _sieved(sets, pct)
    store.free(spark)
    blocks = _whole_sets(docs, left, n)
    store.drop(left)
    store.free(spark)
    ordered = _rare_first(blocks, pct)
    store.drop(blocks)
    store.free(spark)
    linked = links(ordered, pct=pct, part_hashes=part_hashes)
    found = components(linked)
    store.drop(*linked.written)
    own = sets.select("doc_id", "mark", "n", "key")
    firsts = own.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("class_id"))
    linked = found.select(F.col("node").alias("id"), "root").join(ordered.select("id", "key"), "id").groupBy("key").agg(F.min("root").alias("root"))
    linked = store.saved(linked.join(firsts, "key"), "jaccard-linked")
    store.drop(ordered)
    roots = linked.groupBy("root").agg(F.min("class_id").alias("component_id"), F.count("*").alias("component_classes"), F.min("key").alias("group"))
    of = linked.join(roots, "root").select("key", "component_id", "component_classes", "group")
    per_class = firsts.join(of, "key", "left").select("key", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("component_classes", F.lit(1)).alias("component_classes"), F.coalesce("group", "key").alias("group"))
    return own.join(per_class, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(F.col("key").isNotNull(), F.col("class_id")).alias("class_id"), F.coalesce("component_classes", F.lit(0)).alias("component_classes"), "mark", "group")


def classes(docs: DataFrame, *, n: int = 5, pct: int = 80, part_hashes: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id, component_classes of every row of docs.

    component_classes: the classes of the component. A document without words has itself and no class.
    """
    return _classes(docs, n, pct, part_hashes).drop("mark", "group")


def representatives(docs: DataFrame, *, n: int = 5, pct: int = 80, part_hashes: int = 1_000_000) -> DataFrame:
    """Of each component the row of docs with the smallest doc_id (null after all others), once; rows without words stay,
    each different (doc_id, text) once."""
    rows = _classes(docs, n, pct, part_hashes).select("doc_id", "mark", "group")
    first = rows.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("r")).select("r.doc_id", "r.mark")
    kept = first.unionByName(rows.where("group is null").select("doc_id", "mark")).distinct().select(F.col("doc_id").alias("__id"), F.col("mark").alias("__of"))
    marked = docs.withColumn("__mark", F.xxhash64(F.col("text").cast("string")))
    left = marked.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__of")), "left_semi")
    return left.dropDuplicates(["doc_id", "__mark"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(store.table(spark, sf_dir, "documents"))
