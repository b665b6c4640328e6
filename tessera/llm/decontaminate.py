"""Benchmark decontamination by latent semantic retrieval, with longest-common-subsequence and answer checks.

1. *Hits*. One pass cuts the texts into words and stores, for every document, which words of the benchmark stand where
   (four bytes a place and a term); the later passes read these alone. Passages are `size` words, one every size / 2; the
   pass also counts the passages of every term, over all documents. A term of more than a fiftieth of all passages has
   no weight, unless it is among the sixteen rarest of an item.
2. *Randomised SVD*. With A the unit tf-idf rows of passages that cover all texts, and of the benchmark items (the items
   weighted up to the passages' total), every task sums A^T A, of a block's terms squared however large the corpus, and
   multiplies it with a fixed random R; the sum over the tasks is orthonormalised to the latent basis Q.
3. *Search*. Items are cut into pieces like passages, the last one ending with the item. Passages are projected on Q;
   items with a piece of a latent cosine of `cosine` or more are candidates. A passage is left out only if no window of
   step 4 around it can hold 0.6 of the weight of any item's terms: of the rarest terms that have 0.6 of it, a window
   must hold a third (then 0.2 of the whole) or more.
4. *Checks*. A candidate counts where the longest common subsequence of the item's words with a window has 0.8 of the
   item, or, as a paraphrase, 0.55 of it while 0.6 of the weight of the item's terms and 0.6 of its answer (its last
   `answer` words) are there too, in order. The window is the passage and half a passage on either side; for an item
   longer than a passage it has the item's length, a quarter of it and a passage, from every half passage at which a
   copy of the item that meets the passage can begin.

The benchmark's distinct words go to the executors, and its items in blocks of about `block_items` pieces and at most
about `block_words` words, which bounds a block's terms and so A^T A, each with a basis of its own; the rank of a block is a quarter of its pieces, but at least `rank` and at most `RANK`. Null or empty
texts and items match nothing; items and documents that repeat are reported each; an empty table on either side gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .sums import summed
from .text import LOWER, Table, chunks, column, gather, hash_spans, trimmed, word_spans

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Letters and digits in lower case, everything else a space.
_FOLDED = np.where(_LETTER, LOWER, np.uint8(0x20))
#: The largest rank of a block; only an item of very many pieces reaches it.
RANK = 512
#: Shares of an item: of its terms' weight that a window must hold, and of the rarest terms that tell windows without it.
ENOUGH, TOLD = 0.6, 0.6
HITS = "doc_id long, n_words long, place binary, term binary, df binary"
MATCHES = "doc_id long, item_id long, cosine double, lcs double, first_word long, last_word long"


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits, A-Z in lower case) and the word offsets of the rows."""
    low = _FOLDED[buf]
    starts, ends, woffs = word_spans(low, offs)
    return hash_spans(low, starts, ends), woffs


def passages(row: np.ndarray, pos: np.ndarray, term: np.ndarray, n_words: np.ndarray, size: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, count) without repeats, and the first passage of each row. A row has a passage for each half-size step."""
    step = size // 2
    n = np.maximum(1, -(-n_words // step) - 1)
    first = np.concatenate(([0], np.cumsum(n)))
    k = pos // step
    two = (k > 0) & (k < n[row])
    pair = np.concatenate(((first[row] + np.minimum(k, n[row] - 1)) * terms + term, (first[row[two]] + k[two] - 1) * terms + term[two]))
    pair, count = np.unique(pair, return_counts=True)
    p, t = np.divmod(pair, terms)
    return p, t, count, first


class Block:
    """Some benchmark items, as numbers of their own terms, and, once fitted, their latent vectors."""

    def __init__(self, ids: list[int], texts: list[str], vocab: np.ndarray, df: np.ndarray, n: int, size: int, answer: int, rank: int):
        h, woffs = words_of(*column(pa.record_batch([pa.array(texts, pa.large_string())], ["text"])))
        every = np.searchsorted(vocab, h)
        own, flat = np.unique(every, return_inverse=True)
        self.size, self.answer, self.ids = size, answer, np.array(ids, np.int64)
        self.terms = len(own)
        self.number = np.full(len(vocab), -1, np.int32)
        self.number[own] = np.arange(self.terms)
        self.items = np.split(flat, woffs[1:-1])
        self.pieces = [(i, a) for i, x in enumerate(self.items) for a in (*range(0, len(x) - size, size // 2), max(0, len(x) - size))]
        self.rank = max(rank, min(RANK, -(-len(self.pieces) // 4)))
        df = df[own]
        live = df * 50 <= n
        for i, a in self.pieces:
            some = np.unique(self.items[i][a : a + size])
            live[some[np.argsort(df[some], kind="stable")[:16]]] = True
        self.idf = np.where(live, np.log((2 + n) / (1 + df)), 0.0)
        self._told(df)

    def _told(self, df: np.ndarray) -> None:
        """For the rarest terms of each item, up to TOLD of its weight: (item, weight, reach to the left and to the right in
        half passages) by term; and the weight of them that a window must hold."""
        half, rows = self.size // 2, []
        self.least = np.zeros(len(self.items))
        for i, x in enumerate(self.items):
            own = np.unique(x)
            own = own[np.argsort(df[own], kind="stable")]
            w = self.idf[own]
            k = int(np.searchsorted(np.cumsum(w), TOLD * w.sum() - 1e-9)) + 1
            self.least[i] = w[:k].sum() - (1 - ENOUGH) * w.sum() - 1e-6
            n = len(x)
            left, right = (2, 1) if n <= self.size else (-(-(n + n // 4 + 2 * self.size) // half), -(-(n + half) // half))
            rows += [(t, i, v, left, right) for t, v in zip(own[:k].tolist(), w[:k].tolist(), strict=True)]
        rows.sort()
        t = np.array([r[0] for r in rows], np.int64)
        self.told = np.searchsorted(t, np.arange(self.terms + 1))
        self.told_item, self.told_weight, self.told_left, self.told_right = (np.array([r[j] for r in rows], k) for j, k in ((1, np.int64), (2, np.float64), (3, np.int64), (4, np.int64)))

    def wanted(self, row: np.ndarray, pos: np.ndarray, term: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Passages around which some window may hold enough of some item's weight."""
        at, ends = gather(term, self.told)
        own = np.repeat(np.arange(len(term)), np.diff(ends))
        k = first[row[own]] + pos[own] // (self.size // 2)
        lo = np.maximum(first[row[own]], k - self.told_left[at])
        hi = np.minimum(first[row[own] + 1] - 1, k + self.told_right[at])
        lo = np.minimum(lo, hi)
        n = hi - lo + 1
        out = np.zeros(int(first[-1]), bool)
        # Some rows at a time: long items reach far.
        of = row[own]
        sizes = np.concatenate(([0], np.cumsum(np.bincount(of, weights=n, minlength=len(first) - 1)))).astype(np.int64)
        for i, j in chunks(sizes, 1 << 22):
            a, b = np.searchsorted(of, (i, j))
            m, x = n[a:b], at[a:b]
            stops = np.cumsum(m)
            p = np.repeat(lo[a:b] - (stops - m), m) + np.arange(int(stops[-1]) if len(m) else 0)
            key, back = np.unique(p * len(self.items) + np.repeat(self.told_item[x], m), return_inverse=True)
            weight = np.bincount(back, weights=np.repeat(self.told_weight[x], m), minlength=len(key))
            p, item = np.divmod(key, len(self.items))
            out[p[weight >= self.least[item]]] = True
        return out

    def rows(self, p: np.ndarray, t: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unit tf-idf rows as (row starts, passage of each row, terms, weights)."""
        live = self.idf[t] > 0
        p, t = p[live], t[live]
        w = (1 + np.log(count[live])) * self.idf[t]
        starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, np.int64)
        if len(p):
            norm = np.sqrt(np.add.reduceat(w * w, starts))
            w = w / np.repeat(norm, np.diff(np.append(starts, len(p))))
        return starts, p[starts], t, w.astype(np.float32)

    def project(self, starts: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), self.basis.shape[1]), np.float32)
        ends = np.append(starts, len(t))
        for i, j in chunks(ends, (1 << 22) // self.basis.shape[1]) if len(starts) else ():
            a, b = ends[i], ends[j]
            out[i:j] = np.add.reduceat(self.basis[t[a:b]] * w[a:b, None], starts[i:j] - a, axis=0)
        return out

    def gram(self, starts: np.ndarray, t: np.ndarray, w: np.ndarray, out: np.ndarray) -> None:
        """Add the upper half of A^T A of some rows, the terms of each ascending, to the flat matrix out."""
        row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
        at = np.arange(len(t))
        np.add.at(out, t * (self.terms + 1), w * w)
        apart = 1
        while len(at := at[at + apart < len(t)]) and len(at := at[row[at] == row[at + apart]]):
            np.add.at(out, t[at] * self.terms + t[at + apart], w[at] * w[at + apart])
            apart += 1

    def times_random(self, half: np.ndarray) -> np.ndarray:
        """A^T A R from the upper half of A^T A."""
        g = half.reshape(self.terms, self.terms)
        r = np.random.default_rng(3).normal(size=(self.terms, self.rank)).astype(np.float32)
        return g @ r + g.T @ r - g.diagonal()[:, None] * r

    def finish(self, y: np.ndarray, passages: int) -> None:
        """The basis from the summed sketch, item vectors, and what the checks need."""
        flat = [np.unique(self.items[i][a : a + self.size], return_counts=True) for i, a in self.pieces]
        p = np.repeat(np.arange(len(flat)), [len(x) for x, _ in flat])
        starts, which, t, w = self.rows(p, np.concatenate([x for x, _ in flat]), np.concatenate([c for _, c in flat]))
        own = np.zeros(self.terms**2, np.float32)
        self.gram(starts, t, w, own)
        y = y + self.times_random(own) * (max(1, passages) / max(1, len(starts)))
        self.basis = np.linalg.qr(y.astype(np.float64))[0].astype(np.float32)
        z = self.project(starts, t, w)
        self.latent, self.which = z / np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True)), np.array([i for i, _ in self.pieces], np.int64)[which]
        self.masks, self.weight = [], []
        for x in self.items:
            mask: dict[int, int] = {}
            for i, k in enumerate(x.tolist()):
                mask[k] = mask.get(k, 0) | 1 << i
            some = np.unique(x)
            self.masks.append(mask)
            self.weight.append((dict(zip(some.tolist(), self.idf[some].tolist(), strict=True)), float(self.idf[some].sum())))

    def windows(self, item: int, lo: int) -> tuple[range, int]:
        """First words, and the length, of the windows that hold any copy of the item that meets the passage from word lo on."""
        half, n = self.size // 2, len(self.items[item])
        if n <= self.size:
            return range(lo - half, lo, half), self.size + 2 * half
        return range((lo - n) // half * half, lo + self.size, half), n + n // 4 + self.size

    def common(self, item: int, terms: list[int]) -> int:
        """The longest common subsequence, as the bits of a row vector: bit i is 0 once a word ends a longer one at item word i."""
        mask, full = self.masks[item], (1 << len(self.items[item])) - 1
        v = full
        for x in terms:
            m = mask.get(x)
            if m is not None:
                u = v & m
                v = (v + u) | (v - u)
        return len(self.items[item]) - (v & full).bit_count()

    def check(self, item: int, terms: list[int]) -> float:
        """The share of the item in the longest common subsequence, or 0 where the checks fail."""
        weight, total = self.weight[item]
        have = set(terms) & weight.keys()
        n = len(self.items[item])
        if sum(weight[x] for x in have) < 0.6 * total:
            return 0.0
        ratio = self.common(item, terms) / n
        if ratio >= 0.8:
            return ratio
        if ratio < 0.55:
            return 0.0
        tail = self.items[item][-self.answer :].tolist()
        row = [0] * (len(tail) + 1)
        for x in terms:
            last = 0
            for j, y in enumerate(tail, 1):
                last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
        return ratio if row[-1] >= 0.6 * len(tail) else 0.0


def _hits(texts: DataFrame, vocab: np.ndarray, size: int) -> DataFrame:
    """doc_id, n_words, places (differences) and terms of the benchmark's words of every text that has any; and, in rows
    without n_words, the passages (term -1: all) that a task has counted by term."""
    table = Table(vocab)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocab), np.int64), 0
        types = (pa.int64(), pa.int64(), *[pa.binary()] * 3)
        names = ["doc_id", "n_words", "place", "term", "df"]
        for batch in batches:
            buf, offs = column(batch)
            ids = batch.column(0)
            for i, j in chunks(offs, 1 << 20):
                h, woffs = words_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                hit, term = table.find(h)
                cut = np.searchsorted(hit, woffs)
                row = np.repeat(np.arange(j - i), np.diff(cut))
                pos = hit - woffs[row]
                _, t, _, first = passages(row, pos, term, np.diff(woffs), size, max(1, len(vocab)))
                df += np.bincount(t, minlength=len(df))
                n += int(first[-1])
                step = np.diff(pos, prepend=0)
                step[cut[:-1][np.diff(cut) > 0]] = pos[cut[:-1][np.diff(cut) > 0]]
                live = np.flatnonzero(np.diff(cut))
                place, term = step.astype(np.int32), term.astype(np.int32)
                spans = list(zip(cut[live].tolist(), cut[live + 1].tolist(), strict=True))
                cols = [ids.slice(i, j - i).take(pa.array(live)), np.diff(woffs)[live], [place[a:b].tobytes() for a, b in spans], [term[a:b].tobytes() for a, b in spans], [None] * len(live)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) if not isinstance(x, pa.Array) else x for x, k in zip(cols, types, strict=True)], names)
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, None, np.append(met, -1).astype(np.int32).tobytes(), np.append(df[met], n).tobytes()), types, strict=True)], names)

    return store.saved(texts.mapInArrow(trimmed(rows), HITS), "benchmark-hits")


def _frequencies(hits: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """Passages by term, and all passages."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int32)), pa.array(np.frombuffer(n, np.int64))], ["i", "n"])

    got = hits.where("n_words is null").select("term", "df").mapInArrow(rows, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(terms + 1, np.int64)
    df[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return df[:-1], int(df[-1])


def _each(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple]:
    """doc ids, row, place and term of the hits of a block's terms, and the words of each row."""
    for batch in batches:
        place, term = (pa.concat_arrays([batch.column(k)]).cast(pa.large_binary()) for k in (2, 3))
        offs = np.frombuffer(place.buffers()[1], np.int64)[place.offset : place.offset + len(place) + 1] // 4
        n_words = np.asarray(batch.column(1))
        for i, j in chunks(offs, 1 << 20):
            a, b = int(offs[i]), int(offs[j])
            t = block.number[np.frombuffer(term.buffers()[2], np.int32)[a:b]]
            pos = np.cumsum(np.frombuffer(place.buffers()[2], np.int32)[a:b], dtype=np.int64)
            cut = offs[i : j + 1] - a
            row = np.repeat(np.arange(j - i), np.diff(cut))
            pos -= np.concatenate(([0], pos))[cut[:-1]][row]
            own = t >= 0
            yield batch.column(0).slice(i, j - i), row[own], pos[own], t[own].astype(np.int64), n_words[i:j]


def _sketch(hits: DataFrame, block: Block, parts: int = 8) -> np.ndarray:
    """The sum of A^T A R over all passages."""

    def add(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        g = np.zeros(block.terms**2, np.float32)
        for _, row, pos, term, n_words in _each(batches, block):
            live = block.idf[term] > 0
            p, t, c, first = passages(row[live], pos[live], term[live], n_words, block.size, block.terms)
            # Every second passage of a document, and its last, hold all its words.
            n = np.diff(first)
            at = np.arange(int(first[-1])) - np.repeat(first[:-1], n)
            use = ((at % 2 == 0) | (at == np.repeat(n, n) - 1))[p]
            starts, _, tt, w = block.rows(p[use], t[use], c[use])
            block.gram(starts, tt, w, g)
        return dict(enumerate(np.array_split(block.times_random(g), parts)))

    got = summed(hits.where("n_words is not null").select("doc_id", "n_words", "place", "term"), add, np.float32, parts)
    return np.concatenate([got[k] for k in sorted(got)]).reshape(-1, block.rank).astype(np.float64) if got else np.zeros((block.terms, block.rank))


def _search(hits: DataFrame, block: Block, cosine: float) -> DataFrame:
    half = block.size // 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, pos, term, n_words in _each(batches, block):
            live = block.idf[term] > 0
            p, t, n, first = passages(row[live], pos[live], term[live], n_words, block.size, block.terms)
            use = block.wanted(row[live], pos[live], term[live], first)[p]
            starts, which, tt, w = block.rows(p[use], t[use], n[use])
            z = block.project(starts, tt, w)
            z /= np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True))
            some = max(1, (1 << 23) // max(1, len(block.latent)))
            near = []
            for k in range(0, len(z), some):
                cos = z[k : k + some] @ block.latent.T
                x, y = np.nonzero(cos >= cosine)
                near += zip((x + k).tolist(), y.tolist(), cos[x, y].tolist(), strict=True)
            cut = np.searchsorted(row, np.arange(len(first)))
            best: dict[tuple[int, int], tuple] = {}
            seen: set[tuple[int, int, int]] = set()
            for a, i, c in near:
                g = int(which[a])
                r = int(np.searchsorted(first, g, "right")) - 1
                lo = (g - int(first[r])) * half
                k = int(block.which[i])
                begins, width = block.windows(k, lo)
                for b in begins:
                    if (r, k, b) in seen:
                        continue
                    seen.add((r, k, b))
                    s, e = np.searchsorted(pos[cut[r] : cut[r + 1]], (b, b + width)) + cut[r]
                    ratio = block.check(k, term[s:e].tolist())
                    if ratio and ratio > best.get((r, k), (0,))[0]:
                        best[r, k] = (ratio, c, max(0, b), b + width)
            if best:
                keys = ids.take(pa.array([r for r, _ in best]))
                v = list(best.values())
                yield pa.RecordBatch.from_arrays([keys, pa.array([int(block.ids[k]) for _, k in best]), pa.array([x[1] for x in v]), pa.array([x[0] for x in v]), pa.array([x[2] for x in v]), pa.array([x[3] for x in v])], ["doc_id", "item_id", "cosine", "lcs", "first_word", "last_word"])

    return hits.where("n_words is not null").select("doc_id", "n_words", "place", "term").mapInArrow(trimmed(find), MATCHES)


def _vocabulary(items: DataFrame) -> np.ndarray:
    """Hashes of the benchmark's distinct words, ascending."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words_of(*column(batch))[0]).view(np.int64))], ["h"])

    return np.sort(items.select("text").mapInArrow(rows, "h long").distinct().toArrow().column(0).to_numpy().view(np.uint64))


def matches(docs: DataFrame, benchmark: DataFrame, *, size: int = 64, rank: int = 128, cosine: float = 0.30, answer: int = 5, block_items: int = 250, block_words: int = 8192) -> DataFrame:
    """doc_id, item_id, cosine, lcs, first_word and last_word of every document that holds an item."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    count = F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))
    pieces, words = items.agg(F.sum(F.greatest(F.lit(1), F.ceil(count / (size // 2)) - 1)), F.sum(count)).first()
    blocks = max(1, -(-int(pieces or 0) // block_items), -(-int(words or 0) // block_words))
    out = spark.createDataFrame([], MATCHES)
    vocab = _vocabulary(items)
    if not len(vocab):
        return out
    hits = _hits(texts, vocab, size)
    df, n = _frequencies(hits, len(vocab))
    for b in range(blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect())
        rows = [r for r in rows if _FOLDED[np.frombuffer(r.text.encode(), np.uint8)].max(initial=0x20) > 0x20]
        if not rows:
            continue
        block = Block([r.item_id for r in rows], [r.text for r in rows], vocab, df, n, size, answer, rank)
        block.finish(_sketch(hits, block), n)
        out = out.unionByName(_search(hits, block, cosine))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item. Rows are told by doc_id and text, so that one doc_id may have several."""
    mark = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = matches(docs.select(mark.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(found, mark == F.col("__leak"), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"))
