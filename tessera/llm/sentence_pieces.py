"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

Texts are cut into units between characters that stand together in no piece, such as a letter and the space after it;
a piece can't cross such a cut. Each distinct unit of a batch is segmented once. Units of equal length form a matrix of code points and advance together,
one character a step: hashes of the substrings that end there, from running sums, probe the sorted hashes of all
pieces; each hit extends the best path of the shorter prefix; the maximum over the hits is stored as backpointer.

The score of a step depends on the model. A unigram model adds the piece's score. A BPE model, for which a sum of
scores gives other ids than the library, uses that a prefix has one BPE segmentation: a step is admitted only if its
piece is the segmentation of its own text and, beside the last piece of the prefix, of the two texts together. One
step is admitted at each prefix, and the path equals the library's merges. Both give the library's ids.

A very long unit, such as letters without a break, takes one numpy step a character, and, should no path be admitted, a
heap of merges: time grows with its length alone.

Null or empty texts have no ids. Characters without a piece become byte pieces, or the unknown id in a model without
them. U+2581 in a text is the same as a space, as in the library; only such texts do not come back unchanged. Any
other columns, ties and repeated rows are kept as they are; rows are independent.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .text import UnitCache, chunks, column, gather, lists, mix, powers, trimmed

MARK = "▁"
_STEP = 0xC2B2AE3D27D4EB4F
_BACK = pow(_STEP, -1, 1 << 64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """The pieces of a model file as sorted 64-bit keys, and the two passes over them."""

    def __init__(self, path: str, unit_limit: int = 2_000_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are")
        self.bpe, self.prefix = proto.trainer_spec.model_type == 2, spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.n = len(self.pieces)
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        own = [i for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        self.rank = {self.pieces[i]: np.float32(proto.pieces[i].score) for i in own}
        self.id_of = {self.pieces[i]: i for i in own}
        self.longest = max(map(len, self.rank))
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.has_bytes = any(p.type == 6 for p in proto.pieces)
        # Between two characters that stand together in no piece a text can be cut: bytes that may meet in a piece.
        self.joined = np.zeros(1 << 16, bool)
        forms = {MARK: (b" ", MARK.encode())}
        for a, b in {(p[i], p[i + 1]) for p in self.rank for i in range(len(p) - 1)}:
            for x in forms.get(a, (a.encode(),)):
                for y in forms.get(b, (b.encode(),)):
                    self.joined[x[-1] * 256 + y[0]] = True
        # Pieces that BPE never yields for their own text can't be steps.
        steps = [i for i in own if not self.bpe or len(self.pieces[i]) == 1 or self._merge(self.pieces[i]) == [self.pieces[i]]]
        keys = np.array([self._hash(_codes(self.pieces[i])) for i in steps], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(steps, np.int64)[order]
        self.scores = np.full(self.n + 1, -1e4, np.float64)
        self.scores[own] = [proto.pieces[i].score for i in own]
        self.pair_keys, self.pair_ok = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        raw = [b"" if p.type in (2, 3) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        raw[self.unknown] = " ⁇ ".encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_offs = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        self.cache = UnitCache(self._encode_units, unit_limit)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.uint64:
        return np.sum(mix(codes.astype(np.uint64) + np.uint64(77)) * powers(_STEP, len(codes)), dtype=np.uint64)

    def _merge(self, text: str) -> list[str]:
        """BPE over a text by its definition: the best pair first, the leftmost of equal ones. Pairs wait in a heap; those
        of which a part has changed meanwhile are passed over."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if j < len(parts):
                r = self.rank.get(parts[i] + parts[j])
                if r is not None:
                    heapq.heappush(heap, (-r, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _apart(self, a: str, b: str) -> bool:
        """Whether BPE of both texts together gives the two pieces."""
        rank = self.rank
        if not any(x[-i:] + y[:j] in rank for x, y in ((a, b),) for i in range(1, len(a) + 1) for j in range(1, min(len(b), self.longest - i) + 1)):
            return True
        return self._merge(a + b) == [a, b]

    def _admitted(self, before: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the two pieces apart; answers are kept in a direct-mapped table."""
        pair = before * (self.n + 1) + step
        slot = (mix(pair.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        ok = self.pair_ok[slot]
        miss = self.pair_keys[slot] != pair
        if miss.any():
            keys, back = np.unique(pair[miss], return_inverse=True)
            good = np.empty(len(keys), bool)
            for i, k in enumerate(keys.tolist()):
                a, b = divmod(k, self.n + 1)
                good[i] = self.n in (a, b) or self._apart(self.pieces[a], self.pieces[b])
            at = (mix(keys.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
            self.pair_keys[at], self.pair_ok[at] = keys, good
            # Of keys that share a slot the last one stays, with its own answer.
            self.pair_ok[at] = np.where(self.pair_keys[at] == keys, good, self.pair_ok[at])
            ok[miss] = good[back]
        return ok

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of equally long words (rows of code points), last first, -1 beyond the end; the number n of pieces stands for an unknown character. Second: rows without a path."""
        m, length = words.shape
        run = np.zeros((m, length + 1), np.uint64)
        np.cumsum(mix(words.astype(np.uint64) + np.uint64(77)) * powers(_STEP, length), axis=1, out=run[:, 1:])
        last = np.full((m, length + 1), -1, np.int64)
        back = np.zeros((m, length + 1), np.int64)
        best = np.full((m, length + 1), -np.inf)
        best[:, 0] = 0
        inverse = powers(_BACK, length + 1)
        for end in range(1, length + 1):
            lo = max(0, end - self.longest)
            probe = (run[:, end, None] - run[:, lo:end]) * inverse[lo:end]
            at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            step = np.where(self.keys[at] == probe, self.key_ids[at], -1)
            step[:, -1] = np.where(step[:, -1] < 0, self.n, step[:, -1])
            row, col = np.nonzero((step >= 0) & (best[:, lo:end] > -np.inf))
            s, prev = step[row, col], last[row, lo + col]
            if self.bpe:
                good = (prev < 0) | self._admitted(np.maximum(prev, 0), s)
                row, col, s = row[good], col[good], s[good]
                score = best[row, lo + col] + 1.0 / (1 + end - lo - col)
            else:
                score = best[row, lo + col] + self.scores[s]
            table = np.full((m, end - lo), -np.inf)
            table[row, col] = score
            pick = table.argmax(axis=1)
            best[:, end] = table[np.arange(m), pick]
            back[:, end] = end - lo - pick
            last[:, end] = step[np.arange(m), pick]
        out = np.full((m, length), -1, np.int64)
        pos, rows = np.full(m, length), np.arange(m)
        for k in range(length):
            live = pos > 0
            if not live.any():
                break
            out[live, k] = last[rows[live], pos[live]]
            pos = np.where(live, pos - back[rows, pos], 0)
        return out, np.flatnonzero(best[:, length] == -np.inf)

    def _encode_units(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = buf.tobytes()
        texts = [data[a:b].decode("utf-8", "replace").replace(" ", MARK) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        sizes = np.array([len(t) for t in texts], np.int64)
        codes, offs = _codes("".join(texts)), np.concatenate(([0], np.cumsum(sizes)))
        got: list = [None] * len(texts)
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, edges):
            length = int(sizes[group[0]]) if len(group) else 0
            for part in np.array_split(group, max(1, len(group) * length // 400_000)):
                if not len(part) or not length:
                    continue
                out, lost = self.viterbi(codes[offs[part][:, None] + np.arange(length)])
                count = (out >= 0).sum(axis=1)
                odd = (out == self.n).any(axis=1)
                odd[lost] = True
                flipped = out[:, ::-1]
                flat = flipped[flipped >= 0].astype(np.int32)
                cut = np.concatenate(([0], np.cumsum(count))).tolist()
                for k, i in enumerate(part.tolist()):
                    got[i] = flat[cut[k] : cut[k + 1]]
                lost_rows = set(lost.tolist())
                for k in np.flatnonzero(odd).tolist():
                    i = int(part[k])
                    got[i] = self._spelt(texts[i], None if k in lost_rows else got[i])
        return np.concatenate([np.zeros(0, np.int32), *got]), np.array([len(x) for x in got], np.int64)

    def _spelt(self, text: str, steps: np.ndarray | None) -> np.ndarray:
        """Ids with unknown characters as byte pieces; without steps, of the merges as defined."""
        if steps is None:
            parts = self._merge(text)
        else:
            parts, at = [], 0
            for s in steps.tolist():
                size = 1 if s == self.n else len(self.pieces[s])
                parts.append(text[at : at + size])
                at += size
        ids: list[int] = []
        for p in parts:
            if p in self.id_of:
                ids.append(self.id_of[p])
            elif self.has_bytes:
                ids.extend(self.byte_ids[list(p.encode())].tolist())
            else:
                ids.append(self.unknown)
        return np.array(ids, np.int32)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows and their offsets."""
        lens = np.diff(offs)
        if self.prefix:  # a space before every text that isn't empty
            put = lens > 0
            buf = np.insert(buf, offs[:-1][put], 0x20)
            offs = offs + np.concatenate(([0], np.cumsum(put)))
        n = len(buf)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        cut = (buf & 0xC0) != 0x80
        cut[1:] &= ~self.joined[buf[:-1].astype(np.int64) * 256 + buf[1:]]
        cut[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(cut)
        uoffs = np.searchsorted(starts, offs)
        rows = self.cache.lookup(buf, starts, np.append(starts[1:], n))
        at, ioffs = gather(rows, self.cache.offs)
        return self.cache.ids[at], ioffs[uoffs]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the rows and their offsets; the space that encode() puts first is taken away."""
        at, boffs = gather(ids.astype(np.int64), self.raw_offs)
        out, roffs = self.raw[at], boffs[offs]
        if self.prefix:
            first = roffs[:-1][np.diff(roffs) > 0]
            first = first[out[first] == 0x20]
            gone = np.zeros(len(out) + 1, np.int64)
            gone[first + 1] = 1
            out, roffs = np.delete(out, first), roffs - np.cumsum(gone)[roffs]
        return out, roffs


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model of this process, loaded once; it keeps the ids of units it has met."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str, *, check: bool = True) -> DataFrame:
    """doc_id, ids, n_ids and, with check, round_trip: whether decoding the ids gives the text again."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            buf, offs = column(batch)
            for i, j in chunks(offs, 1 << 20):
                part, po = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                ids, io = m.encode(part, po)
                cols = [batch.column(0).slice(i, j - i), lists(ids, io, pa.int32()), pa.array(np.diff(io), pa.int32())]
                if check:
                    out, oo = m.decode(ids, io)
                    was, now = part.tobytes(), out.tobytes()
                    cols.append(pa.array([was[a:b] == now[c:d] for a, b, c, d in zip(po[:-1].tolist(), po[1:].tolist(), oo[:-1].tolist(), oo[1:].tolist(), strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_ids", "round_trip"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(rows), "doc_id long, ids array<int>, n_ids int" + ", round_trip boolean" * check)


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of encoded documents (doc_id, ids); null ids give a null text, bytes that aren't UTF-8 U+FFFD."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            col = batch.column(1)
            offs = np.asarray(col.offsets).astype(np.int64)
            flat = np.asarray(col.flatten()).astype(np.int64)
            lens = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)).astype(np.int64)
            offs = np.concatenate(([0], np.cumsum(lens)))
            out, oo = m.decode(flat, offs)
            data = out.tobytes()
            live = np.asarray(col.is_valid())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b].decode("utf-8", "replace") if v else None for a, b, v in zip(oo[:-1].tolist(), oo[1:].tolist(), live.tolist(), strict=True)], pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(trimmed(rows), "doc_id long, text string")


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(store.table(spark, sf_dir, "documents"), piece_bpe_path())
