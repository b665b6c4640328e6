from __future__ import annotations

import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, language_id, markup, ngram_jaccard, quality_classifier, quality_rules, sentence_pieces, suffix_dedup, token_ids, toxicity, warc
from tessera.llm.text import Table, UnitCache, column, hash_spans

SF = "/root/testdata/sf0.001"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "ÉTÉ", "naïve", "x", "Yy"]


def words(rng, n, vocab=WORDS):
    return " ".join(rng.choice(vocab) for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, copies, near copies, repeated ids and control characters."""
    rng = random.Random(4)
    base = [f"{w}{i}" for i in range(60) for w in ("a", "b")]
    long = words(rng, 3000, base)
    near = long.split()
    near[100] = "changed"
    t = [None, "", " \n\t ", "one two", "one  two", "One TWO\n", words(rng, 80, base), long, long, " ".join(near), "a" * 500, "line\nline\n\nline", "\x1c\x00 odd space ▁ 😀 <|endoftext|> it's", words(rng, 5), "x y z"]
    rows = [(i if i != 4 else 3, x, None if i % 3 else "en", f"s{i % 2}", len(x or ""), i) for i, x in enumerate(t)]
    return [*rows, (None, long, "en", "s0", 1, 99), (None, None, None, None, None, None), rows[7]]


def odd(spark):
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long, n long").repartition(3)


def empty(spark):
    return odd(spark).limit(0)


def key(r):
    return (r[0] is None, r[0] or 0, str(r))


# --- token ids


@pytest.mark.parametrize("bits", [1, 8])
def test_token_segments_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 9, 70_000):
        ids = rng.integers(0, 50_000, n)
        ends = np.array([0, n // 2, n], np.int64)
        data = token_ids.pack(ids, ends, bits=bits, block=4096)
        got, e = token_ids.unpack(data)
        assert (got == ids).all() and (e == ends).all()
        if n > 5000:
            assert (token_ids.unpack(data, 1)[0] == ids[4096:8192]).all()


def test_token_ids_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_ids.byte_bpe_path())
    path = f"file://{tmp_path}/ids"
    token_ids.write(odd(spark), path, token_ids.byte_bpe_path(), segment_ids=500, block=64)
    got = sorted((tuple(r) for r in token_ids.digests(spark, path).collect()), key=lambda r: r[1])
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]
        assert g == (r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_ids.read(spark, path).select(F.sum(F.size("ids"))).first()[0] == start
    token_ids.write(empty(spark), path + "0", token_ids.byte_bpe_path())
    assert token_ids.digests(spark, path + "0").count() == 0


ODD_CHARACTERS = ["a", "b", "c", "d", "'", "'s", "'ll", "\u200b", "\u007f", "\u001c", "\u001f", "\u2028", "\u0085", "\u00a0", "\u3000", "\u1680", "\n", "\r", "\t", " ", "  ", ".", "#", ",", "é", "Ã", "×", "中", "😀", "1", "٣", "<|endoftext|>", "A", "\u0300", "ß"]


def thue_morse(n=10):
    """Two words whose polynomial sums modulo 2**64 are equal for every base."""
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return [x, x.translate(str.maketrans("ab", "ba"))]


def encoded(encoder, texts):
    ids, io = encoder.encode(*column(pa.record_batch([pa.array(texts, pa.large_string())], ["text"])))
    return [ids[a:b].tolist() for a, b in zip(io, io[1:], strict=False)]


def test_token_ids_of_odd_characters_equal_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    tok, own = Tokenizer.from_file(token_ids.byte_bpe_path()), token_ids.Encoder(token_ids.byte_bpe_path())
    texts = ["".join(rng.choice(ODD_CHARACTERS) for _ in range(rng.randint(0, n))) for n in (6, 12, 40) for _ in range(4000)]
    texts += ["d\n 'ab.\tb#\u200b\n", "\nbe\u200bc\tc' c\u200b\n", "cff0ba\u200b.#c'a", "a' .e'\nd,'c "]
    for batch in (texts, thue_morse(), texts[::-1]):
        assert encoded(own, batch) == [[*e.ids, 2] for e in tok.encode_batch(batch, add_special_tokens=False)]


def test_unit_cache_tells_units_of_one_hash_apart():
    cache = UnitCache(lambda b, s, e: (np.concatenate([b[x:y] for x, y in zip(s, e, strict=True)]).astype(np.int32), e - s))
    buf, starts, ends = np.frombuffer(b"aabbaabcaa", np.uint8), np.array([0, 2, 4, 7]), np.array([2, 4, 7, 10])
    for _ in range(2):
        rows = cache.lookup(buf, starts, ends, np.array([1, 1, 1, 2], np.uint64))
        assert [bytes(cache.ids[cache.offs[i] : cache.offs[i + 1]].astype(np.uint8)) for i in rows] == [b"aa", b"bb", b"aab", b"caa"]


def test_hashes_tell_thue_morse_words_apart():
    buf, offs = column(pa.record_batch([pa.array(thue_morse(12), pa.large_string())], ["text"]))
    h = hash_spans(buf, offs[:-1], offs[1:])
    assert h[0] != h[1]


def test_table_finds_what_bisection_finds():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        asked = np.concatenate((keys[::2], rng.integers(0, 1 << 64, 50, dtype=np.uint64), keys, np.zeros(1, np.uint64)))
        hit, at = Table(keys).find(asked)
        want = [(i, int(np.searchsorted(keys, x))) for i, x in enumerate(asked) if x in keys]
        assert list(zip(hit.tolist(), at.tolist(), strict=True)) == want


# --- sentence pieces


def test_pieces_equal_the_library():
    import sentencepiece as sp

    m, lib, rng = sentence_pieces.model(sentence_pieces.piece_bpe_path()), sp.SentencePieceProcessor(model_file=sentence_pieces.piece_bpe_path()), random.Random(2)
    texts = ["".join(rng.choice("aabcdehtinosr  \n\tàé▁中😀0.1!_ATñ") for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["", " ", " " * 70, "x" * 400, *thue_morse()]
    texts += ["".join(rng.choice(ODD_CHARACTERS) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    buf, offs = column(pa.record_batch([pa.array(texts)], ["text"]))
    ids, io = m.encode(buf, offs)
    assert [ids[a:b].tolist() for a, b in zip(io, io[1:], strict=False)] == lib.encode(texts)


def test_long_units_equal_the_library():
    import sentencepiece as sp

    m, lib, rng = sentence_pieces.model(sentence_pieces.piece_bpe_path()), sp.SentencePieceProcessor(model_file=sentence_pieces.piece_bpe_path()), random.Random(3)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(12_000)), "ab" * 5000, "x" * 9000, "".join(rng.choice("中文字é") for _ in range(3000))]
    ids, io = m.encode(*column(pa.record_batch([pa.array(texts)], ["text"])))
    assert [ids[a:b].tolist() for a, b in zip(io, io[1:], strict=False)] == lib.encode(texts)
    for t in texts[:2]:
        assert [m.id_of[x] for x in m._merge("▁" + t)] == lib.encode(t)


def test_pieces_over_odd_rows(spark):
    path = sentence_pieces.piece_bpe_path()
    got = sentence_pieces.encode(odd(spark), path)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.round_trip) for r in got.collect() if not r.round_trip) == [(False, 12, False)]
    back = sentence_pieces.decode(got, path)
    assert sorted((r[1] or "" for r in odd_rows() if "▁" not in (r[1] or ""))) == sorted(r.text or "" for r in back.collect() if "😀" not in r.text)
    assert sentence_pieces.encode(empty(spark), path).count() == 0


# --- quality rules


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    cover = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_ledger_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [words(rng, n, WORDS[:4]) + rng.choice(["", "\n", " ## $"]) for n in range(60)] + [r[1] for r in odd_rows()]
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(texts)], "doc_id long, text string, words string, n_words int")
    got = quality_rules.ledger(df).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [brute_rules(x) for x in texts]
    kept = quality_rules.accepted(df, "v2")
    assert kept.columns == df.columns
    assert kept.count() == quality_rules.apply_policy(quality_rules.ledger(df), "v2").where("kept").count()
    a = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(df), "v2").collect()}
    assert a["few_words"].failed == sum(brute_rules(x)[0] < 50 for x in texts)
    assert quality_rules.ledger(empty(spark)).count() == 0


# --- Jaccard join


def brute_components(rows):
    sets = []
    for _, x, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=key)


def near_rows(seed, n=90):
    rng, vocab, out = random.Random(seed), [f"w{i}" for i in range(300)], []
    seeds = [[rng.choice(vocab) for _ in range(rng.choice([6, 30, 60]))] for _ in range(8)]
    for i in range(n):
        x = list(rng.choice(seeds)) if rng.random() < 0.7 else [rng.choice(vocab) for _ in range(40)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            x[rng.randrange(len(x))] = rng.choice(vocab)
        out.append((i, " ".join(x)))
    return out


@pytest.mark.parametrize("part", [4_000_000, 60])
def test_jaccard_components_equal_brute_force(spark, part):
    rows = near_rows(5) + [(1000 + i, x) for i, x in enumerate(thue_morse())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_jaccard.classes(df, part_hashes=part).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)


def test_merge_skip_counts_like_a_counter():
    rng = random.Random(4)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(1, 25))) for _ in range(rng.randint(1, 12))]
        least = rng.randint(1, 6)
        counts = Counter(v for x in lists for v in x)
        assert ngram_jaccard.merge_skip(lists, least) == sorted((v, n) for v, n in counts.items() if n >= least)


def test_link_groups_equal_all_pairs():
    rng = np.random.default_rng(7)
    for _ in range(20):
        base = [np.sort(rng.choice(400, 40, replace=False)) for _ in range(4)]
        sets = [np.unique(np.concatenate((b[rng.random(40) > 0.1], rng.choice(400, rng.integers(0, 4))))) for b in base for _ in range(12)]
        sizes = np.array([len(x) for x in sets])
        found = ngram_jaccard.link_group(np.arange(len(sets)), sizes, sets, 80)
        up = list(range(len(sets)))

        def find(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in found:
            up[find(a)] = find(b)
        for i, x in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(x, sets[j]))
                if 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                    assert find(i) == find(j)


def test_jaccard_odd_rows(spark):
    got = sorted((tuple(r) for r in ngram_jaccard.classes(odd(spark)).select("doc_id", "n_shingles", "component_id").collect()), key=key)
    assert got == brute_components(odd_rows())
    assert ngram_jaccard.classes(empty(spark)).count() == 0


def test_link_group_near_copies_need_no_pairs():
    rng = np.random.default_rng(2)
    base = np.arange(200, dtype=np.int64)
    sets = [np.unique(np.where(rng.random(200) < 0.03, rng.integers(1000, 9000, 200), base)) for _ in range(150)]
    links = ngram_jaccard.link_group(np.arange(150), np.array([len(s) for s in sets]), sets, 80)
    assert len(links) <= 149


# --- suffix arrays


@pytest.mark.parametrize("few", [0, 3, 4096])
def test_suffix_array_orders_suffixes(few):
    rng = random.Random(6)
    for alphabet, n in (("ab", 60), ("abcd", 200), ("a", 40), ("abracad", 500), ("ab", 1), ("a", 0)):
        t = np.array([*(ord(rng.choice(alphabet)) for _ in range(n)), 0], np.int32)
        t = np.concatenate((t[:-1], t[:-1], t[-1:]))
        sa = suffix_dedup.suffix_array(t, few)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        common = suffix_dedup.permuted_prefixes(t, sa)
        for i, j in zip(sa[:-1], sa[1:], strict=True):
            assert common[j] == next(m for m in range(len(t)) if t[i + m : i + m + 1] != t[j + m : j + m + 1])


def brute_removed(rows, length=50):
    first = {}
    data = [(i, (x or "").encode()) for i, x, *_ in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            if i is not None:
                first[b[p : p + length]] = min(i, first.get(b[p : p + length], i))
    out = []
    for i, b in data:
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                m[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        out.append((i, len(b), sum(m), sum(1 for q in range(len(m)) if m[q] and (q == 0 or not m[q - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def test_suffix_dedup_lets_strings_go_before_runs_are_dealt(spark, monkeypatch):
    """Runs, strings and both of their shuffles at once were the largest share of the disk."""
    saved, gone, kept = suffix_dedup.store.saved, [], []
    monkeypatch.setattr(suffix_dedup.store, "drop", lambda *dfs, drop=suffix_dedup.store.drop: (gone.extend(x.saved_path for x in dfs), drop(*dfs)))

    def watched(df, name):
        if name == "suffix-spans":
            assert not [x for x in kept if "suffix-strings" in x and x not in gone]
        out = saved(df, name)
        kept.append(out.saved_path)
        return out

    monkeypatch.setattr(suffix_dedup.store, "saved", watched)
    line = "the same passage of more than fifty bytes stands in both of these documents"
    got = suffix_dedup.spans(spark.createDataFrame([(1, line), (2, "x " + line)], "doc_id long, text string")).collect()
    assert [(r.doc_id, min(x.lo for x in r.spans), max(x.hi for x in r.spans)) for r in got] == [(2, 2, 2 + len(line))]
    assert any("suffix-strings" in x for x in kept) and set(kept) - set(gone) == {x for x in kept if "suffix-spans" in x}


def test_names_that_differ_are_not_sorted_again(monkeypatch):
    """Doubling sorted all suffixes in each round, though a few long repeats are all that needs the later ones."""
    rng = np.random.default_rng(3)
    names = np.append(np.concatenate([part := rng.permutation(3000) + 1, part[:64], rng.permutation(3000) + 4000]), 0)
    sorted_, argsort = [], np.argsort
    monkeypatch.setattr(suffix_dedup.np, "argsort", lambda x, *a, **b: (sorted_.append(len(x)), argsort(x, *a, **b))[1])
    got = suffix_dedup._by_doubling(names)
    assert got.tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())
    assert sum(sorted_) < 2 * len(names)


@pytest.mark.parametrize("length", [5, 8, 13, 50])
def test_shared_windows_equal_brute_force(length):
    rng = random.Random(length)
    strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 12))) + rng.choice([b"ab" * 40, b"\x00" * 60, b"abb\xff" * 20])[: rng.randint(length, 60)] for _ in range(60)]
    docs = np.array([rng.randint(0, 20) for _ in strings])
    which, inner, best = suffix_dedup.shared_windows(np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings]), docs, length)
    least = {}
    for x, d in zip(strings, docs.tolist(), strict=True):
        for p in range(len(x) - length + 1):
            least[x[p : p + length]] = min(d, least.get(x[p : p + length], d))
    assert [(w, i) for w, i in zip(which.tolist(), inner.tolist(), strict=True)] == [(w, p) for w, x in enumerate(strings) for p in range(len(x) - length + 1)]
    assert best.tolist() == [least[x[p : p + length]] for x in strings for p in range(len(x) - length + 1)]


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    passages = [words(rng, 14) for _ in range(5)] + ["é" * 40, "ab" * 60]
    rows = [*odd_rows(), *((100 + i, words(rng, rng.randint(0, 12)) + rng.choice(passages)[rng.randint(0, 9) :] + words(rng, 6) + rng.choice(passages), "en", "s", 1, 1) for i in range(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hashes long").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.dedup(df).drop("kept").collect()), key=key)
    assert got == brute_removed(rows)
    split = [(r.doc_id, [tuple(x) for x in r.spans]) for r in suffix_dedup.spans(df, anchor_bytes=200).collect()]
    whole = [(r.doc_id, [tuple(x) for x in r.spans]) for r in suffix_dedup.spans(df).collect()]

    def cover(rows):
        return sorted((i, sorted({b for lo, hi in x for b in range(lo, hi)})) for i, x in rows)

    assert cover(split) == cover(whole)
    left = suffix_dedup.without_repeats(df)
    assert left.columns == df.columns and left.where("n_chars <> length(text)").count() == 0
    assert suffix_dedup.dedup(empty(spark)).count() == 0


# --- decontamination


def test_leaks_and_paraphrases(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(800)]
    items = [words(rng, 30, vocab) for _ in range(12)]
    docs = [words(rng, 150, vocab) for _ in range(60)]
    for k in range(12):
        x = items[k].split()
        if k % 2:
            for p in rng.sample(range(20), 5):
                x[p] = rng.choice(vocab)
        d = docs[k].split()
        docs[k] = " ".join([*d[: 40 + k], *x, *d[40 + k :]])
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(docs)] + [(77, None, None), (78, "", None), (0, docs[0], "again")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(items)] + [(50, None), (51, ""), (52, "!!")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect())
    assert got == sorted([(k, k) for k in range(12)] + [(0, 0)])
    two = sorted((r.doc_id, r.item_id) for r in decontaminate.matches(df, bench, block_items=5).collect())
    assert two == got
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.matches(empty(spark), bench).count() == 0


def test_long_items_are_found_at_every_alignment(spark):
    rng = random.Random(2)
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in (66, 176, 300, 1000)}
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    docs, want = [], []
    for n, x in items.items():
        for k in range(32):
            filler = [f"f{rng.randrange(3000)}" for _ in range(200)]
            docs.append((n * 100 + k, " ".join([*filler[: 64 + k], *x, *filler[64 + k :]])))
            want.append((n * 100 + k, n))
    docs += [(5, " ".join(items[300][:150])), (6, " ".join(f"f{rng.randrange(3000)}" for _ in range(2000)))]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == want and {r.lcs for r in got} == {1.0}


def test_no_verbatim_leak_of_a_large_benchmark_is_lost(spark):
    rng = random.Random(1)
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").orderBy("doc_id").collect()]
    texts = [x for x in texts if len(x) > 100]
    docs, items = [], []
    for i in range(1000):
        x, d, n = rng.choice(texts), rng.choice(texts), rng.randint(12, 58)
        a, b = rng.randrange(len(x) - n), rng.randrange(len(d))
        items.append((i, " ".join(x[a : a + n])))
        docs.append((i, " ".join([*d[max(0, b - 100) : b], *x[a : a + n], *d[b : b + 100]])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(df, bench).where("doc_id = item_id").count()
    assert got >= 999, got


def test_common_subsequence_equals_dynamic_program():
    rng = random.Random(1)
    vocab = np.unique(decontaminate.words_of(*column(pa.record_batch([pa.array(["a b c d e"], pa.large_string())], ["text"])))[0])
    b = decontaminate.Block([1], ["a b c d e a b"], vocab, np.zeros(5, np.int64), 1, 8, 3, 4)
    b.finish(np.zeros((5, 4)) + np.eye(5, 4), 1)
    for _ in range(200):
        x, y = b.items[0].tolist(), [rng.randrange(b.terms) for _ in range(rng.randint(0, 12))]
        row = [0] * (len(x) + 1)
        for w in y:
            last = 0
            for j, v in enumerate(x, 1):
                last, row[j] = row[j], last + 1 if v == w else max(row[j], row[j - 1])
        assert b.common(0, y) == row[-1]


# --- classifiers


def labelled_docs(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = words(rng, 60).split()
        if bad:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["nasty", "vile", "rotten"])
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(not bad), int(bad)))
    docs += [(900, None, None), (901, "", None), (902, "nasty vile rotten", None), (None, "nasty", None)]
    return spark.createDataFrame(docs, "doc_id long, text string, label string"), spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_finds_held_out_labels(spark):
    docs, labels = labelled_docs(spark)
    index = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i].score >= 0.3) == (i % 4 == 0) for i in held) > 0.97 * len(held)
    assert got[902].score > 0.9 and 0 <= got[900].score == got[901].score < 0.3 and set(got[902].nearest) <= set(range(600))
    assert toxicity.score(empty(spark), toxicity.fit(docs, labels.limit(0))).count() == 0


@pytest.mark.parametrize("most", [0, 3, 10_000])
def test_block_max_search_is_exact(most):
    rng = np.random.default_rng(0)
    terms, examples, k = 60, 700, 16
    weights = np.where(rng.random((terms, examples)) < rng.choice([0.02, 0.3, 0.8], (terms, 1)), rng.random((terms, examples)), 0).astype(np.float32)
    weights[:, 300:330] = weights[:, 299:300]  # ties
    t, col = np.nonzero(weights)
    lists = toxicity.Postings(terms, examples, t, col, weights[t, col], most=most)
    docs = np.where(rng.random((40, terms)) < 0.2, rng.random((40, terms)), 0).astype(np.float32)
    docs[0], docs[1] = 0, weights[:, 300]
    row, term = np.nonzero(docs)
    index = toxicity.Index(np.arange(terms, dtype=np.uint64), np.ones(terms), np.arange(examples), rng.integers(0, 2, examples).astype(float), lists, 0.1, 0.2, k=k)
    vote, near, cosines, cut = index.votes(row, term, docs[row, term], 40)
    for i in range(40):
        every = docs[i] @ weights
        kth = np.sort(every)[-k]
        want = np.flatnonzero((every >= kth - 1e-6) & (every > 1e-6))
        assert sorted(near[cut[i] : cut[i + 1]].tolist()) == want.tolist()
        assert np.allclose(cosines[cut[i] : cut[i + 1]], np.sort(every[want])[::-1], atol=1e-5)
    assert np.isnan(vote[0]) and cut[2] - cut[1] >= 31


def test_toxicity_scores_equal_brute_force(spark):
    docs, labels = labelled_docs(spark)
    index = toxicity.fit(docs, labels)
    rows = [r for r in docs.collect() if r.doc_id is not None]
    terms = lambda x: [y for w in re.findall(rb"[0-9a-z\x80-\xff]+", (x or "").encode().lower()) for y in ([w, b"^" + w[:5]] if len(w) > 5 else [w])]
    bags = {r.doc_id: defaultdict(int) for r in rows}
    for r in rows:
        for w in terms(r.text):
            bags[r.doc_id][w] += 1
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id is not None}
    known = [i for i in bags if i in toxic and zlib.crc32(str(i).encode()) % 4 != 2]
    vocab = {w for i in known for w in bags[i]}
    df, n = defaultdict(int), docs.count()
    for r in docs.collect():
        for w in set(terms(r.text)):
            df[w] += 1

    def vector(bag):
        v = {w: (1 + np.log(c)) * (np.log((1 + n) / (1 + df[w])) + 1) for w, c in bag.items() if w in vocab}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(bags[i]) for i in bags}
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    prior = (sum(toxic[i] for i in known) + 1) / (len(known) + 2)
    for i in [*range(0, 600, 7), 902]:
        cos = sorted(((sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), j) for j in known), reverse=True)
        voters = [(c, j) for c, j in cos if c >= cos[15][0] - 1e-6 and c > 1e-6]
        vote = (sum(c * toxic[j] for c, j in voters) + 0.5 * prior) / (sum(c for c, _ in voters) + 0.5)
        assert abs(float(index.scores(np.array([vote]))[0]) - got[i].score) < 1e-3
        near = {j for c, j in cos if c >= cos[15][0] + 1e-5 and c > 1e-5}
        assert near <= set(got[i].nearest) <= {j for c, j in cos if c >= cos[15][0] - 1e-5}


def test_copy_of_an_example_with_rare_words_is_found(spark):
    docs, labels = labelled_docs(spark)
    i = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 4 != 2)
    rare = "qworm zleech oncemet words"
    docs = docs.unionByName(spark.createDataFrame([(i, rare, "x"), (5000, rare, "x")], docs.schema))
    index = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(i, 0, 1)], labels.schema)))
    got = {r.doc_id: r for r in toxicity.score(docs, index).where("doc_id = 5000").collect()}[5000]
    assert got.nearest[0] == i and abs(got.cosines[0] - 1) < 1e-5 and got.score >= 0.3


def test_quality_classifier(spark):
    rng = random.Random(5)
    docs = [(i, words(rng, 60) if i % 3 else " ".join(w.upper() + "!!" for w in words(rng, 40).split())) for i in range(400)]
    df = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in docs], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.score(df, quality_classifier.fit(df, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 3 > 0) for i in held) > 0.97 * len(held) and got[900] == got[901]
    none = quality_classifier.fit(df, labels.limit(0))
    assert {r.score for r in quality_classifier.score(df, none).collect()} == {0.5}


def test_language_by_evidence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.lang: r.text for r in docs.where("n_chars > 300").collect()}
    page = lambda lang, said: f"<html lang='{said}'><body><p>{texts[lang][:400]}</p></body></html>"
    rows = [(i, "http://a.example.com/x", page("fr", "fr")) for i in range(5)] + [(10, "http://a.example.com/y", page("de", "fr")), (11, "http://a.example.com/z", None), (12, None, page("es", "xx")), (13, "odd", "")]
    pages = spark.createDataFrame([(*r, "host") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in language_id.identify(pages, docs).collect()}
    assert (got[0].lang, got[10].lang, got[10].text_lang, got[11].lang, got[12].lang) == ("fr", "de", "de", "fr", "es") and len(got) == len(rows)
    assert all(0 < r.confidence <= 1 for r in got.values())
    assert language_id.identify(pages.limit(0), docs).count() == 0 and language_id.identify(pages, docs.limit(0)).count() == len(rows)


# --- WARC


def test_warc_records_link_and_keep_digests(spark):
    pages = spark.createDataFrame([(1, "http://a/ b", "<html lang=en><title>T &amp; x</title><script>no</script><p>Hi <b>you</b><p>there</html>", 1), (2, None, None, 1), (2, None, None, 1), (None, "u\r\nX: y", "é", 1)], "page_id long, url string, html string, data int")
    source = warc.responses(pages)
    made = warc.derive(source)
    info = warc.summaries(source.unionByName(made)).collect()
    assert len(info) == 12 and all(r.intact for r in info)
    ids = {r.record_id for r in info if r.kind == "response"}
    assert all(r.refers_to in ids for r in info if r.kind != "response")
    digest = {r.record_id: r.payload_digest for r in info if r.kind == "response"}
    assert all(r.source_digest == digest[r.refers_to] for r in info if r.kind != "response")
    text = next(warc.parse(gzip.decompress(r.data))[1] for r in made.collect() if r.kind == "conversion" and r.source_key == 1)
    assert text.decode() == "T & x\nHi you\nthere"
    assert warc.derive(spark.createDataFrame([(1, b"junk"), (2, None)], "source_key long, data binary")).count() == 0
    assert warc.summaries(warc.derive(warc.responses(pages.limit(0)))).count() == 0


def test_malformed_records_are_marked(spark):
    good = warc.response(1, "http://x", "<p>hi", "2026-01-01T00:00:00Z")
    bad = [good.replace(b"Content-Length: ", b"Content-Len: ", 1), re.sub(rb"WARC-Record-ID: [^\r]*\r\n", b"", good), gzip.compress(good)[:40], re.sub(rb"Content-Length: \d+", b"Content-Length: 99999", good, count=1)]
    rows = [(0, good), *((i + 1, x) for i, x in enumerate(bad)), (9, b"junk"), (10, None), (11, good.replace(b"WARC-Type: response", b"WARC-Type: request"))]
    made = warc.derive(spark.createDataFrame(rows, "source_key long, data binary"))
    got = sorted((r.source_key, r.kind) for r in made.collect())
    assert got == [(0, "conversion"), (0, "metadata"), (1, "malformed"), (2, "malformed"), (3, "malformed"), (4, "malformed")]
    assert sorted((r.source_key, r.intact) for r in warc.summaries(made).collect()) == [(0, True), (0, True), (1, False), (2, False), (3, False), (4, False)]


def test_pages_are_decoded_as_declared():
    page = "<html><p>été naïve 中</html>"
    assert warc.decoded({"content-type": "text/html; charset=utf-8"}, page.encode()) == page
    assert warc.decoded({"content-type": 'text/html; charset="ISO-8859-1"'}, "été".encode("latin-1")) == "été"
    assert warc.decoded({}, '<meta charset="gb18030">中'.encode("gb18030")).endswith("中")
    assert warc.decoded({"content-encoding": "gzip"}, gzip.compress(page.encode())) == page
    assert warc.decoded({"content-encoding": "deflate"}, zlib.compress(page.encode())) == page
    assert warc.decoded({"transfer-encoding": "chunked"}, b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n") == "abcde"
    assert warc.decoded({"content-type": "text/html; charset=no-such", "content-encoding": "gzip"}, b"ab\xff") == "ab\ufffd"


@pytest.mark.parametrize("piece", ["<p ", "<a ", "<title>", "<html ", "<!--", "<script ", "</script ", "<nav ", "<a href", " lang", "<html lang ", "&", "<p title='"])
def test_hostile_pages_take_linear_time(piece):
    page = piece * (10_000_000 // len(piece))
    began = time.process_time()
    markup.plain(page, main_only=True), markup.declared_language(page), markup.title(page), markup.links(page)
    assert time.process_time() - began < 30


def test_language_is_found_behind_a_long_head():
    assert markup.declared_language("<!--" + "x" * 5000 + " <html lang=xx> --><html class=a lang='DE-de'>") == "de"
    assert markup.declared_language("<html data-lang=fr><p lang=es>") is None


def test_every_language_is_a_class(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocab = {f"l{i:02d}"[:3]: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(12)] for i in range(45)}
    docs = [(n * 100 + i, words(rng, 60, v), lang) for n, (lang, v) in enumerate(vocab.items()) for i in range(3 + n % 2)]
    names, logp = language_id.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), per_language=2)
    assert names == sorted(vocab) and np.allclose(np.exp(logp.astype(float)).sum(axis=1), 1, atol=1e-3)
    pages = spark.createDataFrame([(n, f"http://h{n}.x/", f"<p>{words(rng, 200, v)}</p>") for n, v in enumerate(vocab.values())], "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in language_id.identify(pages, spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert [got[n] for n in range(45)] == list(vocab)


# --- components and pipeline


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def brute_kept(rows):
    """Rows that no rule of policy v2 rejects."""
    out = []
    for r in rows:
        text = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, chars, symbols, repeated_lines, repeated = brute_rules(text)
        shouted = sum(len(x) > 1 and x.upper() == x and x.lower() != x for x in w)
        bad = [n < 50, 100 * repeated > 50 * n, 10 * symbols > n, len(lines) >= 5 and 100 * repeated_lines > 40 * len(lines), chars < 2 * n or chars > 12 * n, 2 * shouted > n]
        if not any(bad):
            out.append(r)
    return out


def brute_first(rows):
    """Of each component of near copies the row with the smallest doc_id."""
    best = {}
    for r, (i, n, c) in zip(sorted(rows, key=key), brute_components(rows), strict=True):
        assert r[0] == i
        place = c if n else (r[0], r[1])
        if n == 0 or r[0] == c:
            best.setdefault(place, r)
    return list(best.values())


def brute_cut(rows, length=50):
    """Rows with their text left by the removal of repeated byte strings."""
    first, out = {}, []
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(i, first.get(b[p : p + length], i))
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not any(gone) or left.strip():
            out.append((i, left))
    return out


def brute_leaks(rows, items, size=64):
    """doc_ids of rows of which some window passes the checks against some item (none longer than a passage)."""
    words_in = lambda x: re.findall(rb"[0-9a-z\x80-\xff]+", (x or "").encode().lower())
    docs, half = [(i, words_in(x)) for i, x in rows], size // 2
    starts = [range(0, max(1, -(-len(w) // half) - 1) * half, half) for _, w in docs]
    n, df = 0, Counter()
    for (_, w), s in zip(docs, starts, strict=True):
        n += len(s)
        for lo in s:
            df.update(set(w[lo : lo + size]))
    items = [w for w in map(words_in, items) if w]
    assert max(map(len, items)) <= size
    live = {w for x in items for w in x if df[w] * 50 <= n}
    for x in items:
        live |= set(sorted(set(x), key=lambda w: df[w])[:16])
    weight = lambda w: np.log((2 + n) / (1 + df[w])) if w in live else 0.0

    def common(x, y):
        row = [0] * (len(x) + 1)
        for w in y:
            last = 0
            for j, v in enumerate(x, 1):
                last, row[j] = row[j], last + 1 if v == w else max(row[j], row[j - 1])
        return row[-1]

    out = set()
    for x in items:
        total = sum(weight(w) for w in set(x))
        for (i, w), s in zip(docs, starts, strict=True):
            for lo in s:
                window = w[max(0, lo - half) : lo + size + half]
                if sum(weight(v) for v in set(x) & set(window)) < 0.6 * total:
                    continue
                share = common(x, window) / len(x)
                if share >= 0.8 or share >= 0.55 and common(x[-5:], window) >= 0.6 * len(x[-5:]):
                    out.add(i)
    return out


def test_pipeline_equals_brute_force(spark):
    import sentencepiece as sp

    import corpus_pipeline as C

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = brute_cut(brute_first(brute_kept(rows)))
    leaks = brute_leaks(rows, items)
    assert leaks
    lib = sp.SentencePieceProcessor(model_file=sentence_pieces.piece_bpe_path())
    want = sorted((i, lib.encode(x)) for i, x in rows if i not in leaks)
    assert sorted((r.doc_id, r.ids) for r in C.run(spark, SF).collect()) == want


def test_stages_take_odd_rows(spark):
    import corpus_pipeline as C

    long = words(random.Random(1), 120, [f"q{i}" for i in range(90)])
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    extra = [(3, long, "en", "s", 1, 1), (3, long + " " + item, "en", "s", 1, 1), (None, item, "x", "y", 2, 2)]
    df = odd(spark).unionByName(spark.createDataFrame(extra, odd(spark).schema)).withColumn("mark", F.lit("clash")).withColumn("leak_id", F.lit(3))
    for _, stage in C.STAGES[:-1]:
        got = stage(spark, df, SF)
        assert got.columns == df.columns and stage(spark, df.limit(0), SF).count() == 0
        n = got.count()
        assert 0 < n <= df.count()
    clean = C.benchmark_leaks(spark, df, SF)
    assert clean.where(F.col("text") == long).count() == 1 and clean.where(F.col("text").contains(item)).count() == 0
    assert clean.count() == df.count() - 2
    once = C.near_duplicates(spark, df, SF).collect()
    assert len({(r.doc_id, r.text) for r in once}) == len(once)
    assert len([r for r in once if r.text and r.text.startswith("a0 ") or r.text == long]) >= 1
