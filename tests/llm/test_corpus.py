"""Phrase collocations, distinct-word encoding and centroid clustering."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from fieldlark.llm import ball_means, collocations, word_table


def phrases_by_hand(rows, least, top, longest=4, percent=80):
    total, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        scored = []
        for p, a in cand.items():
            if 100 * inside[p] >= percent * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, total[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def made_texts(seed, n, words, size):
    rnd = random.Random(seed)
    bits = [*words, *words[:2], "is", "Is", "é", " "]
    gap = lambda: rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"])
    rows = [(rnd.choice(["en", "de", None, "", "x\ny "]), "".join(rnd.choice(bits) + gap() for _ in range(rnd.randint(0, size)))) for _ in range(n)]
    return [*rows, ("en", None), (None, ""), ("fr", " .,\n"), ("en", "a " * 3000), ("de", "a b a b " * 700)]


@pytest.mark.parametrize("shard,entries,bits", [(1 << 20, 1 << 17, 1 << 26), (60, 5, 64), (7, 1, 1 << 12)])
def test_phrases_against_brute_force(spark, shard, entries, bits):
    rows = made_texts(3, 120, ["a", "b", "c", "The", "the"], 60)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, rank int").repartition(3)
    for least, top in ((5, 40), (30, 2000)):
        got = sorted(map(tuple, collocations.collocations(df, least, top, shard=shard, entries=entries, bits=bits).collect()))
        assert got == phrases_by_hand(rows, least, top) and got
    assert collocations.collocations(df.limit(0)).count() == 0


def test_phrase_types_and_lengths(spark):
    rows = made_texts(4, 40, ["a", "b", "c"], 80)
    df = spark.createDataFrame(rows, "lang string, text string")
    out = collocations.collocations(df, 4, 100, longest=2)
    assert [t for _, t in out.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
    assert sorted(map(tuple, out.collect())) == phrases_by_hand(rows, 4, 100, 2)


def test_bitmaps_hold_every_position():
    import numpy as np

    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdefghij") + rnd.choice("  .") for _ in range(5000))
    words = collocations.tokens(pa.array([text]))
    row = collocations.shard_row("en", words)
    full = np.full(8, 255, np.uint8)
    maps = collocations.Bitmaps("en", row.column(2).flatten(), *(row.column(i)[0].as_py() for i in (4, 5, 6)), full)
    at = {w: [] for w in maps.words.to_pylist()}
    for w, byte, mask in zip(maps.word, maps.byte, maps.mask):
        at[maps.words[int(w)].as_py()] += [8 * int(byte) + i for i in range(8) if mask >> i & 1]
    assert at == {w: [i for i, x in enumerate(words.to_pylist()) if x == w] for w in at}
    assert row.column(1)[0].as_py() == sum(map(len, at.values())) and row.column(3)[0].as_py() == [len(at[w]) for w in row.column(2)[0].as_py()]


def bpe_by_hand(rows, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    out = Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    return out


def hard_texts():
    spaces = [chr(c) for c in (*range(9, 14), 0x1C, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    every = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[i : i + 3000]) for i in range(0, len(every), 3000)] + [" ".join(every[i : i + 3000]) for i in range(0, len(every), 3000)]
    texts += [f"a{s}b{s}{s}c 1{s}2{s}." for s in spaces] + [s * 3 for s in spaces]
    texts += ["<|endoftext|>", "x <|endoftext|> y", "<|endoftext|><|endoftext|>", " <|endoftext|", "a<|endoftext|>͸b", "don't I'LL we're 's's 'S", "x" * 5000, " " * 3000 + "y", "1" * 700, "-" * 300 + " ok", "👍🏽 fine 👩‍👩‍👧", "\u0000\u0001 a", "tab\tend \n\n x"]
    return texts


@pytest.mark.parametrize("most,length,chunk", [(65_535, 256, 1024), (3, 2, 7), (0, 0, 100)])
def test_bpe_against_the_library(spark, sf_dir, odd_docs, most, length, chunk):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame(list(enumerate(hard_texts())) + [(1, "again <|endoftext|>"), (1, "again <|endoftext|>"), (None, None)], "doc_id long, text string").repartition(5)
    for df in (docs, odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = bpe_by_hand([(r.doc_id, r.text) for r in df.collect()], path)
        assert Counter(map(tuple, word_table.round_trip(df, path, most=most, length=length, chunk=chunk).collect())) == want
    assert word_table.round_trip(odd_docs.limit(0), path).count() == 0


def test_ids_and_texts_by_themselves(spark, odd_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    ids = word_table.encode(odd_docs, path)
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert Counter(map(tuple, word_table.decode(ids, path).collect())) == Counter((r.doc_id, r.text or "") for r in odd_docs.collect())
    given = [(1, [50256, 10, 11]), (2, None), (3, []), (4, [99999, -1, None, 198]), (5, [162, 222]), (6, list(range(0, 50257, 7)))]
    rows = spark.createDataFrame(given, "doc_id long, ids array<int>")
    assert dict(map(tuple, word_table.decode(rows, path).collect())) == {i: library.decode([x for x in v or [] if x is not None and 0 <= x <= 50256], skip_special_tokens=False) for i, v in given}


def test_chunks_are_cut_by_words(monkeypatch):
    monkeypatch.setattr(word_table, "WORDS", 10)
    path = public_tokenizers.path("byte_bpe_50k.json")
    lists = [["a"] * n if n is not None else None for n in (3, 4, 9, 0, 25, None, 1, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(lists, pa.list_(pa.string())), pa.array([None] * 5 + ["b b b"] + [None] * 3, pa.string())], names=["doc_id", "words", "text"])
    got = list(word_table._batches([batch], path, 100))
    assert [b.column(0).to_pylist() for b in got] == [[0, 1], [2, 3], [4], [6, 7, 8], [5]]
    assert got[-1].column(1).to_pylist() == [["b", " b", " b"]]


def test_a_word_is_encoded_once(spark):
    """All occurrences of a word that isn't hot meet in one task, whatever the number of rows that hold it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"common words and rare{i % 7}zz") for i in range(300)], "doc_id long, text string").repartition(6)
    plan = word_table.encode(docs, path, most=2)._jdf.queryExecution().toString()
    assert "hashpartitioning(word" in plan


def means_by_hand(rows, k, rounds, scale, dim, seed):
    x = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    cents = [v for _, v in sorted(x, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    own = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in x:
            members[own(v)[1]].append(v)
        cents = [[sum(c) // len(members[j]) for c in zip(*members[j])] if members[j] else c for j, c in enumerate(cents)]
    found = [(i, *own(v)) for i, v in x]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    fits = lambda d: d if d < 1 << 63 else None
    return Counter((i, j, fits(d), fits(inertia[j]), fits(sum(inertia.values())), sha(",".join(map(str, cents[j])))) for i, d, j in found)


def made_vectors(rnd, n, dim, centres, spread):
    at = [[rnd.uniform(-1, 1) for _ in range(dim)] for _ in range(centres)]
    return [(i, [c + rnd.gauss(0, spread) for c in rnd.choice(at)]) for i in range(n)]


@pytest.mark.parametrize("dim,k,spread,block", [(3, 8, 0.4, 16), (3, 8, 0.02, 16), (64, 5, 0.3, 2048), (2, 1, 1, 7), (1, 8, 1, 3)])
def test_clusters_against_brute_force(spark, dim, k, spread, block):
    rnd = random.Random(dim * 31 + k)
    rows = made_vectors(rnd, 400, dim, 6, spread)
    rows += [(7, rows[0][1]), (7, rows[1][1]), (None, rows[2][1]), (901, None), (902, []), (903, [None] * dim), (904, [float("nan")] * dim), (905, [float("inf")] * dim), (906, [0.5] * (dim + 1))] + [(1000 + i, rows[3][1]) for i in range(200)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(5)
    got = Counter(map(tuple, ball_means.clusters(df, k, 6, 16, dim, 3, block=block).collect()))
    assert got == means_by_hand(rows, k, 6, 16, dim, 3)
    assert ball_means.clusters(df.limit(0), dim=dim).count() == 0


def test_clusters_of_few_and_of_large_vectors(spark):
    rows = [(i, [x, 1.0]) for i, x in enumerate([1e9, 1e9 + 1, -1e9, 3e12, 5.0, 5.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (2, 9):
        got = ball_means.clusters(df, k, 3, 1024, 2)
        assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
        assert Counter(map(tuple, got.collect())) == means_by_hand(rows, k, 3, 1024, 2, 3)


@pytest.mark.parametrize("lucky", [True, False])
def test_blocks_in_the_core_are_not_read(spark, lucky):
    """Well parted clusters: once centroids settle, shells near them have no neighbours."""
    rnd = random.Random(2)
    at = [[30 * (j >> b & 1) + rnd.random() for b in range(3)] for j in range(8)]
    order = sorted(range(2000), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
    place = {i: n for n, i in enumerate(order)}
    # the first centroids are of eight clusters, or of any
    rows = [(i, [c + rnd.gauss(0, 1) for c in at[(place[i] if lucky else i) % 8]]) for i in range(2000)]
    told: list = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(map(tuple, ball_means.clusters(df, 8, 8, 64, 3, 3, block=50, told=told).collect()))
    assert got == means_by_hand(rows, 8, 8, 64, 3, 3)
    blocks, read = told[-1]
    assert read == 0 if lucky else read < 0.8 * blocks
