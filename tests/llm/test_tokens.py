"""Tokenisers, packing and id files against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldlark.llm import id_files, packing, pieces, queries, word_ids

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

LETTERS = "ab cd  \n\t'sStre.é,ñß12²\x85\xa0\x1c¼_-ÀµI don't we'll X#%A👍中œİ▁\r\x00"


def odd_texts(n=1500, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + ["", " ", "\n", "<|endoftext|> hi", "a<|startoftext|>b", "x" * 3000, " " * 200 + "y"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_ids(name):
    path = public_tokenizers.path(name)
    coder, library, texts = word_ids.WordIds(path), Tokenizer.from_file(path), odd_texts()
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(coder.encode(texts)) == want
    assert list(coder.encode(texts)) == want  # now from the memo


def test_sentencepiece_matches_the_library():
    spm = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, coder = spm.SentencePieceProcessor(model_file=path), pieces.coder(path)
    rnd = random.Random(2)
    names = list(coder.model.id)
    texts = odd_texts() + ["".join(rnd.choice(names).replace("▁", " ") for _ in range(rnd.randint(1, 25))) for _ in range(2500)] + ["in" * 500, "<s>a</s>", "<unk>"]
    for t in texts:
        want = sp.encode(t, add_eos=True)
        n, listed, decoded = coder.document(t)
        assert (n, listed, decoded) == (len(want), " ".join(map(str, want)), sp.decode(want)), repr(t)
    for _ in range(2000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(259)]) for _ in range(rnd.randint(0, 12))]
        assert coder.model.decode(ids) == sp.decode(ids)


def test_sentencepiece_query(spark, sf_dir, odd_docs):
    spm = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = spm.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def want(docs):
        out = Counter()
        for r in docs.collect():
            ids = sp.encode(r.text or "", add_eos=True)
            out[(r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))] += 1
        return out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert Counter(map(tuple, queries.op3_sentencepiece(spark, sf_dir).collect())) == want(docs)
    assert Counter(map(tuple, pieces.encode_documents(odd_docs, path).collect())) == want(odd_docs)
    assert pieces.encode_documents(odd_docs, path, ids=True).where("size(ids) <> n_tokens").count() == 0
    assert pieces.encode_documents(odd_docs.limit(0), path).count() == 0


def check_packing(out, docs, capacity):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = Counter(), 0
    for r in docs:
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want[(r.doc_id, k, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), -(-total // capacity)


def test_packing(spark, sf_dir, odd_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    used, least = check_packing(queries.op4_best_fit_packing(spark, sf_dir).collect(), docs.collect(), 4096)
    assert used <= least + 1
    check_packing(packing.pack_documents(odd_docs, public_tokenizers.path("word_bpe_49k.json"), 64).collect(), odd_docs.collect(), 64)
    assert packing.pack_documents(odd_docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_two_fit_packs_everything():
    rng = np.random.default_rng(0)
    for capacity, sizes in ((100, rng.integers(1, 101, 3000)), (4096, np.minimum(rng.pareto(1.2, 20000) * 300 + 20, 4096).astype(int)), (10, np.array([3] * 7 + [4] * 5))):
        counts = {int(a): int(b) for a, b in zip(*np.unique(sizes, return_counts=True))}
        bins = packing.two_fit(counts, capacity)
        got = Counter()
        for used, times in bins:
            assert sum(n * k for n, k in used) <= capacity
            for n, k in used:
                got[n] += k * times
        assert got == Counter(counts)
        assert sum(t for _, t in bins) <= -(-int(sizes.sum()) // capacity) * 1.25 + 1
    assert packing.two_fit({}, 10) == []
    with pytest.raises(ValueError):
        packing.two_fit({11: 1}, 10)


def optimal(counts):
    import heapq

    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = sum(heap) if len(heap) == 1 else 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


@pytest.mark.parametrize("n", [1, 2, 3, 17, 400])
def test_code_lengths_are_optimal(n):
    rng = np.random.default_rng(n)
    c = (rng.pareto(1.2, n) * 10 + 1).astype(np.int64)
    lengths = id_files.code_lengths(c, 30)
    assert (c * lengths).sum() == optimal(c) and sum(2.0 ** -int(x) for x in lengths if x) <= 1


def test_code_lengths_keep_the_limit():
    lengths = id_files.code_lengths(np.array([2 ** min(i, 50) for i in range(60)]), 12)
    assert lengths.max() == 12 and sum(2.0 ** -int(x) for x in lengths) == 1
    with pytest.raises(ValueError):
        id_files.code_lengths(np.ones(9), 3)


def test_bits_round_trip():
    rng = np.random.default_rng(3)
    c = (rng.pareto(1, 3000) * 3).astype(np.int64)
    lengths = id_files.code_lengths(c)
    codes = id_files.canonical(lengths)
    used = np.flatnonzero(c)
    n = np.array([0, 5, 1, 0, 513, 256, 255, 257, 20000, 3])
    ids = rng.choice(used, n.sum())
    bits, size, at = id_files.encode_bits(ids, np.cumsum(n), lengths, id_files.aligned(lengths, codes))
    first = np.concatenate([[0], np.cumsum(n)])
    marks = np.concatenate([at[first[k] : first[k + 1] : id_files.SEGMENT] for k in range(len(n))])
    _, sizes = id_files.segments(n)
    table = id_files.decode_table(lengths, codes)
    assert np.array_equal(id_files.decode_bits(bits, marks, sizes, table), ids) and size.sum() == len(bits)
    assert np.array_equal(id_files.decode_bits(bits, marks[3:4], sizes[3:4], table), ids[first[4] + 256 : first[4] + 512])  # a block's run by itself


def ids_by_hand(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for r in sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_id_files(spark, sf_dir, odd_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, queries.op6_token_id_files(spark, sf_dir).collect())) == ids_by_hand(docs.collect())
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = odd_docs.where("doc_id is not null")
    assert sorted(map(tuple, id_files.round_trip(own, path).collect())) == ids_by_hand(own.collect())
    assert {tuple(r)[2:] for r in id_files.round_trip(odd_docs, path).collect()} == {x[2:] for x in ids_by_hand(odd_docs.collect())}
    assert id_files.round_trip(odd_docs.limit(0), path).count() == 0


def test_id_files_cut_within_an_id(spark, monkeypatch):
    monkeypatch.setattr(id_files, "BLOCK", 200)  # the driver's, which makes more files
    rnd = random.Random(4)
    rows = [(i, f"text {rnd.randint(0, 9)} " * rnd.randint(0, 9)) for i in [None] * 150 + [7] * 250 + list(range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = id_files.write_ids(docs, f"{spark.conf.get('spark.checkpoint.dir')}/cut", public_tokenizers.path("byte_bpe_50k.json"), 2)
    files = spark.read.parquet(f"{path}/blocks").select("part", "doc_ids").collect()
    assert len({r.part for r in files if None in r.doc_ids}) > 1 and len({r.part for r in files if 7 in r.doc_ids}) > 1
    got = sorted(map(tuple, id_files.read_ids(spark, path).collect()), key=lambda r: r[1])
    assert Counter((r[0], *r[2:]) for r in got) == Counter((r[0], *r[2:]) for r in ids_by_hand(docs.collect()))
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    ids = [-1 if r[0] is None else r[0] for r in got]
    assert ids == sorted(ids)
