"""Token ids as files: canonical length-limited Huffman codes in independent blocks.

Ids are encoded once and kept, each task's counts beside them; the global counts
(one row per id of the vocabulary) give the code lengths by package-merge. Documents go to files by
ranges of their id, in ascending order, and within a file to blocks of about
``block`` tokens. A block holds its bits, the documents' id counts and, for
every run of ``SEGMENT`` ids of a document, the bit offset where it begins: any
run can be decoded by itself, and a reader decodes all runs of a block side by
side through one table.

The files are written by Spark (rows of blocks in Parquet), so that a lost task
leaves no half-written file and any store that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .word_ids import word_ids

IDS = "doc_id long, ids binary, sums binary"
CODED = "to int, doc_id long, spread long, n long, bits binary, checkpoints binary"
BLOCKS = "part int, begin long, tokens long, doc_ids array<long>, counts array<long>, bits binary, checkpoints binary"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Ids between checkpoints; longest code in bits; ids of a block; rows that the files' bounds are taken from, at most.
SEGMENT, LONGEST, BLOCK, SAMPLE = 256, 18, 1 << 20, 1 << 20


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge); 0 where the count is."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need more than {longest} bits")
    if n < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, levels = leaves, []
    for _ in range(longest):
        is_leaf = np.ones(len(leaves), bool) if level is leaves and not levels else None
        if is_leaf is None:
            pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate([leaves, pairs])
            by = np.argsort(both, kind="stable")
            level, is_leaf = both[by], by < n
        levels.append(is_leaf)
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        mine = int(is_leaf[:take].sum())
        bits[:mine] += 1
        take = 2 * (take - mine)
    out[order] = bits
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[np.searchsorted(lengths[order], 1) :].tolist():
        code <<= int(lengths[s]) - before
        before = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length of the code that each word of ``width`` bits begins with."""
    width = max(1, int(lengths.max(initial=0)))
    symbol, size = np.zeros(1 << width, np.uint32), np.zeros(1 << width, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(codes[used] << (width - lengths[used]).astype(np.uint64), kind="stable")]
    spans = 1 << (width - lengths[order].astype(np.int64))
    symbol[: spans.sum()] = np.repeat(order, spans)
    size[: spans.sum()] = np.repeat(lengths[order], spans)
    return symbol, size, width


def aligned(lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Each code at the top of a 64-bit word."""
    return codes << (np.uint64(64) - np.maximum(lengths, 1).astype(np.uint64))


def encode_bits(ids: np.ndarray, ends: np.ndarray, lengths: np.ndarray, top: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bits of all documents (each from a byte's first bit), bytes of each, and the bit each id begins at; ``top`` is ``aligned``."""
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(lengths[ids], out=total[1:])
    first = np.concatenate([[0], ends[:-1]])
    start = total[first]
    width = (total[ends] - start + 7) >> 3
    base = np.concatenate([[0], np.cumsum(width)])
    at = total[:-1] + np.repeat(base[:-1] * 8 - start, ends - first)
    words = np.zeros(int(base[-1]) // 4 + 3, np.uint64)  # 32-bit words, with room to carry
    if len(ids):
        word = at >> 5
        value = top[ids] >> (at & 31).astype(np.uint64)
        cut = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        whole = np.add.reduceat(value, cut)  # the codes' bits are apart, so sums are unions
        words[word[cut]] += whole >> np.uint64(32)
        words[word[cut] + 1] += whole & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: int(base[-1])], width, at


def decode_bits(bits: bytes, starts: np.ndarray, counts: np.ndarray, table) -> np.ndarray:
    """Ids of all segments, in order: each step takes one id of every segment that has any left."""
    symbol, size, width = table
    raw = np.frombuffer(bits + bytes(8), np.uint8)
    n = len(raw) - 7
    window = np.zeros(n, np.uint32)  # the 32 bits from each byte on
    for k in range(4):
        window |= raw[k : k + n].astype(np.uint32) << np.uint32(24 - 8 * k)
    out = np.empty(int(counts.sum()), np.uint32)
    order = np.argsort(-counts, kind="stable")
    to, at, many = (np.cumsum(counts) - counts)[order], starts[order].astype(np.int64), counts[order]
    live = len(order)
    for step in range(int(many[0]) if live else 0):
        while live and many[live - 1] <= step:
            live -= 1
        a = at[:live]
        word = (window[a >> 3] << (a & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[to[:live] + step] = symbol[word]
        a += size[word]
    return out


def segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments of each document, and their sizes."""
    per = -(-counts // SEGMENT)
    doc = np.repeat(np.arange(len(counts)), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    return per, np.minimum(SEGMENT, counts[doc] - k * SEGMENT)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode all texts and write ``path``/blocks and ``path``/code; returns ``path``.

    A null or empty text is its end id alone. Equal doc_ids stand beside each
    other, null ones first; many of one id go to several files.
    """
    spark = docs.sparkSession
    width = "<u2" if max(word_ids(tokenizer).size, end_id + 1) <= 1 << 16 else "<u4"

    def tokens(batches):
        schema = common.batches_of(IDS)
        coder, end = word_ids(tokenizer, 1_200_000), end_id.to_bytes(4, "little")
        total = np.zeros(max(coder.size, end_id + 1), np.int64)
        for b in common.sliced(batches):
            out = [np.frombuffer(raw + end, "<u4") for raw in coder.encode(b.column(1).to_pylist())]
            total += np.bincount(np.concatenate(out), minlength=len(total))
            out = [x.astype(width).tobytes() for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], schema=schema)

    kept = common.text_rows(docs, id_col, text_col).mapInArrow(tokens, IDS).withColumn("row", F.monotonically_increasing_id())
    kept = common.stored(kept, "ids", "zstd")
    # files are cut by id, and within the rows of one id (or of none) by a number that spreads them
    rows = kept.where("sums is null").select("doc_id", "ids", F.xxhash64("row").alias("spread"))

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total = np.frombuffer(raw, "<i8") + (total if len(total) else 0)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], schema=common.batches_of("id long, n long"))

    sums = kept.where("sums is not null").select("sums").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary
    counts = np.zeros(max([r["id"] for r in sums], default=0) + 1, np.int64)
    for r in sums:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    top = aligned(lengths, canonical(lengths))
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, bits int").coalesce(1).write.parquet(f"{path}/code")

    def code(batches):
        schema = common.batches_of(CODED)
        for b in common.sliced(batches, 64):
            part = b.column(1).to_pylist()
            to = [bisect_left(bounds, at) for at in zip(b.column(0).fill_null(-(1 << 63)).to_pylist(), b.column(2).to_pylist())]
            n = np.array([len(r) for r in part], np.int64) // np.dtype(width).itemsize
            bits, size, at = encode_bits(np.frombuffer(b"".join(part), width), np.cumsum(n), lengths, top)
            byte, first = np.concatenate([[0], np.cumsum(size)]).tolist(), np.concatenate([[0], np.cumsum(n)]).tolist()
            marks = [(at[first[k] : first[k + 1] : SEGMENT] - 8 * byte[k]).astype("<u4").tobytes() for k in range(len(part))]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), b.column(0), b.column(2), pa.array(n), pa.array([bits[byte[k] : byte[k + 1]] for k in range(len(part))], pa.binary()), pa.array(marks, pa.binary())], schema=schema)

    def blocks(batches):
        schema = common.batches_of(BLOCKS)
        from pyspark import TaskContext

        part, begin, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            docs_, n, bits, marks = zip(*held)
            base = np.cumsum([0, *map(len, bits)])
            moved = b"".join((np.frombuffer(m, "<u4").astype("<u8") + 8 * int(o)).astype("<u8").tobytes() for m, o in zip(marks, base))
            row = [[part], [begin], [sum(n)], [list(docs_)], [list(n)], [b"".join(bits)], [moved]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, schema.types)], schema=schema)

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in (1, 3, 4, 5))):
                held.append(row)
                size += row[1]
                if size >= BLOCK:
                    yield close()
                    begin, held, size = begin + size, [], 0
        if held:
            yield close()

    total = int(counts.sum())
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK)), -(-total // (16 * BLOCK)))
    bounds: list[tuple[int, int]] = []
    if parts > 1:  # cut at quantiles of a sample of bounded size: the bounds only balance the files
        share = min(1.0, min(SAMPLE, 64 * parts) / max(1, rows.count()))
        some = sorted((-(1 << 63) if r[0] is None else r[0], r[1]) for r in rows.select("doc_id", "spread").where(F.pmod(F.xxhash64("spread"), F.lit(1 << 30)) < share * (1 << 30)).collect())
        bounds = sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []
    dealt = rows.mapInArrow(code, CODED).repartitionById(parts, F.col("to")).sortWithinPartitions("doc_id", "spread")
    dealt.mapInArrow(blocks, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def _code(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/code").collect()  # a row for each id of the vocabulary
    lengths = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return lengths


def read_ids(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids."""
    files = spark.read.parquet(f"{path}/blocks")
    table_of = _code(spark, path)
    sums = sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("tokens")).collect())  # a row for each file
    base, before = {}, 0
    for part, n in sums:
        base[part], before = before, before + n
    schema_ddl = READ + (", ids binary" if ids else "")

    def run(batches):
        schema = common.batches_of(schema_ddl)
        table = decode_table(table_of, canonical(table_of))
        for b in batches:
            for part, begin, docs_, counts, bits, marks in zip(*(c.to_pylist() for c in b.columns)):
                n = np.array(counts, np.int64)
                _, sizes = segments(n)
                raw = decode_bits(bits, np.frombuffer(marks, "<u8"), sizes, table).astype("<u4").tobytes()
                ends = np.cumsum(n)
                each = [raw[4 * s : 4 * e] for s, e in zip((ends - n).tolist(), ends.tolist())]
                cols = [docs_, (ends - n + base[part] + begin).tolist(), counts, [zlib.crc32(x) for x in each]] + ([each] if ids else [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return files.select("part", "begin", "doc_ids", "counts", "bits", "checkpoints").mapInArrow(run, schema_ddl)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids to files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before, in ascending doc_id order
    (nulls first; equal ones in any order). Other columns are not read; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    return read_ids(spark, write_ids(docs, common.scratch(spark, "id-files"), tokenizer, end_id, id_col, text_col))
