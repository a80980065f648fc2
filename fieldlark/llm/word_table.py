"""BPE encoding through a table of distinct words, and decoding through the table of pieces.

The vocabulary's merges never cross the words that its pattern splits a text
into, so the ids of a text are those of its words in a row. Spark splits the texts
by a regular expression. The most frequent words (``HOT`` at most, each of
``LENGTH`` bytes at most, whatever the corpus' size) are encoded first; their
table is broadcast, and a chunk of texts becomes the row of its words' numbers in
it. Words that it lacks are numbered within the chunk and dealt out by word,
so that all chunks with a word meet and it is encoded once; its ids come back by a
join on chunk and number, and stand where the number does. None of these words
can be a hot key: what is more frequent than the least of the hot ones is hot itself.
Decoding looks the ids up in the table of pieces, which the vocabulary bounds.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of the broadcast table, and bytes of each, at most; rows of a chunk, and words of one that has more than one row.
HOT, LENGTH, CHUNK, WORDS = 250_000, 64, 1024, 1 << 19
#: Shares that the occurrences of a word of over ``LENGTH`` bytes are dealt out in.
SHARES = 16
#: White space of the pattern (the property White_Space of Unicode) as the inside of a regular expression's class.
SPACE = r"\t-\r\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Fixed value: the pattern of byte-level vocabularies.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Runs of characters that all versions of Unicode from 3.2 on class alike are told apart from others if they are that long.
RUN = 96
FOUND = "chunk binary, at int, ids array<int>"
CODED = "chunk binary, doc_ids array<long>, n_words array<int>, codes binary, missing array<string>"


@functools.cache
def settled() -> list[tuple[int, int]]:
    """Runs of characters that are letters, numbers or neither alike in Unicode 3.2 and today.

    The JVM and the library know different versions in between; a text of other characters
    is split by the library.
    """
    kind = lambda db, c: db.category(c)[0] if db.category(c)[0] in "LN" else "O"
    runs, begin = [], 0
    for i in range(0x30001):
        if i == 0x30000 or 0xD800 <= i < 0xE000 or kind(unicodedata, chr(i)) != kind(unicodedata.ucd_3_2_0, chr(i)):
            if i - begin >= RUN:
                runs.append((begin, i - 1))
            begin = i + 1
    return runs


def _outside(runs: list[tuple[int, int]]) -> str:
    return "[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]"


def words(text: Column, specials: tuple[str, ...]) -> Column:
    """The words of a text in order, special tokens being words too; null for a text that the library has to split."""
    cut = lambda c: F.regexp_extract_all(c, F.lit(PATTERN), F.lit(0))
    out = cut(text)
    if specials:
        any_of = "|".join(rf"\Q{s}\E" for s in specials)
        pieces = F.split(text, f"(?<={any_of})|(?={any_of})")
        whole = F.flatten(F.transform(pieces, lambda p: F.when(p.isin(*specials), F.array(p)).otherwise(cut(p))))
        has = functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in specials])
        out = F.when(has, whole).otherwise(out)
    return F.when(~odd(text), out)


def odd(text: Column) -> Column:
    """Whether a text has characters of none of the runs.

    A class of one range is many times as fast as one of several; so most texts
    are told by the run of Latin letters, or by the gaps between it and the
    runs of common punctuation.
    """
    usual = [r for r in settled() if any(r[0] <= ord(c) <= r[1] for c in "a’€")]
    gaps = [(a[1] + 1, b[0] - 1) for a, b in zip(usual, [*usual[1:], (0x110000, 0)])]
    between = functools.reduce(lambda a, b: a | b, [text.rlike(rf"[\x{{{a:X}}}-\x{{{b:X}}}]") for a, b in gaps])
    return F.when(F.length(text) == F.octet_length(text), False).when(~text.rlike(_outside(usual[:1])), False).when(~between, False).otherwise(text.rlike(_outside(settled())))


class Vocabulary:
    """A byte-level vocabulary: ids of a word, words of a text, pieces by id."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {**{i: t for t, i in spec["model"]["vocab"].items()}, **{i: t for t, i in self.specials.items()}}
        # printable Latin-1 stands for itself as a byte, the other bytes for letters from U+0100 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in own)}
        self.bytes = {chr(self.letters.get(b, b)): b for b in range(256)}

    def encode(self, word: str) -> list[int]:
        if word in self.specials:
            return [self.specials[word]]
        return [t.id for t in self.library.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def split(self, text: str) -> list[str]:
        """As ``words``, by the library's own pattern."""
        parts = re.split("(" + "|".join(map(re.escape, self.specials)) + ")", text) if self.specials else [text]
        return [w for p in parts for w in ([p] if p in self.specials else [p[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(p)])]

    @functools.cached_property
    def pieces(self) -> pa.Array:
        """The bytes of each id; null for a number that is none."""
        inside = lambda t: bytes(self.bytes[c] for c in t) if all(c in self.bytes for c in t) else t.encode()
        return pa.array([inside(self.by_id[i]) if i in self.by_id else None for i in range(max(self.by_id) + 1)], pa.binary())


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One per process and path."""
    return Vocabulary(path)


def _split(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, words, text), where the text is only given if the words are not."""
    c = F.col
    return docs.select("doc_id", words(c("text"), tuple(vocabulary(path).specials)).alias("words"), F.when(odd(c("text")), c("text")).alias("text"))


def _batches(batches, path: str, rows: int):
    """Batches (.., words, text) with the words of every row, of some rows each and of ``WORDS`` words if they aren't one row."""
    for b in common.sliced(batches, rows):
        at = b.schema.get_field_index("words")
        known = pc.is_valid(b.column(at))
        parts = [b.filter(known)] if pc.any(known).as_py() else []
        if not pc.all(known).as_py():
            rest = b.filter(pc.invert(known))
            parts.append(rest.set_column(at, b.schema.field(at), pa.array([vocabulary(path).split(t) for t in rest.column("text").to_pylist()], b.schema.field(at).type)))
        for part in parts:
            ends = np.cumsum(pc.list_value_length(part.column(at)).to_numpy(), dtype=np.int64)
            first = 0
            while first < part.num_rows:
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + WORDS, "right")))
                yield part.slice(first, last - first)
                first = last


def _hot_words(rows: DataFrame, path: str, most: int, length: int) -> DataFrame:
    """The most frequent words and their ids. A word that a slice of texts has once isn't counted there, which no result depends on."""

    def count(batches):
        for b in _batches(batches, path, 2048):
            n = pc.value_counts(b.column(0).flatten())
            keep = pc.and_(pc.greater(n.field("counts"), 1), pc.less_equal(pc.binary_length(n.field("values")), length))
            yield pa.RecordBatch.from_arrays([n.field("values").filter(keep), n.field("counts").filter(keep)], names=["word", "n"])

    def encode(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(vocabulary(path).encode, b.column(0).to_pylist())), pa.list_(pa.int32()))], names=["word", "ids"])

    counts = rows.select("words", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return common.stored(counts.orderBy(F.desc("n"), "word").limit(most).select("word").mapInArrow(encode, "word string, ids array<int>"), "hot-words")


def _coded(rows: DataFrame, path: str, hot, chunk: int) -> DataFrame:
    """Chunks of texts as the numbers of their words: those of the broadcast table ``hot`` first, then those of ``missing``.

    A chunk's key is a digest of what it holds, so that it is the same whenever
    the chunk is made. Where no word is missing the key is made the task's own,
    lest one text that many rows repeat becomes one key.
    """

    def run(batches):
        from pyspark import TaskContext

        table = pa.ipc.open_stream(hot.value).read_all().column("word").combine_chunks()
        task = TaskContext.get().partitionId().to_bytes(4, "little")
        schema = common.batches_of(CODED)
        for b in _batches(batches, path, chunk):
            n_words, flat = pc.list_value_length(b.column(1)), b.column(1).flatten()
            codes = pc.index_in(flat, value_set=table)
            rare = flat.filter(pc.is_null(codes)).dictionary_encode()
            codes = pc.fill_null(codes, -1).to_numpy().copy()
            codes[codes < 0] = rare.indices.to_numpy() + len(table)
            packed = pa.compress(codes.astype("<u2").tobytes() + (codes >> 16).astype("<u2").tobytes(), "zstd", asbytes=True)
            key = hashlib.sha256(packed)
            for part in (b.column(0).to_pylist(), n_words.to_pylist(), rare.dictionary.to_pylist()):
                key.update(repr(part).encode("utf-8", "surrogatepass"))
            key = key.digest()[:16] + (b"" if len(rare.dictionary) else task)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), one(b.column(0)), one(n_words.cast(pa.int32())), pa.array([packed], pa.binary()), one(rare.dictionary)], schema=schema)

    return rows.mapInArrow(run, CODED)


def _encoded_rest(coded: DataFrame, path: str, length: int) -> DataFrame:
    """(chunk, at, ids) of every missing word: all chunks of a word stand together, and it is encoded when it changes."""

    def run(batches):
        word, ids, before = None, None, None
        for b in common.sliced(batches, 8192):
            out = []
            for w, key, at in zip(*(b.column(i).to_pylist() for i in range(3))):
                if w != word:
                    word, ids, before = w, vocabulary(path).encode(w), None
                if key != before:  # chunks of equal content share their answers
                    before = key
                    out.append((key, at, ids))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int32()))], schema=common.batches_of(FOUND))

    rest = coded.select("chunk", F.posexplode("missing").alias("at", "word"))
    share = F.when(F.octet_length("word") > length, F.pmod(F.xxhash64("chunk"), F.lit(SHARES))).otherwise(0)
    return rest.withColumn("share", share).repartition("word", "share").sortWithinPartitions("word", "chunk").select("word", "chunk", "at").mapInArrow(run, FOUND)


def _assembled(coded: DataFrame, rest: DataFrame, hot, make, ddl: str) -> DataFrame:
    """Puts the ids of all words in their places; ``make(doc_ids, ids, ends)`` is the batch that is given out for a chunk."""

    def run(batches):
        table = pa.ipc.open_stream(hot.value).read_all().column("ids").combine_chunks()
        hot_ids, hot_n = table.flatten().to_numpy(), pc.list_value_length(table).to_numpy().astype(np.int64)
        hot_at = np.cumsum(hot_n) - hot_n
        for b in common.sliced(batches, 1):
            n_words = b.column(1).flatten().to_numpy().astype(np.int64)
            total = int(n_words.sum())
            raw = np.frombuffer(pa.decompress(b.column(2)[0].as_py(), 4 * total, "zstd"), "<u2").astype(np.int64) if total else np.zeros(0, np.int64)
            codes = raw[:total] + (raw[total:] << 16)
            given = b.column(3).flatten()
            lists = given.field("ids") if len(given) else pa.array([], pa.list_(pa.int32()))
            own_n = np.zeros(max(0, int(codes.max(initial=-1)) + 1 - len(hot_n)), np.int64)
            if len(given) != len(own_n):
                raise ValueError(f"a chunk lacks {len(own_n)} words and was given {len(given)}: its rows came in another order when they were read again")
            at = given.field("at").to_numpy() if len(given) else np.zeros(0, np.int64)
            own_n[at] = sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
            own_at = np.zeros(len(own_n), np.int64)
            own_at[at] = np.cumsum(sizes) - sizes + len(hot_ids)
            source, starts, sizes = np.concatenate([hot_ids, lists.flatten().to_numpy()]), np.concatenate([hot_at, own_at]), np.concatenate([hot_n, own_n])
            n = sizes[codes]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids = source[np.repeat(starts[codes], n) + inner].astype(np.int32)
            yield make(b.column(0).flatten(), ids, np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(n_words)])])

    grouped = rest.groupBy("chunk").agg(F.collect_list(F.struct("at", "ids")).alias("given"))
    whole = coded.select("chunk", "doc_ids", "n_words", "codes").join(grouped, "chunk", "left")
    given = F.coalesce("given", F.expr("cast(array() as array<struct<at:int,ids:array<int>>>)"))
    return whole.select("doc_ids", "n_words", "codes", given.alias("given")).mapInArrow(run, ddl)


def _encoded(docs: DataFrame, path: str, make, ddl: str, id_col: str, text_col: str, most: int, length: int, chunk: int) -> DataFrame:
    rows = _split(common.text_rows(docs, id_col, text_col), path)
    table = _hot_words(rows, path, most, length).toArrow()  # of `most` rows at most
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    hot = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    coded = _coded(rows, path, hot, chunk)
    return _assembled(coded, _encoded_rest(coded, path, length), hot, make, ddl)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = HOT, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids array<int>) of every row, as the library encodes its whole text without special tokens added.

    A null text is empty and has no ids; strings of special tokens in a text are
    those tokens, as the library has it. Repeated rows, and rows of a null id, are
    rows each. Texts of any length are taken whole: the words of ``chunk`` rows have to fit a
    task. Other columns are not read; an empty table gives an empty result.
    ``most`` and ``length`` bound the broadcast table and change no result.
    """
    schema = common.batches_of("doc_id long, ids array<int>")
    make = lambda doc_ids, ids, ends: pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], schema=schema)
    return _encoded(docs, path, make, "doc_id long, ids array<int>", id_col, text_col, most, length, chunk)


def joined(ids: np.ndarray, ends: np.ndarray, pieces: pa.Array) -> list[str]:
    """The texts of the ids between neighbouring ``ends``: their pieces, joined to the table of pieces by id, one after the other."""
    found = pieces.take(pa.array(np.where((ids >= 0) & (ids < len(pieces)), ids, 0), mask=(ids < 0) | (ids >= len(pieces))))
    _, offsets, data = found.buffers()
    at = np.frombuffer(offsets, np.int32)[ends]  # nulls take no bytes
    whole = memoryview(data) if data is not None else b""
    return [str(whole[a:e], "utf-8", "replace") for a, e in zip(at[:-1].tolist(), at[1:].tolist())]


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids, as the library decodes them with special tokens kept.

    Null ids and ids that the vocabulary lacks give nothing, null rows of ids an empty
    text; bytes that are no UTF-8 give U+FFFD as the library has it.
    """

    def run(batches):
        pieces = vocabulary(path).pieces
        for b in common.sliced(batches):
            lists = b.column(1)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
            texts = joined(lists.flatten().to_numpy(), ends, pieces)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=common.batches_of("doc_id long, text string"))

    given = F.coalesce(F.filter(rows[ids_col].cast("array<int>"), lambda i: i.isNotNull()), F.array().cast("array<int>"))
    return rows.select(rows[id_col].cast("long").alias("doc_id"), given.alias("ids")).mapInArrow(run, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = HOT, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """Of every row doc_id, n_tokens, the hex digest of its ids as little-endian unsigned 32-bit integers, and that of the text they decode to."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def make(doc_ids, ids, ends):
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
        texts = joined(ids, ends, vocabulary(path).pieces)
        cols = [doc_ids, pa.array(np.diff(ends), pa.int64()), pa.array([sha(ids[a:e].astype("<u4").tobytes()) for a, e in spans], pa.string()), pa.array([sha(t.encode()) for t in texts], pa.string())]
        return pa.RecordBatch.from_arrays(cols, schema=common.batches_of(DIGESTS))

    return _encoded(docs, path, make, DIGESTS, id_col, text_col, most, length, chunk)
