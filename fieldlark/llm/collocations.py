"""Phrase collocation mining: position bitmaps per word, extended depth first by shift, AND and popcount.

Texts are cut into shards of about a million words of one language. Within a
shard every word has a bitmap of the positions it stands at; between two pieces
lies an empty position, so no phrase reaches over it. Of a bitmap only the bytes
that aren't zero are kept, as (byte number, byte). A phrase's bitmap marks where
its last word stands: shifted by one position and ANDed with a word's bitmap it
becomes that of the phrase extended by the word, and its popcount is the number
of occurrences in the shard. Counts are summed over shards.

A shard can't see which phrases are frequent in the whole corpus. Three passes
tell it: words first, then pairs of frequent words, then, depth first, phrases of
three and four words all of whose pairs are frequent. What is frequent goes to
the shards as a table of bits by hash (``BITS`` bits whatever the corpus' size).
Such a table never loses a frequent phrase; a phrase it lets through by chance is
counted in vain and dropped by its sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of a shard, at which it is closed; entries of bitmaps that are extended at once; bits of the table of frequent phrases.
SHARD, ENTRIES, BITS = 1 << 20, 1 << 17, 1 << 26
#: Bits of one stored block of that table.
BLOCK = 1 << 15
LONGEST = 4
SHARDS = "lang string, total long, words array<string>, counts array<long>, sizes binary, steps binary, masks binary"
#: What stands for a border between pieces among the words; no word contains it.
GAP = "\n"


def tokens(texts: pa.Array) -> pa.Array:
    """The words of all texts in a row, lower-cased (A-Z only), with ``GAP`` between pieces."""
    t = pc.replace_substring_regex(pc.ascii_lower(texts), "[.,;:!?\n\x0b\x0c\r]", f" {GAP} ")
    t = pc.binary_join_element_wise(pc.replace_substring(t, "\t", " "), GAP, " ")
    words = pc.split_pattern(t, " ").flatten()
    return words.filter(pc.not_equal(words, ""))


def shard_row(lang: str, words: pa.Array) -> pa.RecordBatch:
    """A shard: its words with their popcounts, and their bitmaps one after the other (entries of each, byte numbers as differences, bytes)."""
    code = words.dictionary_encode()
    ids, names = code.indices.to_numpy().astype(np.int64), code.dictionary
    at = np.flatnonzero(ids != pc.index(names, GAP).as_py())
    at = at[np.argsort(ids[at], kind="stable")]
    word, byte = ids[at], at >> 3
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (byte[1:] != byte[:-1]))) if len(at) else at
    masks = np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first) if len(at) else np.zeros(0, np.uint8)
    word, byte = word[first], byte[first]
    steps = np.diff(byte, prepend=0)
    begin = np.append(True, word[1:] != word[:-1]) if len(word) else np.zeros(0, bool)
    steps[begin] = byte[begin]
    starts = np.flatnonzero(begin)
    counts = np.add.reduceat(np.bitwise_count(masks).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    sizes = np.diff(starts, append=len(word))
    kept = names.take(pa.array(word[starts]))
    cols = [[lang], [int(counts.sum())], pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), [counts.tolist()], [sizes.astype("<i4").tobytes()], [steps.astype("<i4").tobytes()], [masks.tobytes()]]
    schema = common.batches_of(SHARDS)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)


def _sharded(docs: DataFrame, shard: int) -> DataFrame:
    def run(batches):
        held: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}

        def close(lang):
            size.pop(lang)
            return shard_row(lang, pa.concat_arrays(held.pop(lang)))

        for b in common.sliced(batches):
            for lang in pc.unique(b.column(0)).to_pylist():
                words = tokens(b.column(1).filter(pc.equal(b.column(0), lang)))
                held.setdefault(lang, []).append(words)
                size[lang] = size.get(lang, 0) + len(words)
                if size[lang] >= shard:
                    yield close(lang)
            if sum(size.values()) >= 4 * shard:  # many languages, none of which fills a shard
                for lang in list(held):
                    yield close(lang)
        for lang in list(held):
            yield close(lang)

    return docs.mapInArrow(run, SHARDS)


def _mix(*hashes: np.ndarray) -> np.ndarray:
    """One hash of a phrase from those of its words."""
    h = np.zeros(len(hashes[0]), np.uint64)
    for x in hashes:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(f"{lang}\n{w}") for w in words], np.uint64)


def _bit_table(phrases: DataFrame, bits: int) -> bytes:
    """The table of the hashes of (lang, phrase): a number of bytes that ``bits`` fixes."""
    block = min(BLOCK, bits)

    def places(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = [int(_mix(*word_hashes(lang, t.split(" ")).reshape(-1, 1))[0] % np.uint64(bits)) for lang, t in zip(langs, texts)]
            yield pa.RecordBatch.from_arrays([pa.array([a // block for a in at], pa.int32()), pa.array([a % block for a in at], pa.int32())], names=["block", "bit"])

    def gather(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        marks = np.zeros(block, np.uint8)
        marks[rows.column("bit").to_numpy()] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    out = bytearray(bits // 8)
    for r in phrases.select("lang", "phrase").mapInArrow(places, "block int, bit int").distinct().groupBy("block").applyInArrow(gather, "block int, bits binary").toLocalIterator():
        out[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = r["bits"]
    return bytes(out)


def _holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(8 * len(table))
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Bitmaps:
    """A shard's bitmaps of the words that ``table`` holds, by word and by byte number."""

    def __init__(self, lang: str, words: pa.Array, sizes: bytes, steps: bytes, masks: bytes, table: np.ndarray):
        n = np.frombuffer(sizes, "<i4").astype(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        at = np.cumsum(np.frombuffer(steps, "<i4"), dtype=np.int64)
        start = np.cumsum(n) - n
        at -= np.repeat(np.concatenate([[0], at[start[1:] - 1]]) if len(n) else start, n)  # differences begin anew with each word
        hashes = word_hashes(lang, words.to_pylist())
        use = _holds(table, _mix(hashes))
        keep = use[owner]
        self.words, self.hashes = words.filter(pa.array(use)), hashes[use]
        self.word = (np.cumsum(use) - 1)[owner[keep]].astype(np.int32)
        self.byte, self.mask = at[keep], np.frombuffer(masks, np.uint8)[keep]
        order = np.argsort(self.byte, kind="stable")
        self.there_word, self.there_mask = self.word[order], self.mask[order]
        last = int(self.byte.max()) if len(self.byte) else 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.byte, minlength=last + 2))])

    def groups(self, entries: int):
        """Ranges of the entries by word: whole words, about ``entries`` at once."""
        ends = np.flatnonzero(np.append(self.word[1:] != self.word[:-1], True)) + 1 if len(self.word) else []
        a = 0
        for k, e in enumerate(ends):
            if k + 1 == len(ends) or ends[k + 1] - a > entries:
                yield a, int(e)
                a = int(e)

    def extended(self, phrase: np.ndarray, byte: np.ndarray, mask: np.ndarray):
        """The entries (phrase, word, byte, mask) of all phrases extended by any word: shift by a position, AND with the words' bitmaps."""
        shifted, carried = mask << 1, mask >> 7
        a, b = np.flatnonzero(shifted), np.flatnonzero(carried)
        phrase, byte, mask = np.concatenate([phrase[a], phrase[b]]), np.concatenate([byte[a], byte[b] + 1]), np.concatenate([shifted[a], carried[b]])
        begin = self.first[byte]
        n = self.first[byte + 1] - begin
        source = np.repeat(np.arange(len(n), dtype=np.int32), n)
        at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        both = self.there_mask[at] & mask[source]
        hit = np.flatnonzero(both)
        source = source[hit]
        return phrase[source], self.there_word[at[hit]], byte[source], both[hit]

    def counted(self, phrase: np.ndarray, word: np.ndarray, mask: np.ndarray):
        """Distinct (phrase, word): both, their popcounts, and the number of each entry's."""
        v = max(1, len(self.hashes))
        key, place = np.unique(phrase.astype(np.int64) * v + word, return_inverse=True)
        return key // v, key % v, np.bincount(place, np.bitwise_count(mask), len(key)).astype(np.int64), place.astype(np.int32)

    def pairs(self, entries: int):
        for a, e in self.groups(entries):
            phrase, word, _, mask = self.extended(self.word[a:e], self.byte[a:e], self.mask[a:e])
            first, second, n, _ = self.counted(phrase, word, mask)
            yield [first, second], n

    def longer(self, entries: int, table: np.ndarray, longest: int):
        """Phrases of three words and more, depth first, all of whose pairs the table holds."""
        for a, e in self.groups(entries):
            yield from self._deeper([np.arange(len(self.hashes))], self.word[a:e], self.byte[a:e], self.mask[a:e], table, longest)

    def _deeper(self, words: list[np.ndarray], phrase: np.ndarray, byte: np.ndarray, mask: np.ndarray, table: np.ndarray, longest: int):
        phrase, word, byte, mask = self.extended(phrase, byte, mask)
        last = words[-1][phrase]
        ok = _holds(table, _mix(self.hashes[last], self.hashes[word]))
        before, word, n, place = self.counted(phrase[ok], word[ok], mask[ok])
        words = [*(w[before] for w in words), word]
        if len(words) > 2:
            yield words, n
        if len(words) < longest and len(n):
            yield from self._deeper(words, place, byte[ok], mask[ok], table, longest)


#: A phrase of a language as one string, which is shorter to shuffle than two; no phrase contains the sign between them.
KEYED = "key string, f long"


def _popcounts(shards: DataFrame, table, pairs, entries: int, longest: int) -> DataFrame:
    """(key, f) of each shard: pairs of words that ``table`` holds, or, with the table ``pairs``, longer phrases."""

    def run(batches):
        schema = common.batches_of(KEYED)
        known = np.frombuffer(table.value, np.uint8)
        pair_bits = np.frombuffer(pairs.value, np.uint8) if pairs is not None else None
        for b in common.sliced(batches, 1):
            lang = b.column(0)[0].as_py()
            maps = Bitmaps(lang, b.column(1).flatten(), *(b.column(i)[0].as_py() for i in (2, 3, 4)), known)
            firsts = pc.binary_join_element_wise(pa.scalar(lang), maps.words, GAP)
            for words, n in maps.pairs(entries) if pair_bits is None else maps.longer(entries, pair_bits, longest):
                for s in range(0, len(n), 65_536):
                    part = [of.take(pa.array(w[s : s + 65_536])) for of, w in zip([firsts, *[maps.words] * len(words)], words)]
                    yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*part, " "), pa.array(n[s : s + 65_536])], schema=schema)

    return shards.select("lang", "words", "sizes", "steps", "masks").mapInArrow(run, KEYED)


def _frequent(parts: DataFrame, least: int, name: str) -> DataFrame:
    """(lang, phrase, f) of the keys that occur ``least`` times."""
    found = parts.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrase = F.substring_index("key", GAP, -1)
    return common.stored(found.select(F.substr(F.col("key"), F.lit(1), F.length("key") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), "f"), name)


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD, entries: int = ENTRIES, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words (two at least) that occur ``least`` times in their language, as (lang, phrase, f), and (lang, n), the number of words.

    Words are joined by a space. ``bits``, a power of two of at least 8, sets only how much is counted in vain.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    shards = common.stored(_sharded(texts, shard), "shards", "zstd")
    n = shards.groupBy("lang").agg(F.sum("total").alias("n"))
    each = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    words = _frequent(each.select(F.concat("lang", F.lit(GAP), "w.words").alias("key"), F.col("w.counts").alias("f")), least, "words")
    known = spark.sparkContext.broadcast(_bit_table(words, bits))
    pairs = _frequent(_popcounts(shards, known, None, entries, longest), least, "pairs")
    if longest < 3:
        return words.unionByName(pairs), n
    held = spark.sparkContext.broadcast(_bit_table(pairs, bits))
    longer = _frequent(_popcounts(shards, known, held, entries, longest), least, "longer")
    return words.unionByName(pairs).unionByName(longer), n


def _part(words: Column, a, n) -> Column:
    return F.array_join(F.slice(words, a, n), " ")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, longest: int = LONGEST, percent: int = 80, **kinds) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score; all numbers long.

    Words are what spaces and tabs part within pieces, and pieces what
    ``.,;:!?`` and line breaks part; A-Z count as a-z. A phrase of two words and
    more that occurs a >= ``least`` times (overlaps included) scores
    floor(2000000 a / (l + r)) at its worst cut into a first part that occurs l
    times and a rest that occurs r times, ties to the shorter first part. Phrases
    that lie in a longer one with at least ``percent`` % of their count are left
    out. Ranks go by score, then a, both descending, then phrase in byte order.

    A null language counts as ``und``, a null text as empty; texts of any length
    are taken whole, and only a piece has to fit a task. Repeated rows count each.
    Other columns are not read. An empty table gives an empty result.
    """
    counts, n = frequent_phrases(docs, least, longest, **kinds)
    c = F.col
    big = lambda x: x.cast("decimal(38,0)")
    found = counts.where(F.instr("phrase", " ") > 0).select("lang", "phrase", c("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(c("w"), F.lit(1), c("k")).alias("left"), _part(c("w"), c("k") + 1, F.size("w") - c("k")).alias("right"))
    left, right = counts.select("lang", c("phrase").alias("left"), c("f").alias("l")), counts.select("lang", c("phrase").alias("right"), c("f").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    # the product in decimals; the quotient is no more than 1,000,000
    scored = scored.withColumn("score", F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")).drop("left", "right")
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"), F.first("a").alias("a"))
    inner = found.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - c("m") + 1)).alias("i")).select("lang", _part(c("w"), c("i"), c("m")).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = worst.join(inner, ["lang", "phrase"], "left").where(F.coalesce(big(c("most")) * 100 < big(c("a")) * percent, F.lit(True)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part"))
    # the best of each of 64 parts first: a language is never sorted by one task
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(c("at") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(c("rank") <= top)
    return rows.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
