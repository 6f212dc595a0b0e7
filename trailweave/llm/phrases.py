"""Phrase collocations from suffix arrays over word ids.

Texts are lower-cased A-Z and cut into pieces at ``[.,;:!?]`` and line ends, and pieces into words at spaces and tabs. A
shard is what a task has read of a language up to ``BYTES`` bytes: its words are numbered, pieces and texts end with a
number that no word has, and the suffixes of that sequence are sorted by prefix doubling, as far as phrases are long. In
the sorted order the suffixes that begin with the same n words stand together; those intervals of the common-prefix
lengths give each phrase of n words its count in the shard. Shards send one row for each distinct phrase, and counts are
summed by language and phrase.

Phrases are counted length by length. A phrase can't occur more often than its first and last n - 1 words, so a shard sends
only those of which both are among the counts of ``least`` or more; it asks a Bloom filter of at most ``MOST_BITS`` bits,
which lets through some that a sum then finds to be too rare, and never holds one back.

A candidate of two or more words and ``least`` or more occurrences is cut after each of its words in turn: with l and r
the counts of both parts, the score is floor(10^6 * a * a / (l * r)) in decimal arithmetic of 38 digits, and the lowest
score, of the shortest first part among equals, counts. Candidates that a longer candidate holds go if that one has at
least ``share`` hundredths of their occurrences.

Null text has no words, null language is ``und``, repeated rows count each, an empty table gives no rows. Scores are exact
while a phrase occurs less than 10^16 times. The best ``top`` of a language are found among the best of hashed parts, so
no task orders all candidates of a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Bytes of text in a shard, some six hundred thousand words.
BYTES = 4_000_000
#: Rows that are handed to Spark at once.
ROWS = 100_000
#: Ends a piece; a mark itself, so no word is like it.
END = "."
MARKS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(MARKS + bytes(range(65, 91)), b"." * len(MARKS) + bytes(range(97, 123)))
PARTS = 64
HASHES, LEAST_BITS, MOST_BITS = 3, 1 << 16, 1 << 26


class Shard:
    """Texts of one language, made ready to be cut into words and piece ends at blanks alone."""

    def __init__(self):
        self.texts: list[bytes] = []
        self.size = 0

    def add(self, text: str) -> None:
        self.texts.append(text.encode().translate(TABLE).replace(b".", b" . ") + b" .")
        self.size += len(text) + 1

    def words(self) -> pa.DictionaryArray:
        """The words in order, ``END`` after each piece, each distinct one numbered."""
        cut = pc.ascii_split_whitespace(pa.array(self.texts, pa.large_binary()).cast(pa.large_string())).flatten()
        return cut.filter(pc.not_equal(cut, "")).dictionary_encode()


def doubled(rank: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, from 1, of the first 2 * ``step`` symbols of each suffix from those of the first ``step``, and the suffixes in
    that order; 0 stands beyond the end."""
    key = rank.astype(np.int64) * (int(rank.max(initial=0)) + 1)
    key[: rank.size - step] += rank[step:]
    order = np.argsort(key)
    ranked = key[order]
    out = np.empty_like(rank)
    out[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]])
    return out, order


def suffix_order(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first words, and the length, up to ``longest``, of what each shares with the one before.

    ``ids`` are above 0. Ranks by 1, 2, 4, ... symbols are doubled until they tell phrases of ``longest`` words apart; from
    the widest to the narrowest they give the common prefix of two neighbours in so many steps.
    """
    ranks, step, order = [ids], 1, None
    while step < longest:
        rank, order = doubled(ranks[-1], step)
        ranks.append(rank)
        step *= 2
    order = np.argsort(ids) if order is None else order
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(0, order.size - 1), np.int32)
    for rank in reversed(ranks):
        padded = np.r_[rank, np.array([0, -1], rank.dtype)]  # beyond the end nothing is equal
        same = padded[np.minimum(a, rank.size)] == padded[np.where(b >= rank.size, rank.size + 1, b)]
        shared += step * same
        a += step * same
        b += step * same
        step //= 2
    return order, np.r_[0, np.minimum(shared, longest)][: order.size]


class Filter:
    """A Bloom filter over the XXH64 values (seed 42) of keys."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, rows: DataFrame) -> Filter:
        """The filter of the keys (lang, phrase) of ``rows``; its words of 64 bits come to the driver, not the keys."""
        size = LEAST_BITS
        n = rows.count()
        while size < min(16 * n, MOST_BITS):
            size *= 2
        h = F.xxhash64(F.concat("lang", F.lit("\n"), "phrase"))
        low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)
        places = F.explode(F.array(*[F.pmod(low + i * high, F.lit(size)) for i in range(HASHES)]))
        words = rows.select(places.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits")).toArrow()
        bits = np.zeros(size // 64, np.int64)
        bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        return cls(bits)

    def holds(self, lang: str, phrases: list[str]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        h = np.fromiter(map(xxh64_intdigest, map(f"{lang}\n".__add__, phrases), repeat(42)), np.uint64, len(phrases))
        low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64)
        out = np.ones(h.size, bool)
        for i in range(HASHES):
            at = (low + i * high) % (64 * self.bits.size)
            out &= (self.bits[at >> 6] >> (at & 63) & 1).astype(bool)
        return out


def joined(names: pa.Array, ids: np.ndarray, starts: np.ndarray, n: int) -> pa.Array:
    """The ``n`` words from each start on, joined by spaces."""
    parts = [names.take(pa.array(ids[starts + k] - 1)) for k in range(n)]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", names.type)) if n > 1 else parts[0]


def phrase_counts(shard: Shard, n: int, lang: str = "", known: Filter | None = None) -> tuple[pa.Array, np.ndarray]:
    """Each distinct phrase of ``n`` words in a shard, and its count; with ``known``, the filter of phrases of n - 1 words,
    only those whose both such parts it holds."""
    words = shard.words()
    ids, names = words.indices.to_numpy() + np.int32(1), words.dictionary
    end = pc.index(names, END).as_py()
    if n == 1:
        some = np.delete(np.arange(len(names)), end)
        return names.take(pa.array(some)), np.bincount(ids)[some + 1]
    at = np.arange(ids.size, dtype=np.int32)
    stop = np.minimum.accumulate(np.where(ids == end + 1, at, ids.size)[::-1])[::-1]
    room = stop - at  # words from here to the end of the piece
    order, shared = suffix_order(ids, n)
    starts = np.flatnonzero(shared < n)
    count, first = np.diff(np.r_[starts, order.size]), order[starts]
    good = room[first] >= n
    if known is not None:
        begin = np.flatnonzero(shared < n - 1)
        heads = order[begin]
        whole = np.flatnonzero(room[heads] >= n - 1)
        good_head = np.zeros(begin.size, bool)
        good_head[whole] = known.holds(lang, joined(names, ids, heads[whole], n - 1).to_pylist())
        often = np.zeros(ids.size, bool)
        often[order] = np.repeat(good_head, np.diff(np.r_[begin, order.size]))
        good &= often[first] & often[np.minimum(first + 1, ids.size - 1)]
    first, count = first[good], count[good]
    return joined(names, ids, first, n), count


def counted(df: DataFrame, n: int, known: Filter | None = None, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = BYTES) -> DataFrame:
    """lang, phrase, f: the occurrences of phrases of ``n`` words; for n = 1 the phrase without words has those of all words."""
    held_back = None if known is None else df.sparkSession.sparkContext.broadcast(known.bits)

    def rows(lang: str, shard: Shard) -> Iterator[pa.RecordBatch]:
        phrase, f = phrase_counts(shard, n, lang, None if held_back is None else Filter(held_back.value))
        if n == 1:
            phrase, f = pa.concat_arrays([phrase, pa.array([""], phrase.type)]), np.r_[f, f.sum()]
        phrase = phrase.cast(pa.string())
        for i in range(0, f.size, ROWS):
            part = slice(i, i + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * f[part].size), phrase[part], pa.array(f[part])], ["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = shards.get(lang) or shards.setdefault(lang, Shard())
                shard.add(text)
                held += len(text) + 1
                if held >= shard_bytes:  # the fullest language makes room
                    most = max(shards, key=lambda x: shards[x].size)
                    held -= shards[most].size
                    yield from rows(most, shards.pop(most))
                    pa.default_memory_pool().release_unused()
        for lang, shard in shards.items():
            yield from rows(lang, shard)

    # no piece crosses a line feed, and a batch of lines is small whatever the texts
    lines = F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), lines.alias("text"))
    return texts.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent(df: DataFrame, longest: int, least: int, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = BYTES) -> DataFrame:
    """lang, phrase, k, f of all phrases of up to ``longest`` words with ``least`` or more occurrences; k is 0 for all words."""
    known, out = None, None
    for n in range(1, longest + 1):
        some = counted(df, n, known, lang_col, text_col, shard_bytes).where((F.col("f") >= least) | (F.col("phrase") == ""))
        some = staged(some.withColumn("k", F.when(F.col("phrase") == "", 0).otherwise(n)), "phrase-counts")
        known = Filter.of(some.where("k > 0")) if n < longest else None
        out = some if out is None else out.unionByName(some)
    return out


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, shard_bytes: int = BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language."""
    counts = frequent(df, longest, least, lang_col, text_col, shard_bytes)
    some = counts.where(F.col("k") > 1).select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = some.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    known = counts.where((F.col("k") > 0) & (F.col("k") < longest))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(19, 0)) * a * 1000000) div (cast(l as decimal(19, 0)) * r)"))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("m")
    scored = cuts.groupBy("lang", "phrase", "k", "a").agg(lowest)
    # what each phrase inside a longer candidate is held against: the most occurrences of one that holds it
    spans = F.expr(f"flatten(transform(sequence(2, {max(2, longest - 1)}), n -> if(k > n, transform(sequence(1, k - n + 1), i -> array_join(slice(w, i, n), ' ')), array())))")
    inner = some.where(F.col("k") > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(spans)).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    left = left.select("lang", "phrase", "a", "m.l", "m.r", "m.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    total = counts.where(F.col("k") == 0).select("lang", F.col("f").alias("n"))
    out = left.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return out
