"""Near-duplicates by SimHash: fingerprints of 64 bits, linked where at most ``BITS`` of them differ.

A text is its sequence of words, lower-cased A-Z; a feature is a shingle of ``K`` words joined by a space, each occurrence
counting once (a shorter text is one shingle). A bit of the fingerprint is set if it is set in over half of the features'
XXH64 values (seed 42). A text without words has the fingerprint 0 and is linked like any other.

Equal fingerprints fall together first. Each distinct one is cut into four blocks of 16 bits; of two that differ in at
most two bits two blocks at least are equal, so each is entered in six buckets, one for each pair of blocks. In a bucket
of up to ``FEW`` members all pairs are met and their Hamming distance is verified. In a larger one, where that would be
the square of its members, each member is entered under itself and under each fingerprint that differs from it in one of
the 32 bits that the bucket leaves open. Two members share such an entry just if at most two bits differ, so the members
of an entry, at most 33, are all linked to its least one: exact, and a fixed number of rows for each member. Classes are
the connected components.

Null text is empty. Repeated rows belong to one class, which is named by its least id, null if no member has one; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, map_batches, staged
from .components import components

K, BITS, SEED = 3, 2, 42
BLOCKS, WIDTH = 4, 16
FEW = 32
#: Features whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str) -> int:
    """The fingerprint of a text, as a signed long."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    k, whole = min(K, len(words)), b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - k + 1]
    parts = map(whole.__getitem__, map(slice, starts.tolist(), (ends[k - 1 :] - 1).tolist()))
    h = np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, starts.size)
    set_in = np.zeros(64, np.int64)
    for i in range(0, h.size, CHUNK):
        set_in += np.unpackbits(h[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > h.size).view(">i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (the fingerprint as a long): one row per row of ``df``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "print": np.array([fingerprint(t) for t in batch["text"]], np.int64)})

    return map_batches(df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id", run, "print bigint")


def block_masks() -> list[int]:
    """For each pair of blocks the bits that it covers, as signed longs."""
    block = lambda i: ((1 << WIDTH) - 1) << (WIDTH * i)
    both = [block(i) | block(j) for i, j in combinations(range(BLOCKS), 2)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


def one_bit_changes(mask: Column, value: Column) -> Column:
    """``value`` and what it becomes by changing one bit that ``mask`` does not cover."""
    ones = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    free = F.filter(ones, lambda b: b.bitwiseAND(mask) == 0)
    return F.concat(F.array(value), F.transform(free, lambda b: value.bitwiseXOR(b)))


def links(prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of the distinct fingerprints ``print``, u > v, whose components are those of all pairs within ``BITS``."""
    masks = F.array(*[F.lit(m) for m in block_masks()])
    entries = prints.select("print", F.explode(masks).alias("mask")).withColumn("block", F.col("print").bitwiseAND(F.col("mask")))
    sizes = entries.groupBy("mask", "block").agg(F.count("*").alias("size")).where("size > 1")
    entries = staged(entries.join(sizes, ["mask", "block"]), "simhash-entries")
    small = entries.where(F.col("size") <= FEW)
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS
    pairs = small.select("mask", "block", F.col("print").alias("u")).join(small.select("mask", "block", F.col("print").alias("v")), ["mask", "block"])
    pairs = pairs.where(F.col("u") > F.col("v")).where(near).select("u", "v")
    changed = entries.where(F.col("size") > FEW).select("mask", "block", "print", F.explode(one_bit_changes(F.col("mask"), F.col("print"))).alias("entry"))
    least = F.min("print").over(Window.partitionBy("mask", "block", "entry"))
    stars = changed.select(F.col("print").alias("u"), least.alias("v")).where(F.col("u") > F.col("v"))
    out = staged(pairs.unionByName(stars).distinct(), "simhash-links")
    forget(entries)
    return out


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per row of ``df``."""
    docs = staged(fingerprints(df, id_col, text_col), "simhash-prints")
    prints = staged(docs.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(prints))
    tied = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = tied.join(tied.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("print", "component_id")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return docs.join(named, "print").select("doc_id", digits.alias("fingerprint"), "component_id")
