"""Alignment of two tokenizers' tokens by the byte offsets where both end.

A is a byte-level tokenizer, B a sentence-piece model; both read a space and the text. Texts are cut into segments before a
space or line feed that follows anything but white space: a token of neither crosses such a place, and what they make of
a segment depends on nothing beyond it, so both end there and groups never cross it. Each distinct segment of the corpus is
tokenized once, and aligned once, in Spark: its tokens are exploded with their places, windowed sums of their byte lengths
give their ends, tokens of A and B meet on (segment, end), a running count of the ends where both meet numbers the groups,
and the tokens of a group are linked. A document is the sequence of its segments: its groups are theirs in a row.

Occurrences of segments are looked up in two ways, both exact: the most frequent ones, at most ``HOT`` short rows, are
broadcast, which covers most of a text without a shuffle; all others are joined by shuffle. Pairs of ids likewise. Equal
texts are worked out once and count as often as they occur.

Special tokens in texts are plain text. Null and empty texts, and texts whose joined token bytes differ from the space
and the text (such as those that hold U+2581, which stands for a space in B), have no tokens: zeros, no groups, and no
part in counts. Repeated rows count as documents each; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .pieces import MARK, model_of

#: Before a space or line feed that follows anything but white space.
EDGE = r"(?=[ \n])(?<![\s\x85\p{Z}])"
HOT, LONG = 1 << 19, 48


class Tokens:
    """Ids and byte lengths of segments by both tokenizers."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        vocab = self.a.get_vocab(with_added_tokens=True)
        # printable bytes stand for themselves, the others, in order, for the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b = model_of(piece_file)
        self.b_bytes = [b""] * self.b.n
        for piece, i in self.b.ids.items():
            self.b_bytes[i] = piece.replace(MARK, " ").encode()
        for byte, i in enumerate(self.b.bytes):
            self.b_bytes[i] = bytes([byte])

    def of_b(self, segments: list[str]) -> list[list[int]]:
        sym, unit = self.b.encode_units([s.replace(" ", MARK) for s in segments])
        ends = np.searchsorted(unit, np.arange(len(segments)), side="right").tolist()
        ids, start, out = sym.tolist(), 0, []
        for end in ends:
            out.append([x for s in ids[start:end] for x in ((s,) if s < self.b.n else [self.b.bytes[c] for c in chr(s - self.b.n).encode()])])
            start = end
        return out

    def of_a(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]


@functools.lru_cache(2)
def tokens_of(byte_file: str, piece_file: str) -> Tokens:
    return Tokens(byte_file, piece_file)


def tokenized(segment: Column, byte_file: str, piece_file: str) -> Column:
    """n_a, n_b, ids and lens (those of A, then those of B) of a segment, and whether both spell it."""

    @F.pandas_udf("n_a int, n_b int, good boolean, ids array<int>, lens array<smallint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        model = tokens_of(byte_file, piece_file)
        of_a, of_b, ids, lens, good = model.of_a(texts.tolist()), model.of_b(texts.tolist()), [], [], []
        for text, a, b in zip(texts, of_a, of_b, strict=True):
            said_a, said_b = [model.a_bytes[i] for i in a], [model.b_bytes[i] for i in b]
            ids.append(a + b)
            lens.append([*map(len, said_a), *map(len, said_b)])
            good.append(b"".join(said_a) == text.encode() == b"".join(said_b))
        return pd.DataFrame({"n_a": list(map(len, of_a)), "n_b": list(map(len, of_b)), "good": good, "ids": ids, "lens": lens})

    return run(segment)


#: What belongs to a segment and goes with its tokens.
OWN = ("segment", "n", "n_a", "n_b", "good")


def groups(tokens: DataFrame) -> DataFrame:
    """``OWN``, part (number of the group, from 0), end (of the group, in bytes), a, b (its ids) for each group of segments
    (``OWN``, ids, lens). Segments are dealt out once, before they are exploded; no later step moves a row."""
    each = tokens.repartition("segment").select(*OWN, F.posexplode(F.arrays_zip("ids", "lens")).alias("at", "t"))
    each = each.select(*OWN, "at", F.col("t.ids").alias("id"), F.col("t.lens").alias("len"), (F.col("at") >= F.col("n_a")).alias("of_b"))
    before = Window.partitionBy("segment", "of_b").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum("len").over(before))
    # both sides stand in the partition of their segment, so they are joined on (segment, end) by grouping
    ends = each.groupBy(*OWN, "end").agg(F.max(F.when(~F.col("of_b"), F.col("id"))).alias("a"), F.max(F.when(F.col("of_b"), F.col("id"))).alias("b"))
    cuts = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1))
    ends = ends.withColumn("part", cuts.over(Window.partitionBy("segment").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)))
    ids = lambda side: F.transform(F.sort_array(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", side)))), lambda x: x[side]).alias(side)
    return ends.groupBy(*OWN, "part").agg(F.max("end").alias("end"), ids("a"), ids("b"))


def linked_pairs(b_size: int, kind: str) -> tuple[Column, Column]:
    """The distinct id pairs of a group, as a * ``b_size`` + b, and how often each is linked, null if all are once."""
    counted = lambda side: F.transform(F.array_distinct(side), lambda x: F.struct(x.alias("id"), F.size(F.filter(side, lambda y: y == x)).alias("n")))
    pair = lambda x, y: (x.cast("long") * b_size + y).cast(kind)
    every = lambda of: F.flatten(F.transform(counted("a"), lambda x: F.transform(counted("b"), lambda y: of(x, y))))
    one = (F.size("a") == 1) & (F.size("b") == 1)
    links = F.when(one, F.array(pair(F.get("a", F.lit(0)), F.get("b", F.lit(0))))).otherwise(every(lambda x, y: pair(x["id"], y["id"])))
    repeats = (F.size(F.array_distinct("a")) < F.size("a")) | (F.size(F.array_distinct("b")) < F.size("b"))
    return links, F.when(repeats, every(lambda x, y: x["n"].cast("long") * y["n"]))


def aligned(df: DataFrame, byte_file: str, piece_file: str, text_col: str = "text") -> DataFrame:
    """One row per distinct segment of the texts: segment, n (its occurrences), good, n_a, n_b, n_groups, n_links, groups, links, times."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = df.where(text != "").select(F.explode(F.split(F.concat(F.lit(" "), text), EDGE)).alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))
    tokens = found.withColumn("t", tokenized(F.col("segment"), byte_file, piece_file)).select("segment", "n", "t.*")
    a_size, b_size = len(tokens_of(byte_file, piece_file).a_bytes), model_of(piece_file).n
    links, times = linked_pairs(b_size, "int" if a_size * b_size < 2**31 else "bigint")
    each = groups(tokens).withColumn("links", links).withColumn("times", times)
    ones = F.coalesce("times", F.array_repeat(F.lit(1).cast("long"), F.size("links")))
    said = F.concat(F.array_join("a", ","), F.lit("|"), F.array_join("b", ","))
    whole = each.groupBy(*OWN).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", said.alias("g")))), lambda x: x["g"]), ";").alias("groups"),
        F.count("*").alias("n_groups"), F.sum(F.size("a").cast("long") * F.size("b")).alias("n_links"), F.flatten(F.collect_list("links")).alias("links"),
        F.when(F.count("times") > 0, F.flatten(F.collect_list(ones))).alias("times"),
    )
    return staged(whole, "align-segments")


def common(table: DataFrame, key: str, limit: int = HOT) -> Column:
    """Which rows of ``table`` (``key``, n) are broadcast: at most ``limit``, those with the largest n, in steps of powers of two."""
    short = F.octet_length(key) <= LONG if dict(table.dtypes)[key] == "string" else F.lit(True)
    steps = table.where(short).groupBy(F.floor(F.log2("n")).cast("int").alias("step")).agg(F.count("*").alias("rows")).collect()
    total, least = 0, 63
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["rows"]
        if total > limit:
            break
        least = r["step"]
    return short & (F.floor(F.log2("n")) >= least)


def looked_up(rows: DataFrame, table: DataFrame, key: str, limit: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``rows`` joined with ``table`` on ``key`` in two parts: those with a common key, by broadcast, and the others, by shuffle."""
    hot = common(table, key, limit)
    many = F.broadcast(table.where(hot).drop("n"))
    return rows.join(many, key), rows.join(many.select(key), key, "left_anti").join(table.where(~hot).drop("n"), key)


def assembled(df: DataFrame, byte_file: str, piece_file: str, text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per distinct text that has tokens: node (its digest), copies, n_a, n_b, n_groups, n_links, groups, and links:
    the pairs of each segment with how often each is linked (null: once)."""
    table = aligned(df, byte_file, piece_file, text_col)
    text = F.col(text_col)
    texts = df.where(text != "").select(F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))
    texts = texts.groupBy("node").agg(F.count("*").alias("copies"), F.any_value("text").alias("text"))
    rows = texts.select("node", "copies", F.posexplode(F.split(F.concat(F.lit(" "), F.col("text")), EDGE)).alias("at", "segment"))
    sums = ["n_a", "n_b", "n_groups", "n_links"]

    def of_text(part: DataFrame, tag: str) -> DataFrame:
        out = part.groupBy("node").agg(
            F.any_value("copies").alias("copies"), F.bool_and("good").alias("good"), *(F.sum(c).alias(c) for c in sums),
            F.collect_list(F.struct("at", "groups")).alias("groups"), F.collect_list(F.struct("links", "times")).alias("links"),
        )
        return out.withColumnsRenamed({c: f"{c}_{tag}" for c in out.columns if c != "node"})

    many, few = (of_text(part, tag) for part, tag in zip(looked_up(rows, table, "segment", hot), ("x", "y"), strict=True))
    both = many.join(few, "node", "full")
    lists = lambda c: F.concat(*[F.coalesce(f"{c}_{t}", F.array()) for t in "xy"])
    out = both.where(F.coalesce("good_x", F.lit(True)) & F.coalesce("good_y", F.lit(True))).select(
        "node", F.coalesce("copies_x", "copies_y").alias("copies"), *((F.coalesce(f"{c}_x", F.lit(0)) + F.coalesce(f"{c}_y", F.lit(0))).cast("long").alias(c) for c in sums),
        F.array_join(F.transform(F.array_sort(lists("groups")), lambda x: x["groups"]), ";").alias("groups"), lists("links").alias("links"),
    )
    return out


def digests(df: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``df``."""
    b_size = model_of(piece_file).n
    texts = staged(assembled(df, byte_file, piece_file, text_col, hot).withColumn("groups", F.sha2("groups", 256)), "align-texts")
    pairs = F.array_distinct(F.flatten(F.transform("links", lambda x: x["links"])))
    counts = texts.select("copies", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("copies").alias("n"))
    counts = staged(counts.withColumn("a", F.expr(f"pair div {b_size}")), "align-pairs")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    scored = counts.join(best, "a").select("pair", "n", F.col("n").alias("documents"), (F.col("n") == F.col("most")).alias("best"))
    links = texts.select("node", F.explode("links").alias("x")).select("node", "x.times", F.posexplode("x.links").alias("at", "pair"))
    links = links.select("node", "pair", F.coalesce(F.get("times", F.col("at")), F.lit(1)).alias("m"))
    total = [F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("documents")).alias("count_sum")]
    many, few = looked_up(links, scored, "pair", hot)
    sums = many.groupBy("node").agg(*total).unionByName(few.groupBy("node").agg(*total)).groupBy("node").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    names = ["n_a", "n_b", "n_groups", "n_links"]
    of_text = texts.select("node", *names, F.col("groups").alias("groups_sha256")).join(sums, "node")
    docs = df.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("node"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*names, "n_best", "count_sum")]
    return docs.join(of_text, "node", "left").select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
