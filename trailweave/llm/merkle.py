"""Document fingerprints: a Merkle tree over paragraphs and sections, by DataFrame expressions alone.

A paragraph is a line; it is cut into leaves of ``LEAF`` code points. A section ends after each paragraph whose last leaf
has a digest that ends in one of ``LAST``, every eighth on average, so sections are cut by content and a line put in or
taken out changes the section it lies in (or joins or parts two) and leaves all others as they are. The sections make the
root. The fingerprint writes the tree out: ``root:section=leaf,leaf;leaf|section=...``. Equal roots mean equal texts;
where roots differ, the sections and then the leaves that differ show where the edit lies. Likeness is the share of
common leaves, 2 * common / (leaves of one + leaves of the other), each counted once.

Null text is the empty text, which has one empty leaf. Repeated rows count as separate documents, ordered by id and then
by a hash of the text; a null id comes after all others. An empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_array, staged
from .ranges import key_of, range_of, with_ranges

LEAF = 96
LAST = ("0", "8")


def digest(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def leaves(text: Column) -> Column:
    """Per paragraph, the digests of its leaves."""
    cut = lambda p: F.when(p == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{LEAF}}}"), F.lit(0)))
    return F.transform(F.split(text, "\n"), lambda p: F.transform(cut(p), digest))


def fingerprint(leaves: Column) -> Column:
    """The tree over the leaves, written out."""
    ended = lambda p: F.concat(p, F.when(F.right(p, F.lit(1)).isin(*LAST), "|").otherwise(";"))
    written = F.array_join(F.transform(leaves, lambda p: ended(F.array_join(p, ","))), "")
    sections = F.split(F.substring(written, F.lit(1), F.length(written) - 1), r"\|")
    signed = F.transform(sections, lambda s: F.concat(digest(s), F.lit("="), s))
    return F.concat(F.sha2(F.array_join(signed, "|").cast("binary"), 256), F.lit(":"), F.array_join(signed, "|"))


def likeness(a: Column, b: Column) -> Column:
    """Of two flat arrays of leaves."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def leaves_of(fingerprint: Column) -> Column:
    """The leaves of a written tree."""
    return F.split(F.regexp_replace(F.split_part(fingerprint, F.lit(":"), F.lit(2)), "[0-9a-f]{16}=", ""), "[,;|]")


def with_next(df: DataFrame, id_col: str, text_col: str, bytes_per_range: int = 8 << 20, max_ranges: int = 65_536) -> tuple[DataFrame, Window]:
    """Rows with doc_id, text, guest and the window in which the next row is the next lower id (the highest, for the lowest).

    Ids are cut into ranges of bounded bytes; the first row of each range also goes, as a guest, to the range that
    precedes it in the order, so one shuffle of the texts serves all. Guests are to be dropped in the end.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # keys ascend with the ids and are read downwards; null ids have the lowest key and so come last
    key = key_of(F.col("doc_id"), F.xxhash64("text"))
    keys = staged(rows.select(key.alias("key"), (F.octet_length("text") + 64).cast("long").alias("weight")), "merkle-keys")
    total = keys.agg(F.sum("weight")).first()[0] or 0
    ranged, _, splitters = with_ranges(keys, min(max_ranges, max(1, total // bytes_per_range)))
    tops = {r["range"]: (r["top"]["a"], r["top"]["b"]) for r in ranged.groupBy("range").agg(F.max("key").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    to = {r: order[i - 1] for i, r in enumerate(order)}
    n = max(tops, default=-1) + 1
    top = literal_array([dict(zip("ab", tops[i], strict=True)) if i in tops else None for i in range(n)], "struct<a:bigint,b:bigint>")
    home = F.struct(F.col("range"), F.lit(0).alias("guest"))
    away = F.struct(F.get(literal_array([to.get(i) for i in range(n)], "int"), F.col("range")).alias("range"), F.lit(1).alias("guest"))
    rows = rows.withColumn("key", key).withColumn("range", range_of(splitters))
    rows = rows.withColumn("at", F.explode(F.when(F.col("key") == F.get(top, F.col("range")), F.array(home, away)).otherwise(F.array(home))))
    # one task for about one range, however few partitions a session has by default
    rows = rows.select("doc_id", "text", "key", "at.range", "at.guest").repartition(len(splitters) + 1, "range")
    return rows, Window.partitionBy("range").orderBy("guest", F.col("key").desc())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per row of ``df``.

    The edited text is the text with its last third replaced by as many first code points of the next document's text.
    """
    rows, order = with_next(df, id_col, text_col)
    rows = rows.withColumn("n_chars", F.length("text")).withColumn("third", F.expr("n_chars div 3"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - third as int))"), F.expr("substring(next_text, 1, cast(third as int))"))
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("edited", edited)
    rows = rows.withColumn("own", leaves(F.col("text"))).withColumn("flat", F.flatten("own"))
    rows = rows.withColumn("next_flat", F.lead("flat").over(order)).where("guest = 0")
    rows = rows.withColumn("new", leaves(F.col("edited"))).withColumn("new_flat", F.flatten("new"))
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("flat"), F.col("new_flat")).alias("near_edited"),
        likeness(F.col("flat"), F.col("next_flat")).alias("near_next"),
    )
