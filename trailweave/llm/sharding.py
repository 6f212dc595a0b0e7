"""Sharding by sampled splitters, by DataFrame expressions alone.

Records are keyed by the hash of the text, so equal texts stand together. Size-weighted splitters, quantiles of a sample of
the keys, cut them into ranges, and overfull ranges are subdivided; then those that a shard's border would fall into are
subdivided again until none is heavier than the slack of the law, ``SLACK`` of a shard's bytes. Each border lies between
two ranges, the nearest to its place, so a shard's bytes are within the slack of an equal share.

A group of equal texts that is lighter than the slack has one key and stays whole. In a heavier one each record has a key
of its own, of its id and its number among equal rows, so that group is cut wherever borders fall; there are at most
``n_shards / SLACK`` of them. Null text has no bytes (16 with its header) and the checksum of the empty text; an empty table
gives no rows. Only the ranges (``max_ranges``), the heavy groups and the shards reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_array, staged
from .ranges import key_of, with_ranges

HEADER = 16
SLACK = 0.05


def borders(ranges: list[dict], total: int, n_shards: int) -> list[int]:
    """The shard of each range: the border k lies at the range edge that is nearest to k n-ths of all bytes."""
    out, ahead, shard = [], 0, 0
    for r in ranges:
        # a range goes to the next shard once its middle lies beyond the border
        while shard < n_shards - 1 and 2 * ahead + r["weight"] > 2 * (shard + 1) * total / n_shards:
            shard += 1
        out.append(shard)
        ahead += r["weight"]
    return out


def assign(df: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 50_000, max_ranges: int = 65_536) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``df``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + HEADER).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"))
    rows = staged(rows.groupBy("doc_id", "size", "text_crc32", "hash").agg(F.count("*").alias("copies")), "shard-keys")
    n, total = rows.agg(F.sum("copies"), F.sum(F.col("size") * F.col("copies"))).first()
    total = total or 0
    slack = SLACK * total / n_shards
    groups = rows.groupBy("hash").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")).where(F.col("bytes") > slack)
    heavy = literal_array([r["hash"] for r in groups.collect()], "bigint")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    own = F.when(F.array_contains(heavy, F.col("hash")), F.xxhash64("doc_id", "copy"))
    rows = rows.withColumn("key", key_of(F.col("hash"), own)).withColumn("weight", F.col("size"))
    parts = min(max_ranges, max(8 * n_shards, (n or 0) // rows_per_range))
    rows, ranges, _ = with_ranges(rows, parts, cuts=n_shards, least=slack)
    shards, first, ahead = borders(ranges, total, n_shards), {}, []
    before = 0
    for r, shard in zip(ranges, shards, strict=True):
        first.setdefault(shard, before)
        ahead.append(before - first[shard])
        before += r["rows"]
    last = max((r["range"] for r in ranges), default=-1) + 1
    dense = lambda values: literal_array([dict(zip((r["range"] for r in ranges), values, strict=True)).get(i, 0) for i in range(last)] or [0], "bigint")
    within = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32", "copy")
    slot = F.row_number().over(within) - 1 + F.get(dense(ahead), F.col("range"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.get(dense(shards), F.col("range")).cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows of ``df`` under ``path``/shard=N in order of slot, and return the assignment.

    A row finds its place by its id and text; rows that share both are interchangeable and share one lookup.
    """
    placed = assign(df, n_shards, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lone = Window.partitionBy("__id", "__crc", "__size")
    left = df.withColumns({"__id": F.col(id_col), "__crc": F.crc32(text.cast("binary")), "__size": (F.octet_length(text) + HEADER).cast("long")})
    left = left.withColumn("__k", F.row_number().over(lone.orderBy(F.lit(0))))
    right = placed.select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), F.col("size").alias("__size"), "shard", "slot")
    right = right.withColumn("__k", F.row_number().over(lone.orderBy("shard", "slot")))
    same = left["__id"].eqNullSafe(right["__id"]) & (left["__crc"] == right["__crc"]) & (left["__size"] == right["__size"]) & (left["__k"] == right["__k"])
    out = left.join(right, same).select(*[left[c] for c in df.columns], right["shard"], right["slot"])
    out.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed
