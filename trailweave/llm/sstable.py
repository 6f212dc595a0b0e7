"""Token ids in sorted-string-table shards, written and read back.

A table holds records (key, value) in ascending key order. Its layout, little-endian:

    block*   zlib of: entry*, then the entry offsets of the restart points (u32 each) and their number (u32)
    index    per block: length of its last key (u16), the key, offset (u64), length (u32), crc32 of the block (u32)
    bloom    number of hashes (u8), then the bits
    footer   index offset, bloom offset, records, ids (u64 each), bytes per id (u8), then the magic b"TWSST\\x01"

An entry is three varints (key bytes shared with the entry before, key bytes that follow, value bytes), the rest of the
key, and the value: the ids, two or four bytes each. Every ``RESTART``-th entry shares nothing, so a lookup asks the
Bloom filter, searches the sparse index by halves, reads one block and searches its restart points by halves. A key is
the identifier as a big-endian number with its sign bit turned, nine bytes with a first byte of 0 for null, so bytes
sort as identifiers do, nulls first.

Documents are cut into ranges of ascending identifiers by sampled splitters; each range is one task that rolls over to
a new file every ``file_bytes``, so neither a file nor a task's memory grows with the table. Files are named by range
and number and written under a passing name first, so a task that runs again replaces its own files. Null text has only
the end id; repeated identifiers are separate records, in order of a hash of their texts; an empty table writes no file.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_array, shared_folder, staged
from .ranges import key_of, range_of, with_ranges

MAGIC = b"TWSST\x01"
FOOTER = struct.Struct("<4QB6s")
INDEX = struct.Struct("<QII")
RESTART = 16
BLOCK_BYTES = 1 << 16
CACHE = 500_000
CHUNK = 1_500_000
#: Units that the library encodes at once.
LINES = 200
#: Stands between units while a text is being split; it is no character, and a text that holds it all the same goes to the library whole.
CUT = "\ufdd0"


def key_bytes(identifier: int | None) -> bytes:
    return bytes(9) if identifier is None else b"\x01" + (identifier + 2**63).to_bytes(8, "big")


def identifier_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - 2**63 if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9747B28C) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class TableWriter:
    """Collects records in key order and makes the bytes of one table."""

    def __init__(self, width: int):
        self.width, self.out, self.index, self.keys = width, bytearray(), bytearray(), []
        self.block, self.restarts, self.last, self.n, self.ids = bytearray(), [], b"", 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        if len(self.block) >= BLOCK_BYTES:
            self._flush()
        shared = 0
        if self.n % RESTART == 0 or not self.restarts:
            self.restarts.append(len(self.block))
            self.n = 0
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        self.keys.append(key)
        self.ids += len(value) // self.width

    def _flush(self) -> None:
        if not self.restarts:
            return
        packed = zlib.compress(bytes(self.block) + b"".join(struct.pack("<I", r) for r in self.restarts) + struct.pack("<I", len(self.restarts)), 1)
        self.index += struct.pack("<H", len(self.last)) + self.last + INDEX.pack(len(self.out), len(packed), zlib.crc32(packed))
        self.out += packed
        self.block, self.restarts, self.n = bytearray(), [], 0

    @property
    def size(self) -> int:
        return len(self.out) + len(self.block)

    def finish(self, bits_per_key: int = 10, hashes: int = 7) -> bytes:
        self._flush()
        bits = np.zeros(max(64, -(-bits_per_key * len(self.keys) // 8) * 8), bool)
        for key in self.keys:
            bits[bloom_places(key, bits.size, hashes)] = True
        bloom = bytes([hashes]) + np.packbits(bits, bitorder="little").tobytes()
        at = len(self.out)
        return bytes(self.out) + bytes(self.index) + bloom + FOOTER.pack(at, at + len(self.index), len(self.keys), self.ids, self.width, MAGIC)


class Table:
    """Reads the bytes of one table."""

    def __init__(self, data: bytes):
        index, bloom, self.records, self.ids, self.width, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a sorted-string table")
        self.data, self.blocks, at = data, [], index
        while at < bloom:
            n = struct.unpack_from("<H", data, at)[0]
            self.blocks.append((data[at + 2 : at + 2 + n], *INDEX.unpack_from(data, at + 2 + n)))
            at += 2 + n + INDEX.size
        self.hashes = data[bloom]
        self.bits = np.unpackbits(np.frombuffer(data[bloom + 1 : -FOOTER.size], np.uint8), bitorder="little")

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        _, at, size, crc = self.blocks[i]
        packed = self.data[at : at + size]
        if zlib.crc32(packed) != crc:
            raise ValueError(f"block {i} is damaged")
        raw = zlib.decompress(packed)
        n = struct.unpack("<I", raw[-4:])[0]
        end = len(raw) - 4 - 4 * n
        return raw, list(struct.unpack_from(f"<{n}I", raw, end)), end

    def _entries(self, raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = read_varint(raw, at)
            more, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + more]
            at += more
            yield key, raw[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            raw, _, end = self._block(i)
            yield from self._entries(raw, 0, end)

    def get(self, key: bytes) -> list[bytes]:
        """The values under a key."""
        if not all(self.bits[p] for p in bloom_places(key, self.bits.size, self.hashes)):
            return []
        low, high = 0, len(self.blocks)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.blocks[middle][0] < key else (low, middle)
        found = []
        for i in range(low, len(self.blocks)):
            raw, restarts, end = self._block(i)
            a, b = 0, len(restarts)
            while b - a > 1:  # the last restart point whose key is below the one sought
                middle = (a + b) // 2
                a, b = (middle, b) if next(self._entries(raw, restarts[middle], end))[0] < key else (a, middle)
            for k, value in self._entries(raw, restarts[a], end):
                if k > key:
                    return found
                if k == key:
                    found.append(value)
        return found


class UnitEncoder:
    """Ids of whole texts by a byte-level tokenizer, each distinct unit encoded by the library once.

    A unit is a word with the space before it, or a run of white space up to its last character. The tokenizer's own
    splitting crosses none of these points, and what it makes of a unit depends on nothing beyond it, so the ids of a text
    are those of its units in a row. A text that holds an added token, at which the library cuts first, goes to it whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.feed = self.library.encode("\n", add_special_tokens=False).ids[0]
        # white space to the library, which doesn't count the four separators from 1C to 1F as such
        blank, other = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
        self.double = re.compile(blank + blank)
        self.unit = re.compile(f" ?{other}+|{blank}+(?!{other})|{blank}")
        #: What was used lately, and what was used before that.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _cut(self, text: str) -> str:
        """The text with a mark between its units."""
        if self.double.search(text):
            return CUT.join(self.unit.findall(text))
        return text.replace(" ", CUT + " ").replace("\n", CUT + "\n" + CUT)

    def _learn(self, new: list[str]) -> None:
        """Encode new units: words go as lines of one text. A line feed between words, or before the space of one, is a token
        by itself, so the tokens between line feeds are those of the words."""
        words = [u for u in new if u.isprintable() and u[-1:] != " " and u]  # what is printable holds no other blank
        for i in range(0, len(words), LINES):
            part = words[i : i + LINES]
            ids = np.array(self.library.encode("\n".join(part), add_special_tokens=False).ids, self.kind)
            cuts = np.flatnonzero(ids == self.feed) * self.width
            if cuts.size != len(part) - 1:
                raise ValueError("units and line feeds don't match")
            whole, ends = ids.tobytes(), [*cuts.tolist(), ids.nbytes]
            starts = [0, *(cuts + self.width).tolist()]
            self.young.update(zip(part, map(whole.__getitem__, map(slice, starts, ends)), strict=True))
        for u in set(new).difference(words):
            self.young[u] = np.array(self.library.encode(u, add_special_tokens=False).ids, self.kind).tobytes()

    def _values(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units: from the young half of the cache, the old half, or the library."""
        if len(self.young) > CACHE // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = [u for u in units if u not in young]
        found = [u for u in missing if u in old]
        young.update(zip(found, map(old.__getitem__, found), strict=True))
        self._learn([u for u in missing if u not in young])
        return list(map(young.__getitem__, units))

    def encode(self, texts: list[str], end: int | None) -> Iterator[bytes]:
        """The ids of each text. Units are told apart and put in their places by whole columns, a chunk of texts at a time."""
        tail = b"" if end is None else np.array([end], self.kind).tobytes()
        at = 0
        while at < len(texts):
            cut, size, whole = [], 0, {}
            while at < len(texts) and (size < CHUNK or not cut):
                text = texts[at]
                if CUT in text or any(t in text for t in self.added):
                    whole[len(cut)] = np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes() + tail
                cut.append("" if len(cut) in whole else self._cut(text))
                size += len(text)
                at += 1
            split = pc.split_pattern(pa.array(cut, pa.large_string()), CUT)
            units = split.flatten().dictionary_encode()
            values = self._values(units.dictionary.to_pylist())
            pool, sizes = np.frombuffer(b"".join(values), self.kind), np.fromiter(map(len, values), np.int64, len(values)) // self.width
            which = units.indices.to_numpy()
            starts, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
            ends = np.cumsum(n)
            ids = pool[np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if ends.size else 0)]
            edges = np.r_[0, ends][np.asarray(split.offsets)]
            for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                yield whole.get(k) or ids[i:j].tobytes() + tail


@functools.lru_cache(2)
def encoder_of(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(df: DataFrame, folder: str, tokenizer_file: str, end: int | None = 0, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 4 << 20, bytes_per_range: int = 16 << 20, max_ranges: int = 65_536) -> DataFrame:
    """Encode and write all rows as tables under ``folder``; returns path, range, part, records, ids of each table."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = key_of(F.col("doc_id"), F.xxhash64("text"))
    keys = staged(rows.select(key.alias("key"), (F.octet_length("text") + 64).cast("long").alias("weight")), "sstable-keys")
    total = keys.agg(F.sum("weight")).first()[0] or 0
    _, _, splitters = with_ranges(keys, min(max_ranges, max(1, total // bytes_per_range)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, (store, root) = encoder_of(tokenizer_file), filesystem(folder)
        table, where, part = TableWriter(encoder.width), None, 0

        for batch in batches:
            for identifier, at, value in zip(batch["doc_id"], batch["range"], encoder.encode(batch["text"].tolist(), end), strict=True):
                if where is not None and (at != where or table.size >= file_bytes):
                    yield saved(store, root, where, part, table)
                    table, part = TableWriter(encoder.width), part + 1 if at == where else 0
                where = at
                table.add(key_bytes(None if pd.isna(identifier) else int(identifier)), value)
        if where is not None:
            yield saved(store, root, where, part, table)

    placed = rows.withColumn("key", key).withColumn("range", range_of(splitters)).repartitionById(len(splitters) + 1, F.col("range"))
    placed = placed.sortWithinPartitions("range", "key").select(F.col("doc_id").cast("string").alias("doc_id"), "range", "text")
    return placed.mapInPandas(run, "path string, range int, part int, records long, ids long")


def saved(store, root: str, where: int, part: int, table: TableWriter) -> pd.DataFrame:
    name = f"{where:05d}-{part:05d}.sst"
    passing, data = f"{root}/.{name}.{uuid.uuid4().hex}", table.finish()
    with store.open_output_stream(passing) as out:
        out.write(data)
    store.move(passing, f"{root}/{name}")
    return pd.DataFrame({"path": [f"{root}/{name}"], "range": [where], "part": [part], "records": [len(table.keys)], "ids": [table.ids]})


def read(spark, folder: str) -> DataFrame:
    """range, part, place (gapless from 0 in the file), doc_id (as text), before (ids ahead of it in its file), ids as bytes, width."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                where, part = path.rpartition("/")[2].removesuffix(".sst").split("-")
                table, rows, before = Table(data), [], 0
                for place, (key, value) in enumerate(table):
                    identifier = identifier_of(key)
                    rows.append((int(where), int(part), place, None if identifier is None else str(identifier), before, value, table.width))
                    before += len(value) // table.width
                yield pd.DataFrame(rows, columns=["range", "part", "place", "doc_id", "before", "ids", "width"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder)
    return files.select("path", "content").mapInPandas(run, "range int, part int, place int, doc_id string, before long, ids binary, width int")


def digests(df: DataFrame, tokenizer_file: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files: one row per row of ``df``."""
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/sstable-{uuid.uuid4().hex}"
    store, root = filesystem(folder)
    store.create_dir(root)
    files = staged(write(df, folder, tokenizer_file, end, id_col, text_col), "sstable-files")
    ranges: dict[int, int] = {r["range"]: r["ids"] for r in files.groupBy("range").agg(F.sum("ids").alias("ids")).collect()}
    ahead, n = [], 0
    for i in range(max(ranges, default=-1) + 1):
        ahead.append(n)
        n += ranges.get(i, 0)
    if not ranges:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    before = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("range", "part", (F.coalesce(F.sum("ids").over(before), F.lit(0)) + F.get(literal_array(ahead, "bigint"), F.col("range"))).alias("ahead"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(v, f"<u{w}").astype("<u4").tobytes()) for v, w in zip(b["ids"], b["width"], strict=True)]
            n = [len(v) // w for v, w in zip(b["ids"], b["width"], strict=True)]
            yield b[["range", "part", "doc_id", "before"]].assign(n_tokens=n, ids_crc32=crc)

    rows = read(spark, folder).mapInPandas(run, "range int, part int, doc_id string, before long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["range", "part"]).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
