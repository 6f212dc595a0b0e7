"""SentencePiece encoding in vectorised merge rounds.

Text splits into units that no merge can cross: a run of word marks with the characters up to the next one, and each
line feed; and a unit is cut again between characters that stand side by side in no piece, so a long text without blanks
is not one unit that every round passes over. The distinct units of a chunk of texts lie in one flat numpy array of symbols. In each round every unit finds
the least rank among its adjacent pairs and merges all its pairs of that rank at once, leftmost first; merged symbols are
closed up, and units in which no pair is left go out. Where a merge gives rise to a pair that ranks no worse, the merges
to its right in that unit wait for the next round, so the result is that of merging one pair at a time.
Characters without a piece become the pieces of their UTF-8 bytes.

Null text is the empty text and has no ids. Texts are read whole; units are encoded once and kept up to ``CACHE`` units
per worker. Repeated rows are encoded alike, an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

MARK = "▁"
#: Stands between units while a text is being split; no valid text holds a lone surrogate.
CUT = "\ud800"
CACHE = 400_000
CHUNK = 2_000_000
NONE = np.iinfo(np.int32).max
SHIFT = 21


class PieceModel:
    """Symbols, pairs and ranks of a byte-pair model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal, byte = pb.ModelProto.SentencePiece.NORMAL, pb.ModelProto.SentencePiece.BYTE
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models that keep the text as it is, with a mark in front, are supported")
        self.n = len(model.pieces)
        score = {p.piece: p.score for p in model.pieces if p.type == normal}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == normal}
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == byte:
                self.bytes[int(p.piece[3:5], 16)] = i
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.full(self.n + 1, NONE, np.int32)
        for piece, i in self.ids.items():
            self.rank[i] = order[score[piece]]
        tied = np.bincount([self.rank[i] for i in self.ids.values()], minlength=len(order)) > 1
        self.lone = np.zeros(self.n + 1, bool)  # pieces that may be part of a pair that ranks no worse than they do
        pairs = {}
        for piece, i in self.ids.items():
            self.lone[i] |= tied[self.rank[i]]
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << SHIFT | b] = i
                    for part in (a, b):
                        self.lone[part] |= self.rank[part] >= self.rank[i]
        beside = {ord(x) << SHIFT | ord(y) for piece in self.ids for x, y in zip(piece, piece[1:], strict=False)}
        #: Pairs of characters that stand side by side in some piece.
        self.beside = np.array(sorted(beside), np.int64)
        # open addressing: 2**20 slots for some 60,000 pairs
        self.bits = max(12, 4 + len(pairs).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys = np.array(list(pairs), np.int64)
        for key, slot in zip(keys.tolist(), self._slot(keys).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.values[slot] = key, pairs[key]
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.n
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.decimal = [str(i) for i in range(self.n + 1)]
        self.cache: dict[str, str] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, keys: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 for none."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units in order, and the unit of each symbol; symbols from ``n`` up are n + code point."""
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        sym = self.symbol[code]
        whole = np.repeat(np.arange(len(units), dtype=np.int32), [len(u) for u in units])
        pair = code[:-1].astype(np.int64) << SHIFT | code[1:]
        joined = self.beside[np.minimum(np.searchsorted(self.beside, pair), self.beside.size - 1)] == pair
        first = np.flatnonzero(np.r_[True, (whole[1:] != whole[:-1]) | ~joined][: code.size])
        unit = np.repeat(np.arange(first.size, dtype=np.int32), np.diff(np.r_[first, code.size]))
        owner = whole[first]
        done_sym, done_unit = [], []
        while sym.size:
            made = np.full(sym.size, -1, np.int32)
            same = np.flatnonzero(unit[:-1] == unit[1:])
            made[same] = self.merged(sym[same].astype(np.int64) << SHIFT | sym[same + 1])
            rank = self.rank[made]  # the last entry stands for -1
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, sym.size])
            least = np.repeat(least, size)
            over = least == NONE
            if over.any():
                done_sym.append(sym[over])
                done_unit.append(unit[over])
                keep = ~over
                sym, unit, made, rank, least = sym[keep], unit[keep], made[keep], rank[keep], least[keep]
                if not sym.size:
                    break
            at = np.flatnonzero(rank == least)
            first = np.r_[True, unit[at[1:]] != unit[at[:-1]]]
            run = np.r_[True, at[1:] != at[:-1] + 1] | first
            place = np.arange(at.size) - np.maximum.accumulate(np.where(run, np.arange(at.size), 0))
            at = at[place % 2 == 0]
            loud = self._loud(sym, unit, made, rank, at)
            if loud.any():
                ahead = np.cumsum(loud) - loud
                first = np.r_[True, unit[at[1:]] != unit[at[:-1]]]
                at = at[ahead == np.maximum.accumulate(np.where(first, ahead, 0))]
            sym[at] = made[at]
            keep = np.ones(sym.size, bool)
            keep[at + 1] = False
            sym, unit = sym[keep], unit[keep]
        if not done_sym:
            return np.empty(0, np.int32), np.empty(0, np.int32)
        sym, unit = np.concatenate(done_sym), np.concatenate(done_unit)
        order = np.argsort(unit, kind="stable")
        return sym[order], owner[unit[order]]

    def _loud(self, sym: np.ndarray, unit: np.ndarray, made: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which merges give rise to a pair that comes before the unit's other pairs of this rank."""
        loud = np.zeros(at.size, bool)
        ask = np.flatnonzero(self.lone[made[at]])
        if not ask.size:
            return loud
        i = at[ask]
        new, limit = made[i].astype(np.int64), rank[i]
        left = np.maximum(i - 1, 0)
        before = np.where((ask > 0) & (at[ask - 1] == i - 2), new, sym[left])
        ok = (i > 0) & (unit[left] == unit[i])
        loud[ask] |= ok & (self.rank[self.merged(before.astype(np.int64) << SHIFT | new)] <= limit)
        right = np.minimum(i + 2, sym.size - 1)
        ok = (i + 2 < sym.size) & (unit[right] == unit[i])
        loud[ask] |= ok & (self.rank[self.merged(new << SHIFT | sym[right])] <= limit)
        return loud

    def learn(self, units: set[str]) -> None:
        """Put the ids of new units, as decimal numbers joined by commas, into the cache."""
        new = [u for u in units if u not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(units)
        if not new:
            return
        sym, unit = self.encode_units(new)
        text = [self.decimal[i] for i in np.minimum(sym, self.n).tolist()]
        for i in np.flatnonzero(sym >= self.n).tolist():
            text[i] = ",".join(str(self.bytes[b]) for b in chr(sym[i] - self.n).encode())
        ends = np.searchsorted(unit, np.arange(len(new)), side="right")
        last = np.cumsum(np.fromiter(map(len, text), np.int64, len(text)) + 1)[ends - 1].tolist()
        whole, start = ",".join(text), 0
        for u, end in zip(new, last, strict=True):
            self.cache[u] = whole[start : end - 1]
            start = end

    def encode_texts(self, texts: list[str]) -> Iterator[str]:
        """The ids of each text, as decimal numbers joined by commas."""
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (size < CHUNK or not split):
                split.append(split_units(texts[at]))
                size += len(texts[at])
                at += 1
            units = set().union(*split)
            if not units <= self.cache.keys():
                self.learn(units)
            get = self.cache.__getitem__
            for s in split:
                yield ",".join(map(get, s))


def split_units(text: str) -> list[str]:
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    marked = re.sub(f"{MARK}+", CUT + r"\g<0>", marked) if MARK * 2 in marked else marked.replace(MARK, CUT + MARK)
    return list(filter(None, marked.replace("\n", f"{CUT}\n{CUT}").split(CUT)))


@functools.lru_cache(2)
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


@functools.lru_cache(2)
def library_of(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encoded(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded text, one row per row of ``df``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, library = model_of(model_file), library_of(model_file)
        for batch in batches:
            ids = [[int(i) for i in s.split(",")] if s else [] for s in model.encode_texts(batch["text"].tolist())]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": [library.decode(i) for i in ids]})

    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(rows, "doc_id", run, "ids array<int>, decoded string")


def digests(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encoded`` gives, without moving the ids out of the worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, library = model_of(model_file), library_of(model_file)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for ids in model.encode_texts(batch["text"].tolist()):
                n.append(ids.count(",") + 1 if ids else 0)
                of_ids.append(sha(ids))
                of_text.append(sha(library.decode(list(map(int, ids.split(",")))) if ids else ""))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_text})

    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(rows, "doc_id", run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
