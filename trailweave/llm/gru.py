"""Language-model scoring with a gated recurrent network in numpy.

The corpus is read once. Each block of texts keeps its words as numbers of its own list; the lists meet the counts of
all training texts in one shuffle by word and come back with count and symbol of each word. A symbol is one of the
``TOP`` most frequent words (the end of a text is the first), or one of ``TAILS`` tail classes by a word's last three
characters. The output softmax is factored: first the class (frequent words in order of frequency, ``WIDE`` to a class,
then the tail classes), then the word in its class: by a softmax of the state for frequent words, by smoothed counts for
the others, (c + 0.5) / (N of the class + 0.5 * (its words + 1)). Output biases start at the logs of the counts.

The texts, by then short rows of symbols, are dealt to parts of about ``PART_TOKENS`` tokens by a hash of id and symbols,
and stand in order of id there, so scores depend on the table alone, not on how its rows reach the tasks. Texts stand one
after another in lanes that advance in step; the state starts at zero with each text and is carried across windows of
``WINDOW`` tokens, through which the gradient is cut (truncated backpropagation, Adam). Each part learns from its
training texts; in each of ``ROUNDS`` rounds, which take different texts, the parts' weights are averaged by tokens, in
groups of 64 until few are left, so the driver holds a bounded number of weight vectors. All training texts are learnt
from once, and every text is scored whole.

Null text is empty: one token, the end. A null id counts as the empty text in the held-out rule. Repeated rows are
separate texts. Without any training text the base score is log10(0.5 / 0.5) = 0 a token. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, staged

TOP, WIDE, TAILS = 2048, 64, 64
FREQUENT = TOP // WIDE
CLASSES = FREQUENT + TAILS
SYMBOLS = TOP + TAILS
HIDDEN = 16
WINDOW = 16
LANES = 512
ROUNDS = 2
RATE = 0.01
BLOCK_BYTES = 8_000_000
PART_TOKENS = 8_000_000
MAX_TASKS = 20_000
SHAPES = {"G": (SYMBOLS, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "Wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "Ww": (FREQUENT, HIDDEN, WIDE), "bw": (FREQUENT, WIDE)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def first_weights(counts: np.ndarray) -> np.ndarray:
    """Small random weights, with the output biases of the unigram model; ``counts`` per symbol."""
    flat = np.zeros(SIZE, np.float32)
    p, rng = views(flat), np.random.Generator(np.random.PCG64(5))
    p["G"][:] = rng.normal(0, 0.3, p["G"].shape)
    p["U"][:] = rng.normal(0, 0.3, p["U"].shape)
    p["Wc"][:] = rng.normal(0, 0.05, p["Wc"].shape)
    p["Ww"][:] = rng.normal(0, 0.05, p["Ww"].shape)
    c = counts + 0.5
    top = c[:TOP].reshape(FREQUENT, WIDE)
    p["bw"][:] = np.log(top / top.sum(axis=1, keepdims=True))
    classes = np.r_[top.sum(axis=1), c[TOP:]]
    p["bc"][:] = np.log(classes / classes.sum())
    return flat


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Model:
    """The network over one flat vector of weights."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.p = flat, views(flat)

    def states(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each of the inputs x (steps by lanes); ``fresh`` marks first inputs of texts."""
        n, u, out, steps = HIDDEN, self.p["U"], np.empty((*x.shape, HIDDEN), np.float32), []
        for t in range(x.shape[0]):
            if fresh[t].any():
                h = h * ~fresh[t][:, None]
            g, k = self.p["G"][x[t]], h @ u
            zr = sigmoid(g[:, : 2 * n] + k[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            new = np.tanh(g[:, 2 * n :] + r * k[:, 2 * n :])
            if keep:
                steps.append((h, z, r, new, k[:, 2 * n :]))
            h = new + z * (h - new)
            out[t] = h
        return out, steps

    def softmax(self, h: np.ndarray, w: np.ndarray, y: np.ndarray, size: int, back: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-likelihood of the columns y by a softmax of ``h`` (its last column ones) over ``w`` (its last row biases). With
        ``back``, which takes the gradient of minus its sum over ``size`` by the state, also that by ``w``."""
        a = h @ w
        # states stay within 1, so exponents are bounded by the weights and mostly need no shift
        if np.abs(w).sum(axis=0).max() > 60:
            a -= a.max(axis=1, keepdims=True)
        rows = np.arange(y.size)
        like = a[rows, y]
        e = np.exp(a, out=a)
        z = e @ np.ones(w.shape[1], np.float32)
        like -= np.log(z)
        if back is None:
            return like, None
        e[rows, y] -= z
        share = (1 / (z * np.float32(size)))[:, None]
        np.multiply(e @ w[:-1].T, share, out=back)
        return like, (h * share).T @ e

    def outputs(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-likelihood of each target but for the words within tail classes, and the gradient of minus its mean."""
        p = self.p
        cls = np.where(y < TOP, y // WIDE, y - TOP + FREQUENT).astype(np.uint8)
        # in order of class, so the words of a class stand in a row
        order = np.argsort(cls, kind="stable")
        cls, y = cls[order], y[order]
        h = np.c_[h[order], np.ones(y.size, np.float32)]
        ends = np.searchsorted(cls, np.arange(FREQUENT + 1))
        back, own = (None, None) if grad is None else np.empty((2, y.size, HIDDEN), np.float32)
        like, g = self.softmax(h, np.r_[p["Wc"], p["bc"][None]], cls, y.size, back)
        if grad is not None:
            grad["Wc"] += g[:-1]
            grad["bc"] += g[-1]
        for c in range(FREQUENT):
            at = slice(ends[c], ends[c + 1])
            if at.start == at.stop:
                continue
            some, g = self.softmax(h[at], np.r_[p["Ww"][c], p["bw"][c][None]], y[at] % WIDE, y.size, None if grad is None else own[at])
            like[at] += some
            if grad is not None:
                grad["Ww"][c] += g[:-1]
                grad["bw"][c] += g[-1]
        placed = np.empty_like(like)
        placed[order] = like
        if grad is None:
            return placed, None
        back[: ends[-1]] += own[: ends[-1]]
        out = np.empty_like(back)
        out[order] = back
        return placed, out

    def gradient(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient over one window, the state after it and its mean log-likelihood."""
        flat = np.zeros(SIZE, np.float32)
        grad, n, u = views(flat), HIDDEN, self.p["U"]
        out, steps = self.states(x, fresh, h, keep=True)
        like, d = self.outputs(out[real], y[real], grad)
        back = np.zeros(out.shape, np.float32)
        back[real] = d
        inputs, within, carry = np.empty((*x.shape, 3 * n), np.float32), np.empty((*x.shape, 3 * n), np.float32), np.zeros_like(h)
        for t in range(x.shape[0] - 1, -1, -1):
            h0, z, r, new, k = steps[t]
            dh = back[t] + carry
            shut, dk = dh * (1 - z), within[t]
            dnew = shut * (1 - new * new)
            dk[:, :n] = shut * z * (h0 - new)
            dk[:, n : 2 * n] = dnew * k * r * (1 - r)
            dk[:, 2 * n :] = dnew * r
            inputs[t, :, : 2 * n] = dk[:, : 2 * n]
            inputs[t, :, 2 * n :] = dnew
            carry = dh * z + dk @ u.T
            if fresh[t].any():
                carry *= ~fresh[t][:, None]
        grad["U"] += np.concatenate([s[0] for s in steps]).T @ within.reshape(-1, 3 * n)
        flat_x, inputs = x.ravel().astype(np.uint16), inputs.reshape(-1, 3 * n)  # short numbers are sorted by radix
        order = np.argsort(flat_x, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(flat_x[order]) != 0])
        grad["G"][flat_x[order[starts]]] = np.add.reduceat(inputs[order], starts, axis=0)
        return flat, out[-1], float(like.mean())


class Lanes:
    """Texts laid end to end in lanes of about equal length, the longest texts first."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([t.size + 1 for t in texts])
        n = int(max(1, min(LANES, sizes.sum() // sizes.max())))
        heap, lanes = [(0, i) for i in range(n)], [[] for _ in range(n)]
        for i in np.argsort(-sizes, kind="stable").tolist():
            size, lane = heapq.heappop(heap)
            lanes[lane].append(i)
            heapq.heappush(heap, (size + int(sizes[i]), lane))
        lanes.sort(key=lambda lane: -sum(sizes[i] for i in lane))
        length = int(sum(sizes[i] for i in lanes[0]))
        self.x, self.y = np.zeros((length, n), np.int32), np.zeros((length, n), np.int32)
        self.fresh, self.text = np.zeros((length, n), bool), np.full((length, n), -1, np.int32)
        for k, lane in enumerate(lanes):
            at = 0
            for i in lane:
                end = at + int(sizes[i])
                self.fresh[at, k] = True
                self.x[at + 1 : end, k] = texts[i]  # the first input is the end symbol, 0
                self.y[at : end - 1, k] = texts[i]
                self.text[at:end, k] = i
                at = end
        self.active = (self.text >= 0).sum(axis=1)

    def windows(self, width: int) -> Iterator[tuple[slice, int]]:
        """Steps and how many lanes, the longest, are still busy in them."""
        for a in range(0, self.x.shape[0], width):
            yield slice(a, a + width), int(self.active[a])


def learn(weights: np.ndarray, texts: list[np.ndarray], rate: float) -> np.ndarray:
    """One pass of truncated backpropagation over the texts."""
    model, lanes = Model(weights.copy()), Lanes(texts)
    m, v, step, t = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), np.empty(SIZE, np.float32), 0
    h = np.zeros((lanes.x.shape[1], HIDDEN), np.float32)
    for at, n in lanes.windows(WINDOW):
        grad, h, _ = model.gradient(lanes.x[at, :n], lanes.y[at, :n], lanes.fresh[at, :n], lanes.text[at, :n] >= 0, h[:n])
        norm = float(np.sqrt(grad @ grad))
        if norm > 1:
            grad *= 1 / norm
        t += 1
        m *= 0.9
        v *= 0.99
        np.multiply(grad, 0.1, out=step)
        m += step
        np.multiply(grad, grad, out=step)
        step *= 0.01
        v += step
        np.sqrt(v, out=step)
        step *= 1 / np.sqrt(1 - 0.99**t)
        step += 1e-6
        np.divide(m, step, out=step)
        step *= rate / (1 - 0.9**t)
        model.flat -= step
    return model.flat


def loglik(weights: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each text but for the words within tail classes."""
    if not texts:
        return np.zeros(0)
    model, lanes, out = Model(weights), Lanes(texts), np.zeros(len(texts))
    h = np.zeros((lanes.x.shape[1], HIDDEN), np.float32)
    for at, n in lanes.windows(WINDOW):
        states, _ = model.states(lanes.x[at, :n], lanes.fresh[at, :n], h[:n])
        h, real = states[-1], lanes.text[at, :n] >= 0
        like, _ = model.outputs(states[real], lanes.y[at, :n][real])
        out += np.bincount(lanes.text[at, :n][real], weights=like, minlength=len(texts))
    return out


def numbered() -> defaultdict[bytes, int]:
    """A number for each new key, from 0."""
    found = defaultdict(int)
    found.default_factory = found.__len__
    return found


def blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per block of texts: ids, held, sizes, words, their training counts, and the words of all texts as numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0

        def row():
            learnt = [s for s, h in zip(seqs, held, strict=True) if not h]
            counts = np.bincount(np.concatenate(learnt), minlength=len(vocab)) if learnt else np.zeros(len(vocab), np.int64)
            kind = "<u2" if len(vocab) <= 1 << 16 else "<u4"
            seq = np.concatenate(seqs).astype(kind).tobytes()
            return pd.DataFrame({"block": [task << 24 | made], "ids": [ids], "held": [held], "sizes": [[s.size for s in seqs]], "words": [[w.decode() for w in vocab]], "counts": [counts], "seq": [seq]})

        vocab, ids, held, seqs, size = numbered(), [], [], [], 0
        for batch in batches:
            for i, h, text in zip(batch["doc_id"], batch["held"], batch["text"], strict=True):
                words = text.encode().lower().split()
                seqs.append(np.fromiter(map(vocab.__getitem__, words), np.int64, len(words)))
                ids.append(i)
                held.append(bool(h))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield row()
                    vocab, ids, held, seqs, size, made = numbered(), [], [], [], 0, made + 1
        if ids:
            yield row()

    number = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), (F.crc32(number.cast("binary")) % 5 == 1).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "block long, ids array<string>, held array<boolean>, sizes array<int>, words array<string>, counts array<bigint>, seq binary"
    return rows.mapInPandas(run, schema)


def encoded(parts: DataFrame, words: DataFrame, n: int, v: int, tails: list[tuple[int, int]], ends: int) -> DataFrame:
    """Per text: doc_id, held, size, known words, base score and tail part of the score, and the symbols."""
    tail_total = np.array([a + 0.5 * (b + 1) for a, b in tails])
    columns = ["doc_id", "held", "size", "known", "base", "tail", "seq"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=columns)
        b, m = left.iloc[0], len(right)
        count, symbol = np.zeros(m, np.int64), np.zeros(m, np.int32)
        count[right["idx"]], symbol[right["idx"]] = right["c"], right["symbol"]
        seq = np.frombuffer(b["seq"], "<u2" if m <= 1 << 16 else "<u4").astype(np.int64)
        total = n + 0.5 * (v + 1)
        per_base = np.log10((count + 0.5) / total)
        at = np.maximum(symbol - TOP, 0)
        per_tail = np.where(symbol >= TOP, np.log10((count + 0.5) / tail_total[at]), 0.0)
        edges = np.r_[0, np.cumsum(b["sizes"])].astype(np.int64).tolist()
        cuts = list(zip(edges[:-1], edges[1:], strict=True))
        bases, tailed, known, symbols = per_base[seq], per_tail[seq], count[seq] > 0, symbol[seq].astype("<u2")
        end = np.log10((ends + 0.5) / total)
        rows = [(b["ids"][k], bool(b["held"][k]), j - i, int(known[i:j].sum()) + (ends > 0), bases[i:j].sum() + end, tailed[i:j].sum(), symbols[i:j].tobytes()) for k, (i, j) in enumerate(cuts)]
        return pd.DataFrame(rows, columns=columns)

    schema = "doc_id string, held boolean, size int, known bigint, base double, tail double, seq binary"
    return parts.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(run, schema)


def dealt(texts: DataFrame, tokens: int) -> DataFrame:
    """One row per part: part, and arrays ids, held, sizes, known, base, tail, and the symbols of its texts in a row."""
    parts = max(1, -(-tokens // PART_TOKENS))
    tasks = min(parts, MAX_TASKS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(part, rows):
            columns = {name: [[r[i] for r in rows]] for i, name in enumerate(("ids", "held", "sizes", "known", "base", "tail"))}
            return pd.DataFrame({"part": [part], **columns, "seq": [b"".join(r[6] for r in rows)]})

        part, rows = None, []
        for batch in batches:
            for p, *r in zip(*(batch[c].tolist() for c in ("part", "doc_id", "held", "size", "known", "base", "tail", "seq")), strict=True):
                if p != part and rows:
                    yield row(part, rows)
                    rows = []
                part = p
                rows.append(r)
        if rows:
            yield row(part, rows)

    rows = texts.withColumn("part", F.pmod(F.xxhash64("doc_id", "seq"), F.lit(parts)))
    rows = rows.repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part", "doc_id", "seq")
    return rows.mapInPandas(run, "part long, ids array<string>, held array<boolean>, sizes array<int>, known array<bigint>, base array<double>, tail array<double>, seq binary")


def texts_of(row) -> list[np.ndarray]:
    seq = np.frombuffer(row.seq, "<u2").astype(np.int32)
    return np.split(seq, np.cumsum(row.sizes)[:-1])


def trained(rows: DataFrame, weights: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The weights after ``rounds`` rounds, in each of which every part learns from its share of the training texts."""
    for k in range(rounds):
        start, rate = weights, RATE / (1 + k)

        def run(batches: Iterator[pd.DataFrame], start=start, rate=rate, k=k) -> Iterator[pd.DataFrame]:
            # texts take turns by their place in the part, so each is learnt from in exactly one round
            for batch in batches:
                for row in batch.itertuples(index=False):
                    texts = [t for i, (t, h) in enumerate(zip(texts_of(row), row.held, strict=True)) if not h and i % rounds == k]
                    if texts:
                        tokens = sum(t.size + 1 for t in texts)
                        yield pd.DataFrame({"part": [row.part], "tokens": [tokens], "w": [(learn(start, texts, rate) * tokens).astype(np.float64).tobytes()]})

        def added(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("part")
            w = sum(np.frombuffer(x, np.float64) for x in group["w"])
            return pd.DataFrame({"part": [int(group["part"].iloc[0]) // 64], "tokens": [int(group["tokens"].sum())], "w": [w.tobytes()]})

        schema = "part long, tokens long, w binary"
        sums = staged(rows.select("part", "held", "sizes", "seq").mapInPandas(run, schema), "gru-weights")
        while sums.count() > 64:
            sums = staged(sums.groupBy(F.expr("part div 64").alias("g")).applyInPandas(added, schema), "gru-weights")
        got = sums.orderBy("part").collect()
        if got:
            weights = (sum(np.frombuffer(r["w"], np.float64) for r in got) / sum(r["tokens"] for r in got)).astype(np.float32)
    return weights


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``df``."""
    parts = staged(blocks(df, id_col, text_col), "gru-blocks")
    ends = parts.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    pairs = parts.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("idx", "w")).select("block", "idx", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    by_word = Window.partitionBy("word")
    words = pairs.withColumn("c", F.sum("n").over(by_word)).withColumn("first", F.row_number().over(by_word.orderBy("block")) == 1)
    words = staged_words = staged(words.select("word", "block", "idx", "c", "first"), "gru-words")
    once = words.where("first and c > 0")
    top = [r["word"] for r in once.orderBy(F.col("c").desc(), "word").select("word").limit(TOP - 1).collect()]
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(top, 1)), "place int, word string")
    tail = (TOP + F.crc32(F.substring("word", -3, 3).cast("binary")) % TAILS).cast("int")
    # a table of TOP - 1 words at most
    words = words.join(F.broadcast(table), "word", "left").withColumn("symbol", F.coalesce("place", tail))
    counts, tails, n, v = np.zeros(SYMBOLS), [(0, 0)] * TAILS, ends, int(ends > 0)
    counts[0] = ends
    for r in words.where("first and c > 0").groupBy("symbol").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        counts[r["symbol"]] = r["n"]
        n, v = n + r["n"], v + r["v"]
        if r["symbol"] >= TOP:
            tails[r["symbol"] - TOP] = (r["n"], r["v"])
    tokens = parts.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b + 1))).first()[0] or 0
    texts = encoded(parts.drop("words", "counts"), words.select("block", "idx", "c", "symbol"), n, v, tails, ends)
    rows = staged(dealt(texts, tokens), "gru-texts")
    forget(parts, staged_words)
    weights = trained(rows, first_weights(counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                like = loglik(weights, texts_of(row)) / np.log(10)
                yield pd.DataFrame({"doc_id": row.ids, "held_out": row.held, "n_tokens": np.asarray(row.sizes, np.int64) + 1, "n_known": row.known, "base_score": row.base, "score": like + row.tail})

    result = rows.mapInPandas(run, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return result.select(F.col("doc_id").cast(df.schema[id_col].dataType).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
