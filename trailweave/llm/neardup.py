"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of words, lower-cased A-Z. Its shingles of five words (a shorter text is one shingle) are labelled
with their occurrence numbers, so repeats count. Each of ``BANDS`` hash functions takes the ``TAKE`` labelled shingles
with the least values and keeps them in text order: two texts agree on it only if they share both shingles in the same
order. Texts of up to ``SHORT`` words, of which one changed word spoils most shingles of five, are entered under
``SHORT_BANDS`` functions over pairs of words besides. Equal texts fall together first, by digest.

Two texts are linked if their edit similarity, 1 - (words inserted, dropped or changed) / (words of the longer one), is
``least`` or more, by an alignment in the band about the diagonal that no such pair leaves. Classes are the connected
components of the links. A pair whose words are changed at random is found by its own buckets with a chance of 0.71 at
0.8, of 0.93 at 0.85 and of 0.998 at 0.9, and mostly also through others of its class.

Within a bucket members are not paired with each other: each is compared with the most central one, whose buckets are
largest, and first of all with that of the most of its buckets, so that large groups of copies are joined by one
comparison each. Where a bucket of more than two leaves a member outside its centre's component, as among texts that
merely share a frequent passage, all texts of that bucket go through an exact join on their rarest pairs of words, which
meets every two of them that reach ``least`` and compares only what no links join yet. So all that share a bucket and
reach ``least`` are in one class. No bucket is capped: where many texts share a rare pair of words, as in a family of near
copies that stay below ``least``, they meet in blocks instead of in rows, and what counts of words leave open is aligned.

Null text is empty; texts without words are equal if their characters are. A class is named by its least id, null if no
member has one. Repeated rows belong to one class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, map_batches, staged
from .components import components

K, PAIR = 5, 2
BANDS, TAKE = 32, 2
SHORT, SHORT_BANDS = 75, 12
#: How many of the rarest shingles two texts must share to be met in the exact join.
HITS = 8
#: The exact join makes rows of pairs in buckets of up to so many members; in larger ones, blocks of nodes meet.
WIDE, BLOCK = 32, 2048
LEAST = 0.8
MIX = np.uint64(0x9E3779B97F4A7C15)
_seeds = np.random.Generator(np.random.PCG64(20240501))
#: An odd multiplier and an offset for each hash function.
FACTORS = _seeds.integers(0, 2**64, BANDS + SHORT_BANDS, np.uint64) | np.uint64(1)
OFFSETS = _seeds.integers(0, 2**64, BANDS + SHORT_BANDS, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Four bytes of each word's hash, in text order."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    return (np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(32)).astype(np.uint32)


def shingles(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the labelled shingles of ``k`` words, in text order."""
    n = words.size
    if not n:
        return np.empty(0, np.uint64)
    k, h = min(k, n), words.astype(np.uint64)
    s = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        s = s * MIX + h[i : n - k + 1 + i]
    s = mixed(s + np.uint64(k))
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    if new.all():
        return s
    at = np.arange(s.size)
    label = np.empty(s.size, np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(label > 0, mixed(s ^ (label * MIX)), s)


def samples(s: np.ndarray, functions: range) -> np.ndarray:
    """One bucket key per hash function: its least shingles, in text order."""
    n, f = s.size, len(functions)
    taken = np.empty((f, TAKE), np.int64)
    step = max(1, 4_000_000 // max(1, n))
    for a in range(0, f, step):
        some = np.array(functions[a : a + step])
        v = s[None, :] * FACTORS[some, None] + OFFSETS[some, None]
        rows = np.arange(v.shape[0])
        for t in range(TAKE):
            at = v.argmin(axis=1)
            taken[a : a + step, t] = at
            if n > 1:
                v[rows, at] = np.iinfo(np.uint64).max
    taken.sort(axis=1)  # text order
    key = np.array(functions, np.uint64)
    for t in range(TAKE):
        key = mixed(key * MIX + s[taken[:, t]] + np.uint64(t))
    return key.view(np.int64)


def sketch(words: np.ndarray) -> np.ndarray:
    """The bucket keys of a text."""
    if not words.size:
        return np.empty(0, np.int64)
    keys = samples(shingles(words), range(BANDS))
    if words.size <= SHORT:
        keys = np.r_[keys, samples(shingles(words, PAIR), range(BANDS, BANDS + SHORT_BANDS))]
    return keys


def edits_within(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """The edit distance of two sequences if it is at most ``limit``, else a number above it.

    Only cells within ``limit`` of the diagonal are looked at. A column of the band is held as two bit vectors, of the
    cells that are one more and one less than the cell above, and a step to the next column is a few operations on them.
    """
    if abs(a.size - b.size) > limit:
        return limit + 1
    short = min(a.size, b.size)
    differ = np.flatnonzero(a[:short] != b[:short])
    if not differ.size:
        return max(a.size, b.size) - short
    a, b = a[differ[0] :], b[differ[0] :]
    short = min(a.size, b.size)
    same = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    end = int(same[0]) if same.size else short
    a, b = a[: a.size - end], b[: b.size - end]
    m, n = a.size, b.size
    if not m or not n:
        return max(m, n)
    wide = min(limit, max(m, n))  # rows of the band on either side of the diagonal
    width = 2 * wide + 1
    places: dict[int, int] = {}
    for r, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << r
    full, top = (1 << width) - 1, 1 << 2 * wide
    more, less = full & ~((1 << wide) - 1), 0  # before the first column, its rows from the first on
    distance = min(wide, m)  # of the lowest cell in the band
    for j, w in enumerate(b.tolist(), 1):
        hit = places.get(w, 0)
        shift = j - wide - 1
        hit = (hit >> shift if shift >= 0 else hit << -shift) & full
        level = ((((hit & more) + more) ^ more) | hit | less) & full  # cells equal to the one up and to the left
        right, left = less | (full & ~(level | more)), level & more
        if j + wide <= m:  # down the diagonal, then along the last row
            distance += not level & top
        else:
            row = 1 << (m - j + wide)
            distance += bool(right & row) - bool(left & row)
        level >>= 1
        more, less = left | (full & ~(level | right)), level & right
    return distance


def similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Edit similarity of two sequences of words; 0 where it can't reach ``least``."""
    longer = max(a.size, b.size)
    if not longer:
        return 1.0
    limit = int((1 - least) * longer + 1e-9)
    if longer - min(a.size, b.size) > limit:
        return 0.0
    u, many = np.unique(a, return_counts=True)
    v, times = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    if longer - np.minimum(many[i], times[j]).sum() > limit:
        return 0.0
    edits = edits_within(a, b, limit)
    return 1 - edits / longer if edits <= limit else 0.0


def sketched(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node (digest of the text), n (words), keys (buckets) and seq (word hashes) of each row, in one pass over the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [word_hashes(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "node": batch["node"], "n": [w.size for w in words], "keys": [sketch(w) for w in words], "seq": [w.tobytes() for w in words]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))
    return map_batches(rows, "doc_id", run, "node binary, n int, keys array<bigint>, seq binary")


def verified(pairs: DataFrame, seqs: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) that reach the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similarity(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), least) >= least for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch.loc[np.array(good, bool), ["u", "v"]]

    left = pairs.select("u", "v").join(seqs.select(F.col("node").alias("u"), F.col("seq").alias("a")), "u")
    both = left.join(seqs.select(F.col("node").alias("v"), F.col("seq").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInPandas(run, "u binary, v binary")


def verified_in_tiles(pairs: DataFrame, seqs: DataFrame, least: float, per_tile: int = 256) -> DataFrame:
    """The pairs (u, v) that reach the similarity, where a text may be in many: nodes are dealt to tiles of about
    ``per_tile``, and a text goes once to each two tiles between which it has pairs, not to each pair."""
    tiles = max(1, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().count() // per_tile)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, texts = None, {}
        for batch in batches:
            good = []
            for k, u, v, seq in zip(batch["key"], batch["u"], batch["v"], batch["seq"], strict=True):
                if k != key:
                    key, texts = k, {}
                if v is None:
                    texts[u] = np.frombuffer(seq, np.uint32)
                elif similarity(texts[u], texts[v], least) >= least:
                    good.append((u, v))
            yield pd.DataFrame(good, columns=["u", "v"])

    tile = [F.pmod(F.xxhash64(end), F.lit(tiles)) for end in ("u", "v")]
    keyed = pairs.select((F.least(*tile) * tiles + F.greatest(*tile)).alias("key"), "u", "v")
    needed = keyed.select("key", F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = needed.join(seqs, "node").select("key", F.col("node").alias("u"), F.lit(None).cast("binary").alias("v"), "seq")
    rows = texts.unionByName(keyed.withColumn("seq", F.lit(None).cast("binary"))).repartition("key")
    return rows.sortWithinPartitions("key", F.col("v").asc_nulls_first()).mapInPandas(run, "u binary, v binary")


def star_pairs(entries: DataFrame, least: float) -> DataFrame:
    """Each member of a bucket of ``entries`` (bucket, node, n, size, central) with the bucket's most central member, where
    their lengths allow the similarity: bucket, node, size, pivot, u, v."""
    pivots = entries.groupBy("bucket").agg(F.max(F.struct("central", "node", "n")).alias("p")).select("bucket", F.col("p.node").alias("pivot"), F.col("p.n").alias("m"))
    met = entries.join(pivots, "bucket").where("node != pivot")
    fits = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")
    return met.select("bucket", "node", "size", "pivot", fits.alias("fits"), F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v"))


def apart(pairs: DataFrame, roots: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs whose ends ``a`` and ``b`` lie in different components."""
    for end in (a, b):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"__{end}")), end, "left")
    return pairs.where(F.coalesce(f"__{a}", a) != F.coalesce(f"__{b}", b)).drop(f"__{a}", f"__{b}")


def rare_entries(nodes: DataFrame, roots: DataFrame, seqs: DataFrame, least: float, hits: int = HITS) -> DataFrame:
    """Entries (bucket, node, n, need, root) of an exact join over ``nodes``: two of them that reach ``least`` share at least
    as many buckets as either's need. Of a bucket, members counts its entries, and main is the component of most of them;
    buckets of one component are left out.

    An edit spoils at most ``gram`` shingles of ``gram`` words, so two texts of that edit similarity, the longer one of n
    words, have at least t = ceil(n * (1 - gram * (1 - least))) - gram + 1 labelled shingles in common. In the order of how
    many nodes hold them, rarest first, ``hits`` of these (or t, if that is less) are among the first k - t + ``hits`` of the
    k shingles of each, so each node is entered under those; shingles of a single node match nothing and only use up their
    places.
    """
    gram = PAIR if least >= 0.75 else 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [np.frombuffer(s, np.uint32) for s in batch["seq"]]
            yield pd.DataFrame({"number": batch["number"], "n": [w.size for w in words], "labels": [np.unique(shingles(w, gram)).view(np.int64) for w in words]})

    # short numbers stand for nodes while their shingles are shuffled
    named = staged(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "dedup-named")
    named = staged(named.withColumn("number", F.monotonically_increasing_id()), "dedup-numbered")
    rows = named.join(seqs, "node").select("number", "seq").mapInPandas(run, "number long, n int, labels array<bigint>")
    rows = rows.select("number", "n", F.explode("labels").alias("bucket"))
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy("bucket"))).where("size > 1")
    rows = rows.withColumn("shared", F.count("*").over(Window.partitionBy("number")))
    rank = F.row_number().over(Window.partitionBy("number").orderBy("size", "bucket"))
    common = F.greatest(F.lit(1), (F.ceil(F.col("n") * F.lit(1 - gram * (1 - least)) - 1e-6) - gram + 1).cast("int"))
    rows = rows.withColumn("rank", rank).withColumn("t", common).withColumn("need", F.least("t", F.lit(hits))).where("rank - shared <= need - t")
    rows = rows.select("bucket", "number", "n", "need").join(named, "number").drop("number")
    by_bucket = Window.partitionBy("bucket")
    rows = rows.withColumn("members", F.count("*").over(by_bucket)).withColumn("roots", F.min("root").over(by_bucket) != F.max("root").over(by_bucket)).where("members > 1 and roots")
    rows = rows.withColumn("same", F.count("*").over(Window.partitionBy("bucket", "root")))
    out = staged(rows.withColumn("main", F.max(F.struct("same", "root")).over(by_bucket)["root"]).drop("roots", "same"), "dedup-rare")
    forget(named)
    return out


def met_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of different components that meet in as many buckets of ``rows`` as they need. In each bucket the nodes of
    its largest component are met by all others, but don't meet each other."""
    few = rows.where("root != main").select("bucket", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("need").alias("need2"), F.col("root").alias("root2"))
    fits = F.least("n", "n2") >= F.lit(least) * F.greatest("n", "n2") - 1e-6
    once = (F.col("root") == F.col("main")) | (F.col("node") > F.col("node2"))
    both = rows.join(few, (rows["bucket"] == few["bucket"]) & (F.col("root") != F.col("root2")) & fits & once)
    both = both.groupBy(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v")).agg(F.count("*").alias("met"), F.min(F.least("need", "need2")).alias("need"))
    return staged(both.where("met >= need").select("u", "v"), "dedup-pairs")


def rare_pairs(nodes: DataFrame, roots: DataFrame, seqs: DataFrame, least: float, hits: int = HITS) -> DataFrame:
    """Pairs (u, v) of an exact join over ``nodes``, between nodes that no links join yet, each met in its buckets."""
    rows = rare_entries(nodes, roots, seqs, least, hits)
    out = met_pairs(rows, least)
    forget(rows)
    return out


def in_common(a: list[np.ndarray], b: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """How many elements each of the sets ``a`` has in common with each of the sets ``b``."""
    own, other = np.concatenate(a), np.concatenate(b)
    terms = np.intersect1d(own, other)
    out = np.zeros((len(a), len(b)), np.float32)

    def placed(sets, flat):
        at = np.searchsorted(terms, flat)
        at[at == terms.size] = 0
        hit = terms[at] == flat if terms.size else np.zeros(flat.size, bool)
        row, at = np.repeat(np.arange(len(sets)), [s.size for s in sets])[hit], at[hit]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    (r, i), (q, j) = placed(a, own), placed(b, other)
    for start in range(0, terms.size, chunk):
        x, y = np.zeros((len(a), chunk), np.float32), np.zeros((len(b), chunk), np.float32)
        for m, rows, at in ((x, r, i), (y, q, j)):
            part = slice(*np.searchsorted(at, (start, start + chunk)))
            m[rows[part], at[part] - start] = 1
        out += x @ y.T
    return out


def tile_links(a: list, b: list, least: float) -> list[tuple[bytes, bytes]]:
    """Links (u, v) between the nodes ``a`` and the nodes ``b`` (node, root, words, wide buckets), or among ``a`` where both are
    one list: those that join components which no other link of the tile joins. Pairs that share no bucket, or too few
    words, are left out by counts, the others are compared, likely ones first."""
    found, parent = [], {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x] = parent.get(parent[x], parent[x])
        return x

    bags = [[np.unique(shingles(t[2], 1)) for t in side] for side in (a, b)]
    n, m = (np.array([t[2].size for t in side]) for side in (a, b))
    for at in range(0, len(a), 256):
        rows = slice(at, at + 256)
        longer = np.maximum(n[rows, None], m[None, :])
        words = in_common(bags[0][rows], bags[1])
        good = longer - words <= np.floor((1 - least) * longer + 1e-9)
        good &= in_common([t[3] for t in a[rows]], [t[3] for t in b]) > 0
        i, j = np.nonzero(good)
        if a is b:
            i, j = i[i + at > j], j[i + at > j]
        for k in np.argsort(-(words / longer)[i, j], kind="stable").tolist():
            x, y = a[at + i[k]], b[j[k]]
            one, two = top(x[1]), top(y[1])
            if one != two and similarity(x[2], y[2], least) >= least:
                parent[one] = two
                found.append((max(x[0], y[0]), min(x[0], y[0])))
    return found


def wide_links(rows: DataFrame, seqs: DataFrame, least: float) -> DataFrame:
    """Links (u, v) that join all components of which two nodes reach ``least`` and share a bucket of ``rows``, all of many
    members. Their nodes are dealt to blocks, and each two blocks meet in one group, where pairs are told apart by counts
    of whole columns; no pair becomes a row unless it is a link."""
    held = staged(rows.groupBy("node").agg(F.any_value("root").alias("root"), F.collect_list("bucket").alias("wide")).join(seqs, "node"), "dedup-wide")
    n = held.count()
    blocks = max(1, -(-n // BLOCK), min(8, -(-n // 256)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sides = {k: [(node, root, np.frombuffer(seq, np.uint32), np.unique(wide)) for node, root, seq, wide in zip(g["node"], g["root"], g["seq"], g["wide"], strict=True)] for k, g in group.groupby("block")}
        a, *more = sides.values()
        alone = group["low"].iloc[0] == group["high"].iloc[0]
        return pd.DataFrame(tile_links(a, a if alone else more[0], least) if alone or more else [], columns=["u", "v"])

    tiled = held.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiled = tiled.select("node", "root", "seq", "wide", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    out = staged(tiled.groupBy("low", "high").applyInPandas(run, "u binary, v binary"), "dedup-links")
    forget(held)
    return out


def with_centrality(entries: DataFrame) -> DataFrame:
    """Entries (bucket, node, n) of buckets with several members, with the bucket's size and the node's sum of sizes."""
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    entries = staged(entries.join(shared, "bucket"), "dedup-entries")
    central = entries.groupBy("node").agg(F.sum("size").alias("central"))
    out = staged(entries.join(central, "node"), "dedup-members")
    forget(entries)
    return out


def linked(entries: DataFrame, seqs: DataFrame, least: float) -> DataFrame:
    """node, root of the components among the nodes of ``entries``."""
    met = staged(star_pairs(entries, least), "dedup-met")
    fit = met.where("fits")
    # the centre of the most of a node's buckets, first; after that only what is still apart
    best = fit.groupBy("node", "u", "v").agg(F.count("*").alias("times"), F.max("size").alias("size")).groupBy("node").agg(F.max(F.struct("times", "size", "u", "v")).alias("b"))
    links = staged(verified(best.select("b.u", "b.v").distinct(), seqs, least), "dedup-links")
    roots = components(links)
    more = staged(verified(apart(fit.select("u", "v").distinct(), roots, "u", "v"), seqs, least), "dedup-links")
    links = links.unionByName(more)
    roots = roots if more.isEmpty() else components(links)
    crowded = apart(met.where("size > 2"), roots, "node", "pivot").select("bucket").distinct()
    crowd = staged(entries.join(crowded, "bucket", "left_semi").select("node").distinct(), "dedup-crowd")
    forget(met)
    if not crowd.isEmpty():
        rows = rare_entries(crowd, roots, seqs, least)
        # two that reach the similarity meet in narrow buckets as often as they need, or share a wide one
        pairs = met_pairs(rows.where(F.col("members") <= WIDE), least)
        more = staged(verified_in_tiles(pairs, seqs, least), "dedup-links")
        more = more.unionByName(wide_links(rows.where(F.col("members") > WIDE), seqs, least))
        roots = roots if more.isEmpty() else components(links.unionByName(more))
        forget(pairs, rows)
    forget(seqs, crowd)
    return roots


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, class_id, node, root: one row per row of ``df``; node is the digest of the text, root that of one of the class."""
    docs = staged(sketched(df, id_col, text_col), "dedup-sketches")
    nodes = docs.groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    nodes = staged(nodes, "dedup-nodes")
    entries = with_centrality(nodes.select("node", "n", F.explode("keys").alias("bucket")))
    if entries.isEmpty():
        named = nodes.select("node", F.col("rep").alias("class_id"), F.col("node").alias("root"))
    else:
        wanted = entries.select("node").distinct()
        seqs = staged(docs.select("node", "seq").join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("seq").alias("seq")), "dedup-texts")
        rows = staged(docs.select("doc_id", "node"), "dedup-rows")
        forget(docs)
        docs = rows
        tied = nodes.select("node", "rep").join(linked(entries, seqs, least), "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = tied.join(tied.groupBy("root").agg(F.min("rep").alias("class_id")), "root").select("node", "class_id", "root")
    named = staged(named, "dedup-classes")
    forget(entries, nodes)
    return docs.select("doc_id", "node").join(named, "node").select("doc_id", "class_id", "node", "root")


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``df`` for each class: the one with the least id, and of rows that share it, any one."""
    found = classes(df, id_col, text_col, **options)
    first = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "node")).alias("f")).select(F.col("f.doc_id").alias("__id"), F.col("f.node").alias("__node"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.withColumn("__key", F.unhex(F.md5(text.cast("binary"))))
    same = keyed[id_col].eqNullSafe(first["__id"]) & (keyed["__key"] == first["__node"])
    return keyed.join(first, same, "left_semi").dropDuplicates([id_col, "__key"]).select(*df.columns)
