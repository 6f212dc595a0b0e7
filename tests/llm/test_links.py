"""SimHash classes, collocations and token alignment against plain versions of what they promise."""

import collections
import hashlib
import random
import re

import public_tokenizers as P
import pytest

from trailweave.llm import alignment, phrases, simhash

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")

MASK = (1 << 64) - 1


def plain_components(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in links:
        parent[max(root(u), root(v))] = min(root(u), root(v))
    return {n: root(n) for n in nodes}


def plain_print(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes_equal_all_pairs(spark, odd, empty):
    rng = random.Random(5)
    base = [rng.choices([f"Wort{i}" for i in range(50)], k=rng.randrange(1, 60)) for _ in range(25)]
    texts = [" ".join(b[:i] + ["x"] + b[i:]) for b in base for i in (0, len(b) // 2, len(b))] + [" ".join(b) for b in base] * 2 + ["", None, "É A", "é a"]
    for df in (spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), odd):
        rows = [(r["doc_id"], plain_print(r["text"])) for r in df.collect()]
        prints = sorted({p for _, p in rows})
        roots = plain_components([(u, v) for i, u in enumerate(prints) for v in prints[:i] if (u ^ v).bit_count() <= 2], prints)
        first = collections.defaultdict(set)
        for i, p in rows:
            first[roots[p]] |= {i} - {None}
        want = collections.Counter((i, f"{p:016x}", min(first[roots[p]], default=None)) for i, p in rows)
        assert want == collections.Counter(map(tuple, simhash.classes(df).collect()))
    assert simhash.classes(empty).collect() == []


@pytest.mark.parametrize("few", [0, 32, 10**6])
def test_simhash_links_in_crowded_buckets(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    rng, prints = random.Random(6), set()
    for _ in range(6):  # walks of single bits within one half, so that many share a bucket and most don't link
        p, half = rng.getrandbits(64), rng.choice([range(32), range(32, 64), range(16, 48)])
        for _ in range(60):
            p ^= sum(1 << b for b in rng.sample(half, rng.choice([1, 2, 3, 5])))
            prints.add(p & MASK)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = plain_components([(u, v) for i, u in enumerate(signed) for v in signed[:i] if ((u ^ v) & MASK).bit_count() <= 2], signed)
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect()
    assert all(r["u"] > r["v"] and ((r["u"] ^ r["v"]) & MASK).bit_count() <= 2 for r in got)
    assert plain_components([(r["u"], r["v"]) for r in got], signed) == want


def plain_collocations(rows, least, share, top):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in some.items():
            if any(100 * b >= share * a for q, b in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [200, 7_000_000])
def test_collocations_equal_plain_counts(spark, odd, empty, shard_bytes):
    rng = random.Random(7)
    words = ["The", "the", "old", "bridge", "é", "river", "a.b", "x,", "stone\n", "\tof", "end!", "no-one"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(400)] + [("en", None), ("en", ""), ("fr", " . ")]
    rows += [("en", "very seldom seen")] * 12 + [("de", "a a a a a")] * 7
    want = plain_collocations(rows, 10, 50, 30)
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), top=30, shard_bytes=shard_bytes).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 60
    assert phrases.collocations(empty).collect() == []
    want = plain_collocations([(r["lang"], r["text"]) for r in odd.collect()], 2, 50, 50)
    assert sorted(map(tuple, phrases.collocations(odd, least=2, top=50).collect())) == want


def test_phrase_counts_of_other_lengths():
    rng = random.Random(8)
    for longest in (1, 2, 4, 5):
        text, shard = " ".join(rng.choices(["a", "b", "c", "d.", "e\n"], k=300)), phrases.Shard()
        shard.add(text)
        pieces = [p.split() for p in text.replace("\n", ".").split(".")]
        for n in range(1, longest + 1):
            phrase, f = phrases.phrase_counts(shard, n)
            assert dict(zip(phrase.to_pylist(), f.tolist(), strict=True)) == collections.Counter(" ".join(p[i : i + n]) for p in pieces for i in range(len(p) - n + 1))


def test_filter_holds_all_that_it_was_made_of(spark):
    rng = random.Random(10)
    keys = [("en", "".join(rng.choices("abcdé ", k=7))) for _ in range(3000)]
    known = phrases.Filter.of(spark.createDataFrame(keys, "lang string, phrase string"))
    assert known.holds("en", [p for _, p in keys]).all()
    assert known.holds("en", [f"x{i}" for i in range(3000)]).mean() < 0.02 and known.holds("de", [p for _, p in keys]).mean() < 0.02


def plain_alignment(texts):
    """A row for each text, in order, by the libraries on whole texts."""
    import base64

    import sentencepiece
    from tokenizers import Tokenizer

    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library, sp = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    library.encode_special_tokens = True
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("\u2581", " ").encode()
    docs = []
    for text in texts:
        out = None
        if text:
            a = [(i, ranks[i]) for i in library.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, piece(i)) for i in sp.encode(text)]
            if b"".join(x for _, x in a) == (" " + text).encode() == b"".join(x for _, x in b):
                ends = lambda t: [sum(len(x) for _, x in t[: k + 1]) for k in range(len(t))]
                cuts = sorted(set(ends(a)) & set(ends(b)))
                place = lambda e: next(k for k, c in enumerate(cuts) if e <= c)
                out = [([], []) for _ in cuts]
                for side, t in enumerate((a, b)):
                    for (i, _), e in zip(t, ends(t), strict=True):
                        out[place(e)][side].append(i)
        docs.append(out)
    counts = collections.Counter(p for d in docs for p in {(x, y) for g in d or () for x in g[0] for y in g[1]})
    most = collections.Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    rows = []
    for d in docs:
        linked = [(x, y) for g in d or () for x in g[0] for y in g[1]]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in d or ())
        best, total = sum(counts[p] == most[p[0]] for p in linked), sum(counts[p] for p in linked)
        rows.append((sum(len(a) for a, _ in d or ()), sum(len(b) for _, b in d or ()), len(d or ()), len(linked), best, total, hashlib.sha256(said.encode()).hexdigest() if d else ""))
    return rows


@pytest.mark.parametrize("hot", [3, 1 << 18])
def test_alignment_equals_the_libraries(spark, odd, empty, hot):
    rng = random.Random(9)
    parts = ["the", "ing", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\u3000", "\x1c", "é", "中文", "😀", "'s", "2024", ".", "<|endoftext|>", "<s>", "don't", "▁", "Straße", " of", "\r\n", "xx", "\x00"]
    texts = ["".join(rng.choices(parts, [9 if p != "▁" else 1 for p in parts], k=rng.randrange(1, 40))) for _ in range(300)] + [None, "", " ", "\n", "plain words here", "plain words here", "▁"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in alignment.digests(df, BYTES, PIECES, hot=hot).collect()}
    want = plain_alignment(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(r[0] > 0 for r in want) > 150
    if hot > 3:
        assert alignment.digests(empty, BYTES, PIECES).collect() == []
        rows = [r for r in odd.collect() if len(r["text"] or "") < 1000]
        some = odd.where("length(text) < 1000 or text is null")
        assert collections.Counter(map(tuple, alignment.digests(some, BYTES, PIECES).collect())) == collections.Counter((r["doc_id"], *w) for r, w in zip(rows, plain_alignment([r["text"] for r in rows]), strict=True))
        assert alignment.digests(odd, BYTES, PIECES).count() == odd.count()
