"""Operators against plain versions of what they promise, on odd rows and on empty tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from trailweave.llm import gru, mainhtml, merkle, mixing, neardup, pieces, quality, ranges, sharding, sstable, urls

PIECES, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("run", [neardup.classes, sharding.assign, merkle.fingerprints, gru.scored, quality.judged, mixing.mix, lambda d: pieces.digests(d, PIECES), lambda d: sstable.digests(d, BYTES)])
def test_empty_table_and_odd_rows(odd, empty, run):
    assert rows(run(empty)) == []
    got = collections.Counter(r["doc_id"] for r in run(odd).select("doc_id").collect())
    assert got == collections.Counter({1: 1, 2: 2, 3: 1, None: 2, 7: 1, 8: 1, 9: 1, 2**53 + 1: 1})


def test_pieces_equal_the_library(odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter()
    for r in odd.collect():
        ids = sp.encode(r["text"] or "")
        want[(r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))] += 1
    assert want == collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.digests(odd, PIECES).collect())


def test_pieces_on_random_strings():
    import sentencepiece

    rng, sp, model = random.Random(4), sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.model_of(PIECES)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "▁", "é", "中", "😀", "----", "aaaa", "<s>", "<0x41>", "12", ".", "\r\n"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(1500)] + ["".join(rng.choices("aeiostnr", k=400)) for _ in range(200)]
    for text, ids in zip(texts, model.encode_texts(texts), strict=True):
        assert ids == ",".join(map(str, sp.encode(text)))


def test_pieces_of_a_long_text_without_blanks():
    import time

    import sentencepiece

    rng, sp, model = random.Random(8), sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.PieceModel(PIECES)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) if rng.random() < 0.7 else rng.choice("abcdefgh的是中") for _ in range(300_000))
    began = time.process_time()
    assert next(model.encode_texts([text])) == ",".join(map(str, sp.encode(text)))
    assert time.process_time() - began < 30


def test_tables_equal_the_library_and_look_up(odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    docs = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    got = sorted(sstable.digests(odd, BYTES).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in docs]
    want, start = [], 0
    by_id = collections.defaultdict(collections.Counter)
    for r in docs:
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        by_id[r["doc_id"]][(len(ids), zlib.crc32(ids.tobytes()))] += 1
        start += len(ids)
    for r in got:
        assert r["start"] == sum(x["n_tokens"] for x in want)
        want.append(r)
        by_id[r["doc_id"]][(r["n_tokens"], r["ids_crc32"])] -= 1
    assert not any(n for c in by_id.values() for n in c.values()) and sum(r["n_tokens"] for r in got) == start


def test_units_on_random_strings():
    from tokenizers import Tokenizer

    rng, library, encoder = random.Random(3), Tokenizer.from_file(BYTES), sstable.UnitEncoder(BYTES)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u3000", "\x1c", "\x85", "é", "中", "😀", "'s", "12", ".", "<|endoftext|>", "\x0b", "don't"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(50))) for _ in range(8000)]
    for text, ids in zip(texts, encoder.encode(texts, None), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_table_bytes():
    writer, values = sstable.TableWriter(2), {i * i: np.arange(i % 900, dtype="<u2").tobytes() for i in range(1200)}
    for k, v in values.items():
        writer.add(sstable.key_bytes(k), v)
    table = sstable.Table(writer.finish())
    assert len(table.blocks) > 3 and [(sstable.identifier_of(k), v) for k, v in table] == list(values.items())
    assert all(table.get(sstable.key_bytes(k)) == [v] for k, v in list(values.items())[::37])
    assert table.get(sstable.key_bytes(2)) == [] and table.get(sstable.key_bytes(None)) == []


def test_shards_are_equal_and_gapless(spark):
    rng = random.Random(1)
    docs = [(i, "copy " * 9 if i % 3 == 0 else "w " * rng.randrange(400)) for i in range(3000)] + [(None, "copy " * 9)] * 500
    got = rows(sharding.assign(spark.createDataFrame(docs, "doc_id long, text string"), 40))
    size = {i: len(t) + 16 for i, t in docs}
    total, per, slots = sum(len(t) + 16 for _, t in docs), collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["text_crc32"] == zlib.crc32(dict(docs)[r["doc_id"]].encode())
        per[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 3500 and len(per) == 40
    assert max(abs(n - total / 40) for n in per.values()) <= sharding.SLACK * total / 40 + max(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_light_groups_of_equal_texts_stay_whole(spark):
    docs = [(4 * g + k, f"text {g} " + "w " * (g % 20)) for g in range(1000) for k in range(4)] + [(9000 + k, "heavy") for k in range(3000)]
    got = rows(sharding.assign(spark.createDataFrame(docs, "doc_id long, text string"), 40))
    at, per = collections.defaultdict(set), collections.Counter()
    for r in got:
        at[r["doc_id"] // 4].add(r["shard"])
        per[r["shard"]] += r["size"]
    assert all(len(at[g]) == 1 for g in range(1000)) and len({s for g, x in at.items() if g >= 2250 for s in x}) > 5
    share = sum(per.values()) / 40
    assert max(abs(n - share) for n in per.values()) <= sharding.SLACK * share + 150


def test_mix_comes_near_its_targets(spark):
    docs = [(i, "w " * (1 + i % 50), "big" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None) for i in range(4000)]
    got = rows(mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")))
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert all(abs(t - want) <= 0.02 * want + 20 for t, want in by.values())
    assert sum(t for _, t in by.values()) == pytest.approx(sum(1 + i % 50 for i in range(4000)))


def test_mix_meets_the_targets_of_small_sources(spark):
    # 2**17 blocks of 20 words; most sources hold a few blocks or less than one
    small = {f"s{n}": n for n in (1, 3, 19, 20, 21, 50, 333, 4000)} | {None: 70}
    docs = [(i, "w " * 4000, "big") for i in range(640)] + [(1000 + 100 * k + j, "w " * (n // 3 + (j < n % 3)), s) for k, (s, n) in enumerate(small.items()) for j in range(3)]
    got = rows(mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")))
    assert len(got) == len(docs)
    for s, n in small.items():
        mine = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in mine) == round(mine[0]["target"]) == 3 * n
        assert all(r["taken"] == 3 * r["size"] for r in mine)
    # 40,000 words towards 1 of 11 shares of 640,000: one pass and 18,182 words of the next
    docs = [(i, "w " * 4000, f"big{i % 2}" if i % 16 else "few") for i in range(160)]
    few = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), weights=(5, 5, 1), slots=2**10).where("source = 'few'")
    assert sorted(r["taken"] for r in rows(few)) == [4000] * 5 + [6182] + [8000] * 4


@pytest.mark.parametrize("words", [8, 400])
def test_the_size_of_the_table_changes_no_share_of_a_mix(spark, words):
    # blocks of one word, then of some: a source of few blocks meets its target in both
    docs = [(i, "w " * words, "c" if i % 40 == 0 else "ab"[i % 2]) for i in range(4000)]
    got = rows(mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), weights=(5, 5, 0.15), slots=2**15))
    mine = [r for r in got if r["source"] == "c"]
    assert sum(r["taken"] for r in mine) == round(mine[0]["target"]) == round(4000 * words * 0.15 / 10.15)


def test_targets_hold_small_sources_down():
    got = {s.name: s.target for s in mixing.targets({"a": 10, "b": 1000, None: 1000})}
    assert got["a"] == 30 and got["b"] + got[None] == 1980 and got["b"] == 2 * got[None]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage, docs = [word() for _ in range(60)], []
    for base in range(40):
        text = [word() for _ in range(60 + 5 * base)]
        docs.append(passage + text if base % 2 else text)
        for _ in range(rng.randrange(5)):
            copy = list(docs[-1])
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(copy)
    docs += [passage + [word() for _ in range(40)] for _ in range(60)]
    texts = [" ".join(d) for d in docs]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    root = list(range(len(texts)))
    for i in range(len(docs)):
        for j in range(i):
            if root[i] != root[j] and edit_similarity(docs[i], docs[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert got == dict(enumerate(root))


def test_all_that_share_a_crowded_bucket_are_compared(spark):
    # pairs of similarity 0.8 with a common passage, a fifth of whose words are spread so that few shingles of five are left
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = [word() for _ in range(50)]
    docs = [passage + [word() for _ in range(50)] for _ in range(60)]
    for i in range(10):
        docs.append([*passage, *(word() if j % 5 < 2 else w for j, w in enumerate(docs[i][50:]))])
    assert all(edit_similarity(docs[i], docs[60 + i]) >= 0.8 for i in range(10))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()}
    assert got == {i: i % 60 for i in range(70)}


@pytest.mark.parametrize("least", [0.8, 0.6])
def test_the_exact_join_leaves_no_pair_out(spark, least):
    rng = random.Random(9)
    docs = []
    for _ in range(40):
        base = [rng.randrange(400) for _ in range(rng.randrange(1, 60))]
        docs += [[rng.randrange(400) if rng.random() < share else w for w in base] for share in (0, 0.1, 0.2, 0.3)]
    nodes = {bytes([i]): np.array(d, np.uint32) for i, d in enumerate(docs)}
    seqs = neardup.staged(spark.createDataFrame([(k, d.tobytes()) for k, d in nodes.items()], "node binary, seq binary"), "test-seqs")
    pairs = neardup.rare_pairs(seqs.select("node"), spark.createDataFrame([], "node binary, root binary"), seqs, least)
    got = [(bytes(r["u"]), bytes(r["v"])) for r in neardup.verified_in_tiles(pairs, seqs, least, 50).collect()]
    want = {(u, v) for u in nodes for v in nodes if u > v and neardup.similarity(nodes[u], nodes[v], least) >= least}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


@pytest.mark.parametrize("wide", [32, 1])
def test_a_family_below_the_threshold_makes_few_rows_of_pairs(spark, monkeypatch, wide):
    # copies of one text, each with 75 to 125 of 500 words changed: most pairs stay below 0.8, some reach it
    rng = random.Random(10)
    base = [f"w{i}" for i in range(500)]
    docs = []
    for i in range(90):
        spoilt = set(rng.sample(range(450), 40 + i))
        docs.append([f"x{rng.randrange(10**6)}" if j in spoilt else w for j, w in enumerate(base)])
    seen, plain = [], neardup.verified_in_tiles
    monkeypatch.setattr(neardup, "verified_in_tiles", lambda pairs, *a, **k: seen.append(pairs.count()) or plain(pairs, *a, **k))
    monkeypatch.setattr(neardup, "WIDE", wide, raising=False)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()}
    words = [neardup.word_hashes(" ".join(d)) for d in docs]
    want = list(range(90))
    for i in range(90):
        for j in range(i):
            if want[i] != want[j] and neardup.similarity(words[i], words[j]) >= 0.8:
                want = [min(want[i], want[j]) if w in (want[i], want[j]) else w for w in want]
    assert got == dict(enumerate(want)) and 2 < len(set(want)) < 80
    assert sum(seen) < 1000


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edit_similarity(a, b):
    if min(len(a), len(b)) < 0.8 * max(len(a), len(b)) or sum((collections.Counter(a) & collections.Counter(b)).values()) < 0.8 * max(len(a), len(b)):
        return 0.0  # each word that has no like costs an edit
    return 1 - edit_distance(a, b) / max(len(a), len(b))


def test_banded_edits_equal_the_full_table():
    rng = random.Random(1)
    for t in range(3000):
        a = [rng.randrange(4 if t % 2 else 50) for _ in range(rng.randrange(25))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(50)] * rng.randrange(2)
        limit, want = rng.randrange(12), edit_distance(a, b)
        got = neardup.edits_within(np.array(a, np.uint32), np.array(b, np.uint32), limit)
        assert got == want if want <= limit else got > limit


def test_near_copies_of_the_given_documents_are_found(spark):
    """All pairs of different texts whose words are edited in at most a tenth, against the classes; at least 0.9 of them,
    and no class joins what no chain of pairs of 0.8 joins."""
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    held = collections.defaultdict(set)
    for i, words in docs.items():
        for gram in zip(words, words[1:], strict=False):
            held[gram].add(i)
    common = collections.Counter(pair for some in held.values() if len(some) <= 60 for pair in itertools.combinations(sorted(some), 2))
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id", "class_id").collect()}
    longer = lambda i, j: max(len(docs[i]), len(docs[j]))
    near = [(i, j) for (i, j), n in common.items() if docs[i] != docs[j] and longer(i, j) <= 1500 and n >= 0.5 * longer(i, j) and edit_similarity(docs[i], docs[j]) >= 0.9]
    assert len(near) > 50 and sum(found[i] == found[j] for i, j in near) >= 0.98 * len(near)
    members = collections.defaultdict(list)
    for i, c in found.items():
        members[c].append(i)
    for some in members.values():
        left, todo = set(some[1:]), some[:1]
        while todo:
            i = todo.pop()
            new = {j for j in left if docs[i] == docs[j] or longer(i, j) > 1500 or edit_similarity(docs[i], docs[j]) >= 0.8}
            left, todo = left - new, todo + list(new)
        assert not left


def test_order_matters_for_near_duplicates():
    words = neardup.word_hashes(" ".join(f"w{i}" for i in range(100)))
    assert neardup.similarity(words, words) == 1 and neardup.similarity(words, np.r_[words[50:], words[:50]]) == 0


def test_kept_rows_is_one_per_class(odd):
    kept = neardup.kept_rows(odd).collect()
    assert kept[0].asDict().keys() == odd.first().asDict().keys()
    assert len({r["text"] for r in kept if r["text"]}) == len([r for r in kept if r["text"]])
    assert sum((r["text"] or "").startswith("Many") for r in kept) == 1


def test_url_rules_and_words(spark):
    urls_ = ["https://a.B.net/en/1", "x://m.example.net/en/2?q", "x://org/fr/#", "http://www.cheappills.example.com/en/buy", "http://www.rivers.example.com/en/3", None, "no scheme", "x://example.com/de/1"] * 30
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(8)] == [
        ("a.b.net", "/en/1", "net/", "block"), ("m.example.net", "/en/2", "example.net/en/", "allow"), ("org", "/fr/", "org/fr/", "allow"), ("www.cheappills.example.com", "/en/buy", None, "block"),
        ("www.rivers.example.com", "/en/3", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.com", "/de/1", "example.com/de/", "block"),
    ]
    assert "h:cheap h:pills" in got[3]["words"]


def test_url_model_learns_beyond_its_seeds(spark):
    rng = random.Random(6)
    clean, spam = ["river", "garden", "market", "stone", "bridge", "farm"], ["roulette", "freespins", "bigwin", "vipclub"]
    urls_ = [f"http://{rng.choice(clean)}-{rng.choice(clean)}.example.com/{rng.choice(clean)}/{i}" for i in range(1500)]
    urls_ += [f"http://casino-{rng.choice(spam)}.example.com/{rng.choice(spam)}/{i}" for i in range(150)]
    asked = ["http://vipclub-roulette.example.com/bigwin/1", "http://farm-market.example.com/river/2", "http://río-größe.example.com/straße/3", "http://" + "ab" * 700 + ".example.com/"]
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(list(enumerate(asked + urls_)), "page_id long, url string")).collect()}
    assert [got[i]["verdict"] for i in range(4)] == ["block", "allow", "allow", "allow"]  # the first has no seed, the second has a weak one
    assert urls.seeded(got[0]["words"].split()) == 0 and urls.seeded(got[1]["words"].split()) is None and "p:straße" in got[2]["words"]
    assert sum(got[4 + i]["verdict"] == "block" for i in range(1500)) == 0 and all(got[4 + 1500 + i]["verdict"] == "block" for i in range(150))
    # scores against a plain count over the same words
    words = {i: r["words"].split() for i, r in got.items()}

    def counted(label, seeds):
        count, docs = [collections.Counter(), collections.Counter()], [0, 0]
        for w in words.values():
            if (c := label(w)) is not None:
                docs[c] += 1
                count[c].update(urls.place(x) for x in w if seeds or x[2:] not in urls.SEEDS)
        full = [sum(c.values()) + urls.SMOOTHING * urls.BUCKETS for c in count]
        part = lambda x, c: np.log((count[c][urls.place(x)] + urls.SMOOTHING) / full[c])
        return lambda w: np.log((docs[1] + 1) / (docs[0] + 1)) + sum(part(x, 1) - part(x, 0) for x in w if seeds or x[2:] not in urls.SEEDS)

    first = counted(urls.seeded, False)
    second = counted(lambda w: 1 if urls.seeded(w) or first(w) >= urls.SURE else 0, True)
    assert all(r["score"] == pytest.approx(second(words[i]), abs=1e-3) for i, r in list(got.items())[::40])


def test_url_and_page_operators_on_odd_rows(spark):
    schema = "page_id long, url string, html string, host string, text string, n_chars string, words string"
    odd_pages = [(1, None, None, "h", "t", "c", "w"), (1, None, None, "h", "t", "c", "w"), (None, "", "", None, None, None, None), (2, "x://a.b/" + "c" * 100_000, "<p>" + "word, " * 30_000, None, None, None, None), (2**53 + 1, "no scheme", "a < b", None, None, None, None)]
    for run in (urls.judged, mainhtml.extracted):
        got = collections.Counter(r["page_id"] for r in run(spark.createDataFrame(odd_pages, schema)).collect())
        assert got == collections.Counter({1: 2, None: 1, 2: 1, 2**53 + 1: 1})
        assert rows(run(spark.createDataFrame([], schema))) == []


def test_main_text():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><nav><ul><li><a href="/">Home</a></ul></nav><header><h1>Site</h1></header>
    <div class="content"><h1>Rivers &amp; bridges</h1><p>Some long text, with commas,\n and more.<p>Second <b>bold</b><br>line<script>var p = "</p>";</script>
    <div class="ad">Buy, buy, buy</div><ul><li>one, two</li><li>three</li></ul></div><div id="comments"><p>nice, very, very nice, indeed</p></div><footer>&copy; x</footer></body>"""
    assert mainhtml.main_text(page) == "Rivers & bridges\n\nSome long text, with commas, and more.\n\nSecond bold line\n\none, two\n\nthree"
    assert [mainhtml.main_text(p) for p in (None, "", "<p", "a < b")] == ["", "", "", "a < b"]


def test_scores_choose_the_container():
    prose = "<p>" + "Some long text, with commas, and more words in it. " * 4 + "</p>"
    # the text stands outside the article, which only holds a list of links
    links = "".join(f"<li><a href='/{i}'>a link, another, and one more</a></li>" for i in range(9))
    page = f"<body><article><ul>{links}</ul></article><div><h2 id='related-work'>Title</h2>{prose * 3}</div><div class='sidebar'>{prose}</div></body>"
    want = "\n\n".join(["Title"] + [mainhtml.clean("Some long text, with commas, and more words in it. " * 4)] * 3)
    assert mainhtml.main_text(page) == want
    # a class that names a sidebar does not lose the page's only text, but an advert is dropped at any size
    assert mainhtml.main_text(f"<body><div class='content no-sidebar'>{prose * 3}</div></body>") == want.removeprefix("Title\n\n")
    assert mainhtml.main_text(f"<body><div class='search-widget'><h2>Title</h2>{prose * 3}</div><p>x</p></body>").startswith(want)
    assert mainhtml.main_text(f"<body><div class='ad'>{prose * 3}</div><article><p>x</p></article></body>") == "x"
    # of two articles the one with more text outside links is kept, and parts of one container stay together
    assert mainhtml.main_text(f"<body><article>{links}</article><article><section>{prose}</section><section>{prose}</section><p>End.</p></article></body>") == want.split("\n\n")[1] + "\n\n" + want.split("\n\n")[1] + "\n\nEnd."


def test_scores_equal_a_plain_sum():
    rng = random.Random(2)
    for _ in range(60):
        page, opened = [], []
        for _ in range(40):
            kind = rng.randrange(3)
            if kind == 0 or not opened:
                opened.append(rng.choice(["div", "section", "article"]))
                page.append(f"<{opened[-1]}>")
            elif kind == 1:
                page.append(f"<p>{'word, ' * rng.randrange(1, 9)}<a>{'link ' * rng.randrange(3)}</a></p>")
            else:
                page.append(f"</{opened.pop()}>")
        root = mainhtml.parse("".join(page))
        want = collections.Counter()
        for node in mainhtml.measured(root):
            up, share = node.parent, 1.0
            while up:
                want[id(up)] += node.own * share
                up, share = up.parent, share / 2
        assert all(n.held == pytest.approx(sum(m.own for m in below(n))) for n in below(root))
        assert all(n.points == pytest.approx(want[id(n)]) for n in below(root))


def below(node):
    return [node] + [x for item in node.items if not isinstance(item, str) for x in below(item)]


def test_deep_pages_take_time_in_proportion():
    import time

    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        assert mainhtml.main_text("<div>" * n + "<p>a, b</p>" + "</i></div>" * n) == "a, b"
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(0)
    w = gru.first_weights(rng.integers(0, 50, gru.SYMBOLS))
    x, y = (rng.integers(0, gru.SYMBOLS, (5, 4)).astype(np.int32) for _ in range(2))
    fresh, real, h = np.zeros((5, 4), bool), np.ones((5, 4), bool), rng.normal(0, 0.5, (4, gru.HIDDEN))
    fresh[2, 1], real[4, 3] = True, False
    grad, _, _ = gru.Model(w).gradient(x, y, fresh, real, h.astype(np.float32))

    def loss(v):
        model = gru.Model(v)
        return -model.outputs(model.states(x, fresh, h)[0][real].astype(float), y[real])[0].mean()

    for i in np.argsort(-np.abs(grad))[:200:25]:
        step = np.zeros(gru.SIZE)
        step[i] = 1e-3
        assert grad[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-3, rel=1e-2, abs=1e-6)


@pytest.mark.parametrize("large", [1, 40])
def test_likelihoods_equal_a_plain_softmax(large):
    # with weights of either size: with a shift of exponents and without
    rng = np.random.default_rng(11)
    flat = (rng.normal(0, 0.3, gru.SIZE) * large).astype(np.float32)
    p = {k: v.astype(np.float64) for k, v in gru.views(flat).items()}
    h, y = np.tanh(rng.normal(size=(200, gru.HIDDEN))).astype(np.float32), rng.integers(0, gru.SYMBOLS, 200)
    log_softmax = lambda a: a - a.max() - np.log(np.exp(a - a.max()).sum())
    want = []
    for state, symbol in zip(h.astype(np.float64), y.tolist(), strict=True):
        cls = symbol // gru.WIDE if symbol < gru.TOP else symbol - gru.TOP + gru.FREQUENT
        like = log_softmax(state @ p["Wc"] + p["bc"])[cls]
        want.append(like + (log_softmax(state @ p["Ww"][cls] + p["bw"][cls])[symbol % gru.WIDE] if symbol < gru.TOP else 0))
    assert np.allclose(gru.Model(flat).outputs(h, y)[0], want, rtol=1e-4, atol=1e-4)


def test_state_is_carried_and_texts_stand_alone():
    rng = np.random.default_rng(1)
    w = gru.first_weights(np.ones(gru.SYMBOLS))
    texts = [rng.integers(1, gru.SYMBOLS, n).astype(np.int32) for n in (0, 1, 40, 300, 7)]
    together = gru.loglik(w, texts)
    assert together == pytest.approx([gru.loglik(w, [t])[0] for t in texts], rel=1e-4)


def test_held_out_texts_score_above_the_base(spark, sf):
    got = gru.scored(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_counts_and_base_scores_equal_a_plain_count(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    words = {i: [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    count = collections.Counter(w for i, ws in words.items() if not held[i] for w in [*ws, None])
    n, v = sum(count.values()), len(count)
    for r in gru.scored(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        ws = [*words[r["doc_id"]], None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(w in count for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))


def test_scores_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, four = ({r["doc_id"]: r["score"] for r in gru.scored(docs.repartition(n, "n_chars")).collect()} for n in (1, 4))
    assert one == four


def test_merkle_finds_the_edit(spark):
    lines = [f"line {i} " + "z" * (i % 200) for i in range(60)]
    texts = {1: lines, 2: [x.replace("line 30 ", "line X ") for x in lines], 3: lines, 4: [*lines[:30], "one more", *lines[30:]], 5: lines[:30] + lines[31:]}
    r = {x["doc_id"]: x for x in merkle.fingerprints(spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()}
    tree = {i: x["fingerprint"].split(":") for i, x in r.items()}
    assert r[1]["fingerprint"] == r[3]["fingerprint"] and len({tree[i][0] for i in tree}) == 4 and len(tree[1][1].split("|")) > 4
    for i in (2, 4, 5):
        own, other = set(tree[1][1].split("|")), set(tree[i][1].split("|"))
        assert len(own - other) <= 2 and len(other - own) <= 2  # the section of the edit, two where a border comes or goes
        leaves = lambda tree: {leaf for s in tree for leaf in s.split("=")[1].replace(";", ",").split(",")}
        assert len(leaves(own) ^ leaves(other)) <= 6
    assert 0.9 < r[2]["near_next"] < 1 and r[1]["near_edited"] > 0.4


def test_ranges_are_numbered_by_the_splitters_returned(spark):
    moved = []
    for seed in range(6):
        rng = random.Random(seed)
        docs = [(i, rng.choice([50_000, 400_000]) if rng.random() < 0.02 else rng.randrange(1, 60)) for i in range(3000)]
        keys = spark.createDataFrame(docs, "id long, weight long").select(ranges.key_of(F.lit(0), F.col("id")).alias("key"), "weight")
        out, found, splitters = ranges.with_ranges(keys, 200)
        got = {r["key"]["b"]: (r["range"], r["want"]) for r in out.withColumn("want", ranges.range_of(splitters)).collect()}
        moved.append(sum(a != b for a, b in got.values()))
        weight = collections.Counter()
        for i, w in docs:
            weight[got[i][0]] += w
        assert {r["range"]: r["weight"] for r in found} == weight
    assert moved == [0] * 6


def test_every_document_finds_its_next_beside_heavy_ones(spark):
    rng = random.Random(1)
    docs = {i: f"{i} " + "x" * (rng.choice([5_000, 40_000]) if rng.random() < 0.02 else rng.randrange(60)) for i in range(3000)}
    table, order = merkle.with_next(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "doc_id", "text", bytes_per_range=4000)
    got = {r["doc_id"]: r["next"] for r in table.withColumn("next", F.lead("text").over(order)).where("guest = 0").select("doc_id", "next").collect()}
    assert got == {i: docs[(i - 1) % 3000] for i in docs}


def test_quality_counts(odd):
    text = "a b c d e f g h\na b c d e f g h\nx # $ y\nx # $ y"
    got = quality.counted(odd.limit(1).selectExpr(f"'{text}' as text".replace("\n", "\\n"))).first()
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (24, 24, 4, 2, 16)
