"""URL filters: host and path rules, else word segmentation and naive Bayes.

Names in hosts are run together, so each label is split into words by unigram Viterbi: the split with the highest
product of word probabilities, where an unknown word costs more the longer it is. The unigrams are the tokens of all
paths of the table and of those host labels that hyphens set apart, but for those rarer than one in ``RAREST`` tokens,
with the seed words added. Words are runs of letters of any script, lower-cased; numbers count as one word.

Two multinomial naive Bayes models score the words of host and path, hashed into ``BUCKETS`` places so that a model is
of a fixed size. The first never sees a seed word: it learns which other words stand beside seeds, from URLs with a
seed (blocked) and without any (allowed); those whose only seed is a common word are left out. The second learns all
words, seeds included, from the labels that follow: blocked are URLs with a seed, and those that the first model is sure
of. So a URL may be blocked without any seed, and one with a seed that is mostly found in clean company is allowed.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed. Ties go to allow. Repeated
rows are judged alike and count each in training; an empty table gives no rows. Only the lexicon (``RAREST`` words at
most) and the hashed counts reach the driver.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged

BUCKETS = 1 << 18
RAREST = 1_000_000
#: Log odds from which on the first model labels a URL for the second: nine to one.
SURE = math.log(9)
#: Added to each count; small against the words of the rarer class, spread over all places.
SMOOTHING = 0.01
# fixed values: words that mark a site to be blocked
SEEDS = frozenset("ads adserver adult bet bets betting bitcoin bonus cams casino cheap click clickbait counterfeit crack dating escort farm fetish free gambling hack jackpot keygen loan loans lottery malware milf nude payday pharma pharmacy phishing pill pills piracy poker porn prize replica scam sex sexy slots spam torrent tracker tracking viagra virus warez winner xxx".split())
#: These alone are common in clean names too: two of all seeds are needed where one of them is the only kind.
WEAK = frozenset("bet bonus cheap click crack dating farm free hack loan loans prize winner".split())
#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TOKENS = re.compile(r"[^\W\d_]+|\d+")
LONGEST = 24


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.locate("://", url) > 0, lower).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Unigram Viterbi over a lexicon of counts."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total * 10)
        self.split = functools.lru_cache(100_000)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for j in range(1, len(name) + 1):
            c, i = min((best[i] + (self.cost.get(name[i:j]) or self.unknown + 2.3 * (j - i)), i) for i in range(max(0, j - LONGEST), j))
            best.append(c)
            back.append(i)
        words, j = [], len(name)
        while j:
            words.append(name[back[j] : j])
            j = back[j]
        return tuple(reversed(words))

    def words(self, host: str, path: str) -> list[str]:
        """Words of host and path, told apart by where they stand; numbers count as one word."""
        out = []
        for where, part in (("h:", host.lower()), ("p:", path.lower())):
            for token in TOKENS.findall(part):
                out += [where + "0"] if token[0].isdigit() else [where + w for w in self.split(token)]
        return out


def seeded(words: list[str]) -> int | None:
    """1 with a seed word, 0 without any, None with nothing but one weak seed."""
    found = {w[2:] for w in words}.intersection(SEEDS)
    if len(found) == 1 and found <= WEAK:
        return None
    return int(bool(found))


def place(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def lexicon_of(parts: DataFrame) -> dict[str, int]:
    # a label that stands alone may itself be run together, so hosts lend only words that hyphens or digits set apart
    apart = F.regexp_replace("host", r"(^|\.)\p{L}+(?=\.|:|$)", "$1")
    tokens = parts.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", apart, "path")), F.lit(f"(?<!\\p{{L}})\\p{{L}}{{3,{LONGEST}}}(?!\\p{{L}})"), F.lit(0))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    counts = {r["token"]: r["n"] for r in counts.where(F.col("n") * RAREST >= total).collect()}
    typical = max(10, total // 1000)
    return {s: typical for s in SEEDS} | counts


def train(parts: DataFrame, lexicon: dict[str, int], label, seeds: bool) -> np.ndarray:
    """Log ratio of each hashed word between the blocked and the allowed class; the last entry is that of the classes.

    ``label`` gives 1, 0 or None (not learnt from) for a list of words; without ``seeds``, seed words are no features.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, counts = Segmenter(lexicon), Counter()
        for batch in batches:
            for host, path in zip(batch["host"], batch["path"], strict=True):
                words = cut.words(host, path)
                if (cls := label(words)) is not None:
                    counts[(BUCKETS, cls)] += 1
                    counts.update((place(w), cls) for w in words if seeds or w[2:] not in SEEDS)
        if counts:
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["place", "cls", "n"])

    sums = parts.mapInPandas(run, "place int, cls int, n long").groupBy("place", "cls").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((2, BUCKETS + 1))
    for r in sums:
        table[r["cls"], r["place"]] = r["n"]
    words = table[:, :BUCKETS] + SMOOTHING
    words /= words.sum(axis=1, keepdims=True)
    classes = np.log(table[1, BUCKETS] + 1) - np.log(table[0, BUCKETS] + 1)
    return np.r_[np.log(words[1]) - np.log(words[0]), classes].astype(np.float32)


def odds(ratio: np.ndarray, words: list[str], seeds: bool) -> float:
    """Log odds of the blocked class."""
    at = [place(w) for w in words if seeds or w[2:] not in SEEDS]
    return float(ratio[BUCKETS]) + float(ratio[at].sum(dtype=np.float64))


def learnt(parts: DataFrame, lexicon: dict[str, int]) -> np.ndarray:
    """The second model, from the labels of the first."""
    first = train(parts, lexicon, seeded, seeds=False)

    def label(words: list[str]) -> int | None:
        return 1 if seeded(words) or odds(first, words, False) >= SURE else 0

    return train(parts, lexicon, label, seeds=True)


def judged(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and words and score of the method: one row per row of ``df``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = staged(df.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")), "url-parts")
    counts = lexicon_of(parts)
    ratio = learnt(parts, counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Segmenter(counts)
        for batch in batches:
            words = [cut.words(h, p) for h, p in zip(batch["host"], batch["path"], strict=True)]
            batch["words"] = [" ".join(w) for w in words]
            batch["score"] = [odds(ratio, w, True) for w in words]
            yield batch

    rows = map_batches(parts, "page_id", run, "host string, path string, words string, score double")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("score") > 0) & (F.col("words") != ""), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "words", "score")
