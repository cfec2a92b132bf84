"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from test_cases import LONG, docs

from dossier.llm import importance

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute(pairs, target, percent=25, least=20):
    found = [(i, *runs(t)) for i, t in pairs]
    corpus, wanted = Counter(b for *_, f in found for b in f), Counter(b for t in target for b in runs(t)[1])
    s, t = sum(corpus.values()), sum(wanted.values())
    out = []
    for i, n, f in found:
        gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((corpus[b] + 1) * (t + 10_000)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted([r for r in out if r[0] is not None and r[1] >= least], key=lambda r: (-r[4], r[0]))
    chosen = able[: percent * len(able) // 100]
    return sorted([(i, f, w, s, chosen.index(r) + 1 if (r := (i, n, f, w, s)) in chosen else None) for i, n, f, w, s in out], key=str)


def got(df):
    return sorted([(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()], key=str)


def texts(seed, n, extra=()):
    rng = np.random.default_rng(seed)
    words = ["The", "of", "ÉTÉ", "été", "naïve", "x1", "B", "straße", " ", "\x85y", "z" * 300]
    return [" ,\n"[k % 3].join(words[i] for i in rng.integers(0, len(words), k)) for k in rng.integers(0, 60, n)] + list(extra)


def test_against_brute_force(spark):
    given = texts(1, 80, [None, "", "!!", LONG, "w" * 70_000, "The of " * 40])
    target = [*texts(2, 5), None]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for percent in (25, 0, 100):
        assert got(importance.resampled(docs(spark, *given), items, percent)) == brute(list(enumerate(given, 1)), target, percent)


def test_ids_and_nothing(spark):
    t = "one two three four five six seven eight nine ten " * 3
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    big = (1 << 53) + 1
    out = got(importance.resampled(docs(spark, t, t, t, t, t, ids=[big, None, 4, 4, 9]), items, 100))
    assert [r[0] for r in out if r[4] is None] == [None] and sorted(r[4] for r in out if r[4]) == [1, 2, 3, 4] and big in {r[0] for r in out}
    assert got(importance.resampled(docs(spark, t).limit(0), items)) == []
    assert got(importance.resampled(docs(spark, t, t, t, t), items.limit(0))) == brute(list(enumerate([t] * 4, 1)), [])


def test_pieces_and_joined_sums():
    rng = np.random.default_rng(3)
    for a, b in ((b"", b"x"), (b"ab ", b"c" * 1000), ("é ".encode(), bytes(rng.integers(0, 256, 70_001, np.uint8)))):
        assert importance.joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))[0] == zlib.crc32(a + b)
    given = [t.encode() for t in texts(4, 30)]
    whole = [(n, sorted(b)) for n, b in importance.buckets(given)]
    assert whole == [(n, sorted(b)) for n, b in importance.buckets(given, size=50)]
