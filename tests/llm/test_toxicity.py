"""Toxicity: the index against all cosines, votes against a plain version, held-out documents and odd rows."""

import math
from collections import Counter

import numpy as np
import pytest
from test_cases import LONG, docs, rows

from dossier.llm import toxicity


def cosine(a, b):
    return round(sum(w * b.get(t, 0.0) for t, w in a.items()), 12)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_nearest_is_exact(block):
    rng = np.random.default_rng(block)
    idf = rng.uniform(1, 5, 30)
    vector = lambda: toxicity.unit({int(t): int(rng.integers(1, 4)) for t in rng.choice(30, rng.integers(0, 6), False)}, idf)
    given = [(int(i), int(i) % 2, vector()) for i in rng.permutation(300)]
    given += [(300 + i, 1, given[i][2]) for i in range(40)]  # ties
    index = toxicity.Index(given, 30, block)
    for i, _, own in given[:120] + [(-1, 0, vector()) for _ in range(30)]:
        for without in (None, i):
            want = sorted([(-cosine(own, v), j) for j, _, v in given if j != without and cosine(own, v) > 0])[:10]
            got = [(-s, int(index.ids[p])) for s, p in index.nearest(own, 10, without)]
            assert [j for _, j in got] == [j for _, j in want] and np.allclose([s for s, _ in got], [s for s, _ in want])
    assert toxicity.Index([], 3).nearest({1: 1.0}) == [] and toxicity.Index([(1, 0, {})], 3).nearest({1: 1.0}) == []


def made(seed, n):
    """Texts of made words; toxic ones hold one or two of five words, or words with one beginning."""
    rng = np.random.default_rng(seed)
    bad = ["gribble", "snarf", "Wozzle", "pft", "muckle"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(rng.integers(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[int(rng.integers(0, len(words)))] = rng.choice(bad) if i % 3 else "zorgu" + "".join(rng.choice(list("abcdefgh"), 4))
        out.append((" ".join(words), toxic))
    return out


def test_held_out_and_evidence(spark):
    given = made(1, 700)
    frame = docs(spark, *[t for t, _ in given])
    labels = spark.createDataFrame([(i, y, "x") for i, (_, y) in enumerate(given, 1) if i <= 500], "doc_id long, label int, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame, labels).collect()}
    wrong = sum((got[i]["score"] >= toxicity.TOXIC) != y for i, (_, y) in enumerate(given, 1) if i > 500)
    assert len(got) == 700 and wrong <= 6
    # cosines over the vocabulary, all examples compared
    chosen = toxicity.examples(frame.select("doc_id", "text"), labels.select("doc_id", "label"), toxicity.FIT_DOCS)
    words = toxicity.vocabulary(chosen)
    count = lambda t: Counter(x for w in toxicity.WORD.findall(t.lower()) for x in toxicity.terms(w) if x in words)
    seen = Counter(x for t, _ in given for x in count(t))
    idf = {x: math.log(701 / (1 + seen[x])) + 1 for x in words}
    vector = lambda t: toxicity.unit(count(t), idf)
    kept = {r["doc_id"]: vector(r["text"]) for r in chosen.collect()}
    for i in range(501, 701):
        own = vector(given[i - 1][0])
        want = sorted(-cosine(own, v) for v in kept.values() if cosine(own, v) > 0)[:10]
        assert np.allclose([-e["cosine"] for e in got[i]["evidence"]], want, atol=1e-9)
        assert all(e["label"] == given[e["doc_id"] - 1][1] for e in got[i]["evidence"])


def test_vocabulary_counts(spark):
    """The likelihood ratio of each term against a plain one."""
    given = made(2, 150)
    chosen = docs(spark, *[t for t, _ in given]).drop("label").join(spark.createDataFrame([(i, y) for i, (_, y) in enumerate(given, 1)], "doc_id long, label int"), "doc_id")
    seen = [Counter(x for t, y in given if y == k for x in {x for w in toxicity.WORD.findall(t.lower()) for x in toxicity.terms(w)}) for k in (0, 1)]
    n = [sum(y == k for _, y in given) for k in (0, 1)]

    def ratio(x):
        table = np.array([[seen[k][x], n[k] - seen[k][x]] for k in (0, 1)], float)
        expected = table.sum(0) * table.sum(1, keepdims=True) / table.sum()
        return 2 * sum(o * math.log(o / e) for o, e in zip(table.ravel(), expected.ravel(), strict=True) if o)

    lift = lambda x: seen[1][x] * sum(n) / ((seen[0][x] + seen[1][x]) * n[1])
    want = {x: ratio(x) for x in seen[0] | seen[1] if seen[0][x] + seen[1][x] >= toxicity.LEAST_DOCS and ratio(x) >= toxicity.LEAST_RATIO and not 0.5 < lift(x) < 2}
    want = {x: r for x, r in want.items() if len(x) not in toxicity.STEMS or not any(y != x and y.startswith(x) and want[y] >= r for y in want)}
    assert sorted(toxicity.vocabulary(chosen)) == sorted(want) != []


def test_odd_rows(spark):
    given = [t for t, _ in made(3, 60)] + ["gribble", None, "", LONG + "gribble", "gribble"]
    ids = [*range(1, 61), 61, 62, 63, 64, None]
    frame = docs(spark, *given, ids=ids)
    labels = spark.createDataFrame([(i, y, "x") for i, (_, y) in enumerate(made(3, 60), 1)] + [(None, 1, "x"), (61, None, "x"), (900, 1, "x")], "doc_id long, label int, text string")
    got = rows(toxicity.toxicity(frame.unionByName(frame.filter("doc_id = 61")), labels))
    assert len(got) == 66 and all(0 <= r["score"] <= 1 for r in got) and [r["score"] for r in got if r["doc_id"] == 61][0] == [r["score"] for r in got if r["doc_id"] == 61][1]
    none = rows(toxicity.toxicity(frame, labels.limit(0)))
    assert len(none) == 65 and {r["score"] for r in none} == {0.5}
    one_side = rows(toxicity.toxicity(frame, labels.filter("label = 1")))
    assert len(one_side) == 65
    assert rows(toxicity.toxicity(frame.limit(0), labels)) == []
