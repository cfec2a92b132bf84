"""Hard negatives against all pairs, with bounds, blocks and parts of any size, and odd rows."""

import math

import numpy as np
import pytest

from dossier.llm import hard_negatives as hn

KINDS = "vec_id long, embedding array<double>, label int, score string, part string"


def frame(spark, given):
    return spark.createDataFrame([(i, v, y, "s", "p") for i, v, y in given], KINDS)


def brute(given, k=5, share=80):
    rows = {}
    for i, v, y in given:
        if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v):
            own = ((y + 1) % 10 if i % 7 == 0 else y, v)
            rows[i] = min(rows.get(i, own), own)
    rows = {i: (y, [math.floor(256 * c) for c in v]) for i, (y, v) in rows.items()}
    out = []
    for a in (i for i in rows if i % 100 == 0):
        y, x = rows[a]
        s = {i: sum(p * q for p, q in zip(x, v, strict=True)) for i, (_, v) in rows.items() if i != a and len(v) == len(x)}
        for p in sorted((i for i in s if rows[i][0] == y), key=lambda i: (-s[i], i))[:k]:
            fit = [i for i in s if rows[i][0] != y and share * s[p] <= 100 * s[i] <= 100 * s[p]]
            out += [(a, p, r, i, s[p], s[i]) for r, i in enumerate(sorted(fit, key=lambda i: (-s[i], i))[:k], 1)]
    return sorted(out)


def mined(spark, given):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in hn.mined(frame(spark, given)).collect())


def vectors(seed, n, dim, coarse=False):
    """Some in tight groups, so that bounds prune; coarse: many ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) + 2 * rng.normal(size=(6, 1))
    x = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, dim))
    x = np.round(x) / 8 if coarse else x
    return [(int(i) * 5, [float(c) for c in v], int(rng.integers(0, 3))) for i, v in enumerate(x)]


@pytest.mark.parametrize("dim, coarse", [(64, False), (5, True), (1, True), (30, False)])
def test_against_brute_force(spark, monkeypatch, dim, coarse):
    given = vectors(dim, 700, dim, coarse)
    want = brute(given)
    assert mined(spark, given) == want and want
    for name, size in (("BLOCK", 10), ("PART", 90), ("ABREAST", 3), ("STEP", 40)):
        monkeypatch.setattr(hn, name, size)
    assert mined(spark, given) == want


def test_bounds_hold_and_prune():
    given = vectors(9, 1200, 64)
    x = np.floor(256 * np.array([v for _, v, _ in given]))
    rows = hn.Rows(np.arange(len(x)), np.zeros(len(x), int), x.astype(np.int64), hn.summaries(x))
    scores = hn.products(rows.x, rows.x)
    left = []
    for k in range(len(hn.LEVELS)):
        mean, spread = rows.level(k)
        middle, reach = mean @ mean.T, spread @ spread.T
        assert (middle + reach >= scores - 1e-3).all() and (middle - reach <= scores + 1e-3).all()
        left.append((middle + reach >= np.quantile(scores, 0.99)).mean())
    assert left[1] <= left[0] < 0.5


def test_odd_rows(spark):
    given = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [9.0, 9.0], 2), (100, None, 1), (200, [], 1), (300, [1.0, None], 1), (400, [float("nan"), 1.0], 1), (500, [float("inf"), 1.0], 1),
        (600, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [0.99, 0.5], 2), (3, [0.99, 0.5], 2), (4, [1.0, 0.5, 3.0], 2), (7, [1.0, 0.5], 1), (800, [0.0, 0.0], 3),
        (5, [-1.0, 2.0], 3), (900, [-1.0, -1.0], 4), (6, [1.0, 1.0], 4), (1000, [3.0], 5),
    ]
    want = brute(given)
    assert mined(spark, given) == want and {r[0] for r in want} == {0, 800}
    assert mined(spark, []) == []
    large = [(0, [2.0**18, 1.0], 1), (1, [2.0**17, 3.0], 2), (2, [2.0**17 - 1, 5.0], 1), (3, [2.0**16, 5.0], 1)]
    assert mined(spark, large) == brute(large) != []
    with pytest.raises(Exception, match="a long cannot hold"):
        mined(spark, [(0, [2.0**30, 1.0], 1), (1, [2.0**30, 1.0], 2)])
