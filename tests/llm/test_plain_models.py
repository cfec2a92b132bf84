"""Language mixtures and the convolutional network against versions that go word by word and place by place."""

import math

import numpy as np

from dossier.llm import language, quality


def plain_words(model, data):
    """Log-likelihoods of each run of letter bytes, byte by byte."""
    code = lambda c: c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else c - 101 if c >= 128 else 0
    b = [0, *(code(c) for c in data), 0]
    out = []
    for i in range(1, len(b) - 1):
        if b[i]:
            if not b[i - 1]:
                out.append([0.0] * len(model.names))
            at = (b[i - 1] * 24029 + b[i] * 155 * 211 + b[i + 1] * 7919) % 2**32 % language.BINS
            for k in range(len(model.names)):
                out[-1][k] += float(model.logs[at, k]) * language.TEMPER
    return out


def plain_mixture(words, allowed):
    share = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(words[0]))]
    for _ in range(language.ROUNDS):
        got = [0.0] * len(share)
        for w in words:
            top = max(w)
            part = [s * math.exp(x - top) for s, x in zip(share, w, strict=True)]
            total = max(sum(part), 1e-30)
            got = [g + p / total for g, p in zip(got, part, strict=True)]
        share = [g / len(words) for g in got]
    fit = sum(max(w) + math.log(max(sum(s * math.exp(x - max(w)) for s, x in zip(share, w, strict=True)), 1e-30)) for w in words)
    return share, fit


def plain_infer(model, text):
    words = plain_words(model, text.encode())
    if not words:
        return []
    n, order = len(words), np.argsort(-np.array(plain_mixture(words, range(len(model.names)))[0]), kind="stable")
    best, kept = -math.inf, []
    for k in range(1, len(model.names) + 1):
        share, fit = plain_mixture(words, set(order[:k].tolist()))
        fit -= k * (0.5 * math.log(n + 1) + language.PENALTY * n)
        if fit > best:
            best, kept = fit, share
    return sorted([(model.names[k], s) for k, s in enumerate(kept) if s > 1e-3], key=lambda x: -x[1])


def test_mixtures_word_by_word(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.learned(docs)
    texts = [r["text"][:700] for r in docs.filter("text is not null").orderBy("doc_id").limit(25).collect()]
    texts += [texts[0] + " " + texts[-1], " ".join(t[:80] for t in texts), "x", "é", "naïve façade", "12 ab 3", ""]
    for text, found in zip(texts, language.infer(model, texts), strict=True):
        want = plain_infer(model, text)
        assert [k for k, _ in found] == [k for k, _ in want] and np.allclose([v for _, v in found], [v for _, v in want], atol=2e-3), text


def plain_score(net, text):
    """The highest response of each filter in each chunk of the text, their mean and maximum, one weighted sum."""
    data = text.encode()
    n = max(1, math.ceil(max(0, len(data) - quality.HOP) / quality.HOP))
    tops = []
    for c in range(n):
        chunk = [data[i] if i < len(data) else quality.PAD for i in range(c * quality.HOP, c * quality.HOP + quality.CHUNK)]
        row = []
        for f in range(quality.FILTERS):
            places = range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)
            row.append(math.tanh(max(sum(float(net.embed[chunk[p + k], e]) * float(net.filters[k * quality.EMBED + e, f]) for k in range(quality.WIDTH) for e in range(quality.EMBED)) for p in places) + float(net.bias[f])))
        tops.append(row)
    x = [sum(r[f] for r in tops) / n for f in range(quality.FILTERS)] + [max(r[f] for r in tops) for f in range(quality.FILTERS)]
    return 1 / (1 + math.exp(-(sum(a * float(w) for a, w in zip(x, net.out, strict=True)) + float(net.base[0]))))


def test_network_place_by_place(monkeypatch):
    for name, size in (("CHUNK", 32), ("HOP", 16), ("FILTERS", 5), ("EMBED", 3)):
        monkeypatch.setattr(quality, name, size)
    rng = np.random.default_rng(5)
    net = quality.Network.fresh(rng)
    net.bias[:] = rng.normal(size=5)
    net.base[:] = 0.3
    texts = ["", "a", "short one", "x" * 32, "y" * 33, "Größe " * 9, "".join(map(chr, rng.integers(32, 900, 150)))]
    want = [plain_score(net, t) for t in texts]
    for size in (1, 3, 1024):
        assert np.allclose(quality.scores(net, texts, size), want, atol=1e-5)
