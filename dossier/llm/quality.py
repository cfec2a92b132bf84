"""Quality classifier: a small convolutional network over bytes, in numpy.

A text's bytes fall into chunks of CHUNK bytes that overlap by half and cover all of it. Learned
filters run over each chunk; a filter's highest response in a chunk is kept (max-pooling). The mean
and the maximum of these over all chunks, weighted and summed, give one probability. Texts of any
length are read whole; memory is bounded by working through runs of chunks.

Cases: a null or empty text is one chunk of padding and gets a score; rows without a label or with
a null id teach nothing; without any labelled row all scores are 0.5; a null doc_id stays null;
repeated rows get equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, broadcast_up_to, table
from dossier.llm.language import fold

CHUNK, HOP, WIDTH, STRIDE = 256, 128, 12, 2
EMBED, FILTERS = 8, 24
#: Labelled documents the network is fitted on, at most about (drawn by a hash of the id), and of their text in all.
FIT_DOCS, FIT_BYTES = 3000, 12 << 20
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.004, 11
PAD = 256


@dataclass
class Network:
    embed: np.ndarray  # 257 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    base: np.ndarray  # 1

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        embed[PAD] = 0
        filters = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        return cls(embed, filters, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.base]


def chunks(data: bytes) -> np.ndarray:
    """The text's overlapping chunks as rows of byte codes, the last one padded."""
    n = max(1, -(-max(0, len(data) - HOP) // HOP))
    codes = np.full((n + 1) * HOP, PAD, np.int16)
    codes[: len(data)] = np.frombuffer(data, np.uint8)
    return sliding_window_view(codes, CHUNK)[::HOP]


def pooled(net: Network, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(highest response of each filter in each chunk, and at which place); chunks x FILTERS."""
    e = net.embed[rows]  # chunks x CHUNK x EMBED
    view = sliding_window_view(e, WIDTH, axis=1)[:, ::STRIDE]  # chunks x places x EMBED x WIDTH
    flat = view.transpose(0, 1, 3, 2).reshape(-1, WIDTH * EMBED)
    r = (flat @ net.filters).reshape(len(rows), -1, FILTERS)
    at = r.argmax(1)
    top = np.take_along_axis(r, at[:, None], 1)[:, 0]
    return np.tanh(top + net.bias), at


def features(top: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.concatenate([np.add.reduceat(top, starts) / n[:, None], np.maximum.reduceat(top, starts)], 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def step(net: Network, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted logistic loss; they flow through the pooled places only."""
    n = np.array(list(map(len, docs)))
    starts, rows = np.cumsum(n) - n, np.concatenate(docs)
    which = np.repeat(np.arange(len(docs)), n)
    top, at = pooled(net, rows)
    x = features(top, starts, n)
    err = (sigmoid(x @ net.out + net.base) - y) * weight / len(docs)
    d_out, d_x = x.T @ err, err[:, None] * net.out
    leads = (top == x[which, FILTERS:]).astype(np.float64)
    leads /= np.add.reduceat(leads, starts)[which]  # equal chunks share what the maximum gets
    d_top = d_x[which, :FILTERS] / n[which][:, None] + leads * d_x[which, FILTERS:]
    d_top *= 1 - top**2
    d_filters, d_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    grid = at[:, :, None] * STRIDE + np.arange(WIDTH)  # chunks x FILTERS x WIDTH
    codes = rows[np.arange(len(rows))[:, None, None], grid]
    for f in range(FILTERS):
        e = net.embed[codes[:, f]].reshape(len(rows), -1)
        d_filters[:, f] = e.T @ d_top[:, f]
        back = (d_top[:, f, None] * net.filters[:, f]).reshape(-1, EMBED)
        flat = codes[:, f].ravel()
        for k in range(EMBED):
            d_embed[:, k] += np.bincount(flat, back[:, k], minlength=257)
    d_embed[PAD] = 0
    return [d_embed, d_filters, d_top.sum(0), d_out, err.sum(keepdims=True)]


def train(texts: list[str], labels: list[int]) -> Network | None:
    """Adam over shuffled batches; both labels weigh the same in all."""
    if not texts:
        return None
    rng = np.random.default_rng(SEED)
    net, docs, y = Network.fresh(rng), [chunks((t or "").encode()) for t in texts], np.array(labels, np.float32)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype(np.float32)
    first, second = ([np.zeros_like(p) for p in net.params()] for _ in range(2))
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for i in range(0, len(docs), BATCH):
            own = order[i : i + BATCH]
            t += 1
            for p, g, a, b in zip(net.params(), step(net, [docs[j] for j in own], y[own], weight[own]), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def scores(net: Network, texts: list[str], size: int = 1024) -> np.ndarray:
    """One probability a text, worked through in runs of `size` chunks."""
    sums, tops, n = np.zeros((len(texts), FILTERS)), np.full((len(texts), FILTERS), -1.0), np.zeros(len(texts))

    def flush(part: list[tuple[int, np.ndarray]]) -> None:
        lens = np.array([len(c) for _, c in part])
        starts = np.cumsum(lens) - lens
        top, _ = pooled(net, np.concatenate([c for _, c in part]))
        who = np.array([i for i, _ in part])
        np.add.at(sums, who, np.add.reduceat(top, starts))
        np.maximum.at(tops, who, np.maximum.reduceat(top, starts))
        np.add.at(n, who, lens)

    part, held = [], 0
    for i, text in enumerate(texts):
        whole = chunks(text.encode())
        for a in range(0, len(whole), size):
            part.append((i, whole[a : a + size]))
            held += len(part[-1][1])
            if held >= size:
                flush(part)
                part, held = [], 0
    if part:
        flush(part)
    return sigmoid(np.concatenate([sums / np.maximum(n, 1)[:, None], tops], 1) @ net.out + net.base)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_DOCS, size: int = FIT_BYTES) -> Network | None:
    """docs: (doc_id, text); labels: (doc_id, label). A sample bounded in rows and bytes is fitted in the driver.

    The labels are drawn before the join, so that only a bounded number of ids is sent to the texts.
    """
    place = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    n = labels.count()
    drawn = docs.join(broadcast_up_to(labels.filter(place < F.lit(rows / max(n, 1))), 2 * rows), "doc_id")
    total = drawn.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    share = min(1.0, rows / max(n, 1)) * min(1.0, size / max(total, 1))
    found = drawn.filter(place < F.lit(share)).select("doc_id", "text", "label").orderBy("doc_id").collect()
    return train([r["text"] or "" for r in found], [r["label"] for r in found])


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = sent.value
        for rows in batches:
            s = np.full(len(rows), 0.5) if net is None else scores(net, [t or "" for t in rows["text"]])
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": s, "predicted": (s >= 0.5).astype(int)})

    return bounded_batches(docs).select("doc_id", "text").mapInPandas(predict, "doc_id long, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    known = labels.filter((fold(3) != 1) & F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    net = fit(docs, known)
    return score(docs, net).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
