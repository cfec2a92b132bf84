"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and beginnings of words. The vocabulary holds the terms that the examples' labels depend on most (by the
likelihood ratio of their counts, and by a share that differs enough); a text of other terms has an empty vector. Inverse document frequencies are counted
over all documents. Examples are a bounded sample of labelled rows, near copies among them (by the least hash of three words) standing for each other.

The index keeps, for each term and block of examples, the largest weight in the block. Its products with a text's weights
bound what any example of a block can reach; blocks are opened from the highest bound down until none can hold one of the
nearest. The nearest vote, the closer the more; what votes mean is fitted on the examples themselves, each without its
own vote, and gives the score. The nearest examples and their cosines are returned as evidence.

Cases: null and empty texts, and texts without a term of the vocabulary, get the share of toxic ones among such examples
and no evidence; rows without a label or with a null id teach nothing; without any labelled row all scores are 0.5; a null
doc_id stays null; repeated rows get equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, broadcast_up_to, stored, table
from dossier.llm.language import fold

#: Labelled documents drawn as examples, at most about (by a hash of the id); terms of the vocabulary, at most.
FIT_DOCS, TERMS = 10_000, 1024
#: For the vocabulary: least examples with a term, least likelihood ratio (chi-square with one degree of freedom), and how many
#: times more or less often than in all examples a label must be met among those with the term.
LEAST_DOCS, LEAST_RATIO, LEAST_LIFT = 4, 20.0, 2.0
#: Beginnings of words that are terms, in code points; examples that vote; examples in a block.
STEMS, NEAREST, BLOCK = range(3, 9), 10, 64
TOXIC = 0.7
WORD = re.compile(r"[^\W\d_]+")
#: Words whose terms, and vectors whose nearest, a task remembers; documents that a task scores.
REMEMBERED, SCORED = 500_000, 20_000


def terms(word: str) -> list[str]:
    """The word itself, marked by a blank, and its beginnings."""
    return [f"{word} ", *(word[:k] for k in STEMS if k <= len(word))]


@dataclass
class Vocabulary:
    ids: dict[str, int]

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> dict[int, int]:
        """How often each term of the vocabulary occurs."""
        out: dict[int, int] = {}
        known = self.known
        for word, n in Counter(WORD.findall((text or "").lower())).items():
            own = known.get(word)
            if own is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                own = known[word] = tuple(self.ids[t] for t in terms(word) if t in self.ids)
            for i in own:
                out[i] = out.get(i, 0) + n
        return out


class Index:
    """Examples' unit vectors by term, in blocks of equal numbers of examples; rows x terms is bounded, so postings are dense."""

    def __init__(self, rows: list[tuple[int, int, dict[int, float]]], n_terms: int, block: int = BLOCK):
        """rows: (id, label, unit vector); like ones come into the same blocks."""
        rows = sorted((r for r in rows if r[2]), key=lambda r: (max(r[2], key=lambda t: (r[2][t], t)), r[0]))
        self.n, self.n_blocks = len(rows), -(-len(rows) // block)
        self.ids, self.labels = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        weights = np.zeros((n_terms, self.n_blocks * block))
        for i, (_, _, vector) in enumerate(rows):
            weights[list(vector), i] = list(vector.values())
        self.weights = weights.reshape(n_terms, self.n_blocks, block)
        self.top = self.weights.max(2, initial=0.0)

    def opened(self, own: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, place) of the examples of some blocks, without those of cosine 0."""
        block = self.weights.shape[2]
        held = np.round(np.tensordot(weights, self.weights[own[:, None], blocks], 1), 12).ravel()
        at = np.flatnonzero(held > 0)
        return held[at], (blocks[:, None] * block + np.arange(block)).ravel()[at]

    def nearest(self, vector: dict[int, float], k: int = NEAREST, without: int | None = None) -> list[tuple[float, int]]:
        """(cosine, place) of the k nearest, ties by id; cosines of 0 are left out. Cosines are rounded to 12 places."""
        own, weights = np.array(list(vector), np.int64), np.array(list(vector.values()))
        if not len(own) or not self.n:
            return []
        bound = weights @ self.top[own] + 1e-9
        order = np.argsort(-bound, kind="stable")
        score, place, least, at, step = np.zeros(0), np.zeros(0, np.int64), 0.0, 0, 1
        while at < self.n_blocks and bound[order[at]] >= max(least, 2e-9):
            blocks = order[at : at + step]
            more = self.opened(own, weights, blocks[bound[blocks] >= max(least, 2e-9)])
            score, place = np.concatenate([score, more[0]]), np.concatenate([place, more[1]])
            if without is not None:
                score, place = score[self.ids[place] != without], place[self.ids[place] != without]
            best = np.lexsort((self.ids[place], -score))[:k]
            score, place = score[best], place[best]
            least = score[-1] if len(score) == k else 0.0
            at, step = at + step, 4 * step  # few blocks first, to know what the others must reach
        return list(zip(score.tolist(), place.tolist(), strict=True))


@dataclass
class Model:
    idf: np.ndarray
    index: Index
    empty: float  # the score of a text without terms
    scale: tuple[float, float]  # of the votes' logarithmic odds

    def vector(self, found: list[dict]) -> dict[int, float]:
        return unit({t["term"]: t["n"] for t in found}, self.idf)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Logarithmic odds of the votes, each weighing the more the smaller its distance, beside one vote of either side."""
        own = [(s * s, self.index.labels[i]) for s, i in near]
        return math.log((1 + sum(w for w, y in own if y)) / (1 + sum(w for w, y in own if not y)))

    def score(self, near: list[tuple[float, int]]) -> float:
        a, b = self.scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * self.vote(near) + b)))) if near else self.empty


def unit(counts: dict[int, int], idf: np.ndarray) -> dict[int, float]:
    own = {t: (1 + math.log(n)) * idf[t] for t, n in sorted(counts.items())}
    length = math.sqrt(sum(w * w for w in own.values()))
    return {t: float(w / length) for t, w in own.items()}


def signature(text: str | None) -> int:
    """The least hash of the text's runs of three words: near copies mostly have the same."""
    words = WORD.findall((text or "").lower())
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def examples(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, label, text) of the drawn labelled documents; of near copies one stays."""
    place = F.pmod(F.xxhash64(F.lit("examples"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    n = labels.count()
    drawn = docs.join(broadcast_up_to(labels.filter(place < F.lit(rows / max(n, 1))), 2 * rows), "doc_id")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.assign(sign=[signature(t) for t in part["text"]])

    signed = bounded_batches(drawn).select("doc_id", "label", "text").mapInPandas(sign, "doc_id long, label int, text string, sign long")
    one = F.min_by(F.struct("doc_id", "label", "text"), F.struct("doc_id", "label"))
    return signed.groupBy("sign", "label").agg(one.alias("r")).select("r.*")


def vocabulary(chosen: DataFrame, most: int = TERMS) -> list[str]:
    """The terms that the labels depend on most; counts are summed in the tasks first. A beginning counts only where no longer
    term that begins so does as well."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counter()
        for rows in batches:
            for text, label in zip(rows["text"], rows["label"], strict=True):
                own = {t for w in set(WORD.findall((text or "").lower())) for t in terms(w)}
                n.update((t, label) for t in own)
            if len(n) > REMEMBERED:
                yield pd.DataFrame([(t, y, c) for (t, y), c in n.items()], columns=["term", "label", "n"])
                n.clear()
        yield pd.DataFrame([(t, y, c) for (t, y), c in n.items()], columns=["term", "label", "n"]).astype({"label": "int64", "n": "int64"})

    sizes = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    with_one, without = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    counted = chosen.select("text", "label").mapInPandas(count, "term string, label int, n long").groupBy("term")
    counted = counted.agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    a, b, n = F.col("a"), F.col("b"), with_one + without
    share, rest = (a + b) / n, (n - a - b) / n
    ratio = 2 * (part(a, share * with_one) + part(b, share * without) + part(with_one - a, rest * with_one) + part(without - b, rest * without))
    lift = F.greatest(a * n, F.lit(0.5)) / ((a + b) * F.lit(max(with_one, 1.0)))
    telling = (a + b >= LEAST_DOCS) & ((lift >= LEAST_LIFT) | (lift <= 1 / LEAST_LIFT))
    best = counted.filter(telling).select("term", ratio.alias("ratio")).filter(F.col("ratio") >= LEAST_RATIO)
    found = {r["term"]: r["ratio"] for r in best.orderBy(F.desc("ratio"), "term").limit(8 * most).collect()}
    beaten: set[str] = set()
    for term, own in found.items():
        beaten.update(start for k in STEMS if k < len(term) and (start := term[:k]) in found and found[start] <= own)
    return [t for t in found if t not in beaten][:most]


def term_counts(texts: DataFrame, words: list[str], *keep: str) -> DataFrame:
    """keep, terms (array of term and count) of each text; only terms of the vocabulary."""
    sent = texts.sparkSession.sparkContext.broadcast(Vocabulary({t: i for i, t in enumerate(words)}))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [sent.value.counts(t) for t in rows["text"]]
            yield rows[list(keep)].assign(terms=[[{"term": t, "n": n} for t, n in f.items()] for f in found])

    kinds = ", ".join(f"{c} string" for c in keep)
    given = bounded_batches(texts).select(*[F.col(c).cast("string").alias(c) for c in keep], "text")
    return given.mapInPandas(count, f"{kinds}, terms array<struct<term: int, n: int>>")


def fitted(counts: DataFrame, chosen: DataFrame, words: list[str]) -> Model | None:
    """The model of the examples' terms; counts: the terms of all documents, for their frequencies."""
    spark = chosen.sparkSession
    own = stored(term_counts(chosen, words, "doc_id", "label"), "example-terms")
    found = [(int(r["doc_id"]), int(r["label"]), {t["term"]: t["n"] for t in r["terms"]}) for r in own.collect()]
    if not found:
        return None
    seen = np.zeros(len(words))
    for r in counts.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
        seen[r["term"]] = r["n"]
    idf = np.log((1 + counts.count()) / (1 + seen)) + 1
    index = Index([(i, y, unit(c, idf)) for i, y, c in found], len(words))
    bare = [y for _, y, c in found if not c]
    rate = sum(y for _, y, _ in found) / len(found)
    model = Model(idf, index, (sum(bare) + rate) / (len(bare) + 1), (1.0, 0.0))
    sent = spark.sparkContext.broadcast(model)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for rows in batches:
            near = [model.index.nearest(model.vector(t), without=int(i)) for i, t in zip(rows["doc_id"], rows["terms"], strict=True)]
            yield pd.DataFrame({"label": rows["label"].astype(int), "vote": [model.vote(n) for n in near]})

    votes = own.filter("size(terms) > 0").repartition(spark.sparkContext.defaultParallelism).mapInPandas(vote, "label int, vote double").collect()
    if votes:
        model.scale = calibrated([(r["vote"], r["label"]) for r in sorted(votes)])
    return model


def calibrated(votes: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the votes, by Newton steps; targets are drawn in from 0 and 1."""
    x, y = np.array([v for v, _ in votes]), np.array([y for _, y in votes], float)
    ones = y.sum()
    y = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    design, at = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * (at - [1.0, 0.0]))
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(at[0]), 0.0), float(at[1])


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_DOCS, most: int = TERMS) -> DataFrame:
    """doc_id, score, evidence (the nearest examples, their labels and cosines) for every document.

    docs: (doc_id, text); labels: (doc_id, label). A document that is an example is among its own nearest.
    """
    docs = docs.select("doc_id", "text")
    known = labels.filter("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    chosen = stored(examples(docs, known, rows), "examples")
    words = vocabulary(chosen, most)
    counts = stored(term_counts(docs, words, "doc_id"), "terms")
    sent = docs.sparkSession.sparkContext.broadcast(fitted(counts, chosen, words))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        known: dict[tuple, list[tuple[float, int]]] = {}
        for part in batches:
            score, evidence = [], []
            for own in part["terms"]:
                key = tuple(sorted((t["term"], t["n"]) for t in own))
                near = known.get(key)
                if near is None:
                    if len(known) >= SCORED:
                        known.clear()
                    near = known[key] = model.index.nearest(model.vector(own)) if model is not None and key else []
                score.append(0.5 if model is None else model.score(near))
                evidence.append([{"doc_id": int(model.index.ids[i]), "label": int(model.index.labels[i]), "cosine": s} for s, i in near])
            yield pd.DataFrame({"doc_id": part["doc_id"], "score": score, "evidence": evidence})

    out = counts.repartition(max(1, counts.count() // SCORED)).mapInPandas(predict, "doc_id string, score double, evidence array<struct<doc_id: long, label: int, cosine: double>>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = toxicity(docs, labels.filter(fold(3) != 1).select("doc_id", F.col("toxic").alias("label")))
    held_out = F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")
