"""Language identification by mixture inference.

Each language has a distribution over hashed byte trigrams (letters lower-cased, all else one blank),
learned from labelled rows. A document is a mixture: every word was drawn from one language, with
the document's proportions, which expectation-maximisation estimates from the words' n-gram
likelihoods. It is run for the likeliest one, two, ... languages, until the penalty for another one
rules out any gain; the set with the highest likelihood, less a penalty for each language, is kept,
and its largest share is the prediction.

Cases: a null text or one without a letter is `und`, score 0, no languages; rows with a null label
teach nothing; without any labelled row all is `und`; a null doc_id stays null; repeated rows get
equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, table

BINS = 1 << 16
#: Labelled documents of each language that are read for its n-grams, about (drawn by a hash of the id).
FIT_DOCS = 4000
ROUNDS = 8
#: A language is worth its place if the mean log-likelihood of a word rises by PENALTY, besides half a log of the words.
PENALTY = 0.02
#: Overlapping trigrams repeat evidence: a word's log-likelihood counts by this factor.
TEMPER = 0.5
LETTER = re.compile(r"[^\W\d_]")

_BYTES = np.zeros(256, np.uint32)
_BYTES[ord("a") : ord("z") + 1] = _BYTES[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_BYTES[128:] = np.arange(27, 155)


#: Bytes of a text and words of all texts that are at work at once.
BYTES_AT_ONCE, WORDS_AT_ONCE = 1 << 20, 1 << 18


def trigrams(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """In pieces of the text: (bin of the trigram around each letter byte, index of each word's first letter in
    that list, whether the first letters go on with the last word of the piece before)."""
    padded = b" " + data + b" "
    for at in range(0, len(data), BYTES_AT_ONCE):
        b = _BYTES[np.frombuffer(padded[at : at + BYTES_AT_ONCE + 2], np.uint8)]
        mid = np.flatnonzero(b[1:-1]) + 1
        code = (b[mid - 1] * np.uint32(24029) + b[mid] * np.uint32(155) * np.uint32(211) + b[mid + 1] * np.uint32(7919)) % np.uint32(BINS)
        yield code, np.flatnonzero(b[mid - 1] == 0), bool(at and b[0] and b[1])


@dataclass
class LanguageModel:
    names: list[str]
    logs: np.ndarray  # BINS x languages, float32

    def words(self, data: bytes) -> np.ndarray:
        """Log-likelihood of each word under each language, words x languages."""
        out = []
        for code, first, goes_on in trigrams(data):
            if goes_on:
                rest = first[0] if len(first) else len(code)
                out[-1][-1] += self.logs[code[:rest]].sum(0) * np.float32(TEMPER)
            if len(first):
                out.append(np.add.reduceat(self.logs[code], first, axis=0) * np.float32(TEMPER))
        return np.concatenate(out) if out else np.zeros((0, len(self.names)), np.float32)


def runs(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters, which bound the arrays at work."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def fit(labelled: DataFrame, per_language: int = FIT_DOCS) -> LanguageModel:
    """labelled: (doc_id, text, lang). Counts are summed in the tasks and then by (language, bin) pairs."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros((BINS, 0), np.float32))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sizes.items()])
    drawn = labelled.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for rows in batches:
            for lang, text in zip(rows["lang"], rows["text"], strict=True):
                for code, _, _ in trigrams((text or "").encode()):
                    total[lang] = total.get(lang, 0) + np.bincount(code, minlength=BINS)
        for lang, got in total.items():
            at = np.flatnonzero(got)
            yield pd.DataFrame({"lang": lang, "bin": at, "n": got[at]})

    counts = bounded_batches(drawn).mapInPandas(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most languages x BINS rows
    grid = np.full((BINS, len(names)), 0.2)
    grid[counts["bin"], counts["lang"].map(names.index).astype(int)] += counts["n"]
    return LanguageModel(names, np.log(grid / grid.sum(0)).astype(np.float32))


def mixture(logs: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: (shares, log-likelihood a document).

    logs: words x languages; starts: each document's first word; allowed: documents x languages.
    """
    n = np.diff(np.append(starts, len(logs)))
    share = (allowed / allowed.sum(1, keepdims=True)).astype(np.float32)
    fit = np.zeros(len(starts))
    blocks = []
    for a in range(0, len(logs), WORDS_AT_ONCE):
        b = min(a + WORDS_AT_ONCE, len(logs))
        first, last = np.searchsorted(starts, [a, b - 1], "right") - 1
        begin = np.maximum(starts[first : last + 1], a) - a
        blocks.append((a, b, first, last + 1, begin, np.repeat(np.arange(first, last + 1), np.diff(np.append(begin, b - a)))))
    top = logs.max(1, keepdims=True)
    held = {0: np.exp(logs - top)} if len(blocks) == 1 else {}
    like = lambda a, b: held[a] if a in held else np.exp(logs[a:b] - top[a:b])
    for _ in range(rounds):
        got = np.zeros_like(share)
        for a, b, first, end, begin, which in blocks:
            part = like(a, b) * share[which]
            part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
            got[first:end] += np.add.reduceat(part, begin, axis=0)
        share = (got / n[:, None]).astype(np.float32)
    for a, b, first, end, begin, which in blocks:
        best = np.log(np.maximum((like(a, b) * share[which]).sum(1), 1e-30)) + top[a:b, 0]
        fit[first:end] += np.add.reduceat(best.astype(np.float64), begin)
    return share, fit


def infer(model: LanguageModel, texts: list[str]) -> list[list[tuple[str, float]]]:
    """For each text the chosen languages and their shares, largest first."""
    docs = [model.words(t.encode()) for t in texts]
    out: list[list[tuple[str, float]]] = [[] for _ in texts]
    live = [i for i, w in enumerate(docs) if len(w)]
    if not live or not model.names:
        return out
    logs = np.concatenate([docs[i] for i in live])
    n = np.array([len(docs[i]) for i in live])
    starts = np.cumsum(n) - n
    full, _ = mixture(logs, starts, np.ones((len(live), len(model.names))))
    order = np.argsort(-full, axis=1, kind="stable")
    best, shares = np.full(len(live), -np.inf), np.zeros_like(full)
    #: No mixture is likelier than every word under its own best language (a little more for rounding).
    ceiling = np.add.reduceat(logs.max(1).astype(np.float64), starts) + 1e-4 * n
    for k in range(1, len(model.names) + 1):
        price = k * (0.5 * np.log(n + 1) + PENALTY * n)
        at = np.flatnonzero(ceiling - price > best)
        if not len(at):
            break
        allowed = np.zeros((len(at), len(model.names)))
        np.put_along_axis(allowed, order[at, :k], 1, 1)
        own = np.isin(np.arange(len(live)), at)
        share, fit = mixture(logs[np.repeat(own, n)], np.cumsum(n[at]) - n[at], allowed)
        fit -= price[at]
        better = fit > best[at]
        best[at[better]], shares[at[better]] = fit[better], share[better]
    for i, row in zip(live, shares, strict=True):
        out[i] = [(model.names[j], float(row[j])) for j in np.argsort(-row, kind="stable") if row[j] > 1e-3]
    return out


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score (the predicted language's share) and languages ("en:0.91,fr:0.09")."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for column in batches:
            texts = [t if t and LETTER.search(t) else "" for t in column]
            found = [x for a, b in runs(texts) for x in infer(model, texts[a:b])]
            yield pd.DataFrame({
                "lang_pred": [f[0][0] if f else "und" for f in found],
                "score": [min(1.0, f[0][1]) if f else 0.0 for f in found],
                "languages": [",".join(f"{k}:{v:.2f}" for k, v in f) for f in found],
            })

    #: Told to be nondeterministic, it is not evaluated once more for a filter on its result.
    found = F.pandas_udf(predict, "lang_pred string, score double, languages string").asNondeterministic()(F.col("text"))
    return bounded_batches(docs).withColumn("_found", found).select(*docs.columns, "_found.*")


def fold(n: int):
    """crc32 of the id as text, modulo n; a null id has none and is never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def learned(docs: DataFrame) -> LanguageModel:
    return fit(docs.filter((fold(5) != 0) & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    return with_language(docs.select("doc_id", "text"), learned(docs)).select("doc_id", held_out, "lang_pred", "score", "languages")
