"""Target-distribution importance resampling over hashed word and word-pair features.

Words are read by an Aho-Corasick automaton: its dictionary holds the distinct words of a few megabytes of text, each
bounded by delimiters at both ends, with the word's CRC, the CRC of the word and a blank, and its length as payload. A
scan emits one payload a word; a pair's CRC is put together from two adjacent payloads (a CRC is linear: the first one is
shifted by the second one's length), so that no pair is ever spelt out. CRCs modulo the number of buckets are the
features. Each text is scanned once; its buckets are kept as 16-bit numbers and both counted and scored from there.

A document's weight is the mean gain of its features (the logarithm of how much likelier a bucket is in the target texts
than in the corpus); Gumbel noise from a hash of its id makes the highest scores a draw without replacement in proportion
to the weights. Ranks are places among equal scores plus the number of higher ones, so no task sees all rows.

Cases: a null or empty text has no words, weight 0, and is never drawn, as it has fewer than the least number of words; a
null doc_id has no score and is neither drawn nor counted; rows that repeat an id are documents of their own (equal ones
get different ranks in no fixed order); words of any length are read (long ones by stand-ins); without target texts all
their counts are 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import bounded_batches, stored, table

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bytes of text that share an automaton; bytes of the longest word that it spells out.
GROUP_BYTES, LONGEST = 4 << 20, 256
#: What a byte of text becomes: small ASCII letters, digits and all beyond ASCII stay, the rest delimits words.
FOLD = bytes(i if i > 127 or chr(i).isdigit() else ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(256))
POLYNOMIAL = 0xEDB88320


def shift_tables() -> np.ndarray:
    """For k in 0..30: what 2^k further bytes make of a CRC, as tables over its four bytes."""

    def spread(images: np.ndarray) -> np.ndarray:
        out = np.zeros((4, 256), np.uint32)
        for part in range(4):
            for bit in range(8):
                out[part, np.arange(256) >> bit & 1 == 1] ^= images[8 * part + bit]
        return out

    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        images = (images >> np.uint32(1)) ^ np.where(images & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    tables = []
    for _ in range(31):
        tables.append(spread(images))
        images = apply(tables[-1], images)
    return np.stack(tables)


def apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0, crc & 255] ^ tables[1, crc >> 8 & 255] ^ tables[2, crc >> 16 & 255] ^ tables[3, crc >> 24]


SHIFTS = shift_tables()


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts put together of a first part and a second one of so many bytes."""
    out = first.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero(length >> k & 1)
        out[on] = apply(SHIFTS[k], out[on])
    return out ^ second


def payloads(texts: list[bytes]) -> list[np.ndarray]:
    """A row for each word of each text (folded bytes): its CRC, its CRC with a blank, its length."""
    import ahocorasick

    long_words: list[bytes] = []

    def stand_in(m: re.Match) -> bytes:
        long_words.append(m[0])
        return b"\x01%d" % (len(long_words) - 1)

    texts = [re.sub(rb"[^ ]{%d,}" % (LONGEST + 1), stand_in, t).decode("latin-1") for t in texts]
    words = list(set(" ".join(texts).split(" ")) - {""})
    if not words:
        return [np.zeros((0, 3), np.uint32) for _ in texts]
    automaton, rows = ahocorasick.Automaton(), np.empty((len(words), 3), np.uint32)
    for i, word in enumerate(words):
        automaton.add_word(f" {word} ", i)
        whole = long_words[int(word[1:])] if word[0] == "\x01" else word.encode("latin-1")
        crc = zlib.crc32(whole)
        rows[i] = crc, zlib.crc32(b" ", crc), len(whole)
    automaton.make_automaton()
    return [rows[np.fromiter(map(itemgetter(1), automaton.iter(f" {t} ")), np.int64)] for t in texts]


def cut(text: bytes, size: int) -> list[bytes]:
    """A folded text in pieces of about `size` bytes, cut between words."""
    out, at = [], 0
    while len(text) - at > size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def buckets(texts: list[bytes | None], n: int = BUCKETS, size: int = GROUP_BYTES) -> list[tuple[int, np.ndarray]]:
    """(words, bucket of each feature) of each text; texts are taken together up to `size` bytes."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    group: list[tuple[int, bytes]] = []

    def scan() -> None:
        for (i, _), rows in zip(group, payloads([t for _, t in group]), strict=True):
            found[i].append(rows)
        group.clear()

    held = 0
    for i, text in enumerate(texts):
        for piece in cut((text or b"").translate(FOLD), size):
            group.append((i, piece))
            held += len(piece)
            if held >= size:
                scan()
                held = 0
    if group:
        scan()
    out = []
    for parts in found:
        crc, blank, length = np.concatenate(parts).T
        pairs = joined(blank[:-1], crc[1:], length[1:].astype(np.int64))
        out.append((len(crc), np.concatenate([crc, pairs]) % np.uint32(n)))
    return out


def features(texts: DataFrame, keep: str | None = None, n: int = BUCKETS) -> DataFrame:
    """(keep, n_words, buckets): each text's features, as 16-bit numbers in a binary column; texts: (keep, text)."""
    if n > 1 << 16:
        raise ValueError("buckets are kept as 16-bit numbers")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = buckets(list(rows["text"]), n)
            yield pd.DataFrame({"id": rows["id"], "n_words": [w for w, _ in found], "buckets": [b.astype("<u2").tobytes() for _, b in found]})

    key = (F.col(keep) if keep else F.lit(None)).cast("string")  # ids as text: pandas would round large ones beside nulls
    given = bounded_batches(texts).select(key.alias("id"), F.col("text").cast("binary").alias("text"))
    out = given.mapInPandas(scan, "id string, n_words long, buckets binary")
    return out.select(F.col("id").cast("long").alias(keep), "n_words", "buckets") if keep else out.drop("id")


def counts(found: DataFrame, n: int = BUCKETS) -> list[int]:
    """How often each bucket occurs; a task sends at most a row for each of the n buckets, and so does the result."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n, np.int64)
        for rows in batches:
            for b in rows["buckets"]:
                total += np.bincount(np.frombuffer(b, "<u2"), minlength=n)
        own = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": own, "n": total[own]})

    out = [0] * n
    for r in found.select("buckets").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    n = float(len(corpus))
    s_all, t_all = float(sum(corpus)), float(sum(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the mean gain, rounded down."""
    sent = found.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            own = [np.frombuffer(b, "<u2") for b in rows["buckets"]]
            weight = [int(sent.value[b].sum()) // len(b) if len(b) else 0 for b in own]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_words": rows["n_words"], "n_features": list(map(len, own)), "weight": weight})

    given = found.select(F.col("doc_id").cast("string").alias("doc_id"), "n_words", "buckets")
    out = given.mapInPandas(weigh, "doc_id string, n_words long, n_features long, weight long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def drawn(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: places among the drawn share of rows with enough words.

    The driver sees how many rows have each score: whole numbers in a range of some ten thousands, whatever the rows.
    """
    spark, able = scored.sparkSession, (F.col("n_words") >= least) & F.col("score").isNotNull()
    found = sorted(((r["score"], r["n"]) for r in scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    places = percent * sum(n for _, n in found) // 100
    above, before = [], 0
    for score, n in found:
        if before >= places:
            break
        above.append((score, before))
        before += n
    none = F.lit(None).cast("long")
    if not above:
        return scored.withColumn("rank", none)
    lowest, top = above[-1][0], F.broadcast(spark.createDataFrame(above, "score long, before long"))
    among = Window.partitionBy("score").orderBy("doc_id")
    chosen = scored.filter(able & (F.col("score") >= lowest)).join(top, "score").withColumn("rank", F.col("before") + F.row_number().over(among))
    chosen = chosen.withColumn("rank", F.when(F.col("rank") <= places, F.col("rank")))
    rest = scored.filter(~F.coalesce(able & (F.col("score") >= lowest), F.lit(False))).withColumn("rank", none)
    return chosen.select(*scored.columns, "rank").unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, n: int = BUCKETS, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every document; target: texts to resemble."""
    found = stored(features(docs, "doc_id", n), "features")
    gain = gains(counts(found, n), counts(features(target, None, n), n))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighted(found, gain).withColumn("score", F.col("weight") + noise), "scored")
    return drawn(scored, percent, least)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _steps() -> list[int]:
    """What four more bits make of a CRC's lowest four."""
    out = list(range(16))
    for _ in range(4):
        out = [c >> 1 ^ (POLYNOMIAL if c & 1 else 0) for c in out]
    return out


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_HALVES = "flatten([[4294967295], flatten(list_transform(range(1, len(x), 2), lambda i: [instr('0123456789ABCDEF', x[i + 1]) - 1, instr('0123456789ABCDEF', x[i]) - 1]))])"
#: CRCs are worked out four bits at a time.
SQL = f"""
with w as (select doc_id, row_number() over () r, {_WORDS} w from documents),
f as materialized (select r, {_RUNS} f from w),
g as materialized (select {_RUNS} f from (select {_WORDS} w from benchmark)),
h as (select f, hex(encode(f)) x from (select f from f union select f from g)),
k as materialized (select f, xor(list_reduce({_HALVES}, lambda c, n: xor(c >> 4, {_steps()}[(xor(c, n) & 15) + 1])), 4294967295) % {BUCKETS} k from h),
s as (select k, count(*) s from f join k using (f) group by k), t as (select k, count(*) t from g join k using (f) group by k),
gain as (select k, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select sum(s) from s) + {BUCKETS})::double / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + {BUCKETS})::double)))::bigint g
  from (select distinct k from k) left join s using (k) left join t using (k)),
m as (select r, floor(sum(g)::double / count(*))::bigint weight from f join k using (f) join gain using (k) group by r),
d as (select doc_id, len(w) n, greatest(2 * len(w) - 1, 0)::bigint n_features, coalesce(weight, 0) weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::bigint + 0.5) / 4294967296)))::bigint score from w left join m using (r)),
o as (select *, coalesce(n >= {LEAST_WORDS} and score is not null, false) able from d),
p as (select *, row_number() over (partition by able order by score desc, doc_id) p, count(*) filter (able) over () c from o)
select doc_id, n_features, weight, score, case when able and p <= {PERCENT} * c // 100 then p end as rank from p"""
