"""Hard-negative mining by segment summary filtering.

A vector's segments (runs of coordinates) are stored by their means and deviations, for a few and for more segments. The
product of two segments is their length times the product of the means, give or take that of the deviations; sums over
segments bound a score from both sides. What the coarse bounds leave is bounded by finer segments, and what these leave
is scored exactly. Bounds only spare work: scores are whole numbers, and results are exact.

Anchors (a stated part of the rows) fall into blocks and rows into parts; each block meets each part in a task, which holds
the block and lets the part stream by, keeping the best few of each anchor. A first run finds the anchors' positives, a
second one negatives of other labels within the share of each positive's score.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part, nor do empty vectors; of rows
that share an id one takes part (that with the smallest label, then the smallest vector); vectors of different lengths are
never compared; an anchor without a positive, and a positive without a negative, gives no row; a positive with a negative
score has no negatives; ties go to smaller ids; scores that a long cannot hold raise an error; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import stored, table

ANCHORS, SHIFTED, LABELS, SCALE, FIRST, SHARE = 100, 7, 10, 256, 5, 80
#: Segments of a vector, coarse to fine.
LEVELS = (4, 16)
#: Anchors in a block, rows in a part; anchors and rows that a task scores at once.
BLOCK, PART, ABREAST, STEP = 65_536, 262_144, 2048, 1024


def segments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each of up to n segments, means, deviations)."""
    cuts = np.unique(np.linspace(0, x.shape[1], min(n, x.shape[1]) + 1).astype(int))
    size = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    spread = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, cuts[:-1], axis=1) / size
    return size, mean, np.sqrt(spread)


def summaries(x: np.ndarray) -> np.ndarray:
    """Means and deviations of all levels, each times the root of its segment's length, so that products add up."""
    out = []
    for n in LEVELS:
        size, mean, spread = segments(x, n)
        out += [mean * np.sqrt(size), spread * np.sqrt(size)]
    return np.concatenate(out, 1)


def packed(x: np.ndarray) -> list[bytes]:
    """Whole numbers as 16-bit ones where they fit, else as 64-bit ones."""
    if not (np.abs(x) < 2.0**62).all():
        raise ValueError("components of this size give scores that a long cannot hold")
    small = (np.abs(x) < 1 << 15).all(1)
    return [(r.astype("<i2") if s else r.astype("<i8")).tobytes() for r, s in zip(x, small, strict=True)]


def unpacked(rows: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, "<i2" if len(r) == 2 * dim else "<i8") for r in rows]).astype(np.int64)


def indexed(vectors: DataFrame, shifted: int = SHIFTED, labels: int = LABELS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, dim, whole, summary): the rows that take part, in whole numbers, with their summaries."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size("embedding") > 0)
    usable = vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(good)
    label = F.when(F.col("vec_id") % shifted == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("long")
    one = usable.select("vec_id", F.struct(label.alias("label"), F.col("embedding").cast("array<double>").alias("v")).alias("r")).groupBy("vec_id").agg(F.min("r").alias("r"))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for dim, own in rows.groupby(rows["v"].map(len)):
                for at in range(0, len(own), STEP):
                    part = own.iloc[at : at + STEP]
                    x = np.floor(scale * np.stack(part["v"].to_list()).astype(np.float64))
                    summary = [r.astype("<f4").tobytes() for r in summaries(x)]
                    yield pd.DataFrame({"vec_id": part["vec_id"], "label": part["label"], "dim": dim, "whole": packed(x), "summary": summary})

    return one.select("vec_id", "r.label", "r.v").mapInPandas(summarise, "vec_id long, label long, dim int, whole binary, summary binary")


@dataclass
class Rows:
    """Vectors of a block or step in arrays."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    summary: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame, dim: int) -> Rows:
        x = unpacked(rows["whole"], dim)
        return cls(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), x, np.stack([np.frombuffer(r, "<f4") for r in rows["summary"]]).astype(np.float64))

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = [min(n, self.x.shape[1]) for n in LEVELS]
        at = 2 * sum(sizes[:k])
        return self.summary[:, at : at + sizes[k]], self.summary[:, at + sizes[k] : at + 2 * sizes[k]]


def products(a: np.ndarray, b: np.ndarray, paired: bool = False) -> np.ndarray:
    """Exact inner products of all rows of a and b, or of each pair of rows."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 2.0**63:
        raise ValueError("components of this size give scores that a long cannot hold")
    if most < 2.0**53:
        a, b = a.astype(np.float64), b.astype(np.float64)
    return (np.einsum("ij,ij->i", a, b) if paired else a @ b.T).astype(np.int64)


def candidates(anchors: Rows, rows: Rows, allowed: np.ndarray, least: np.ndarray, most: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the allowed pairs with a score from least to most, both by anchor."""
    # more than the roundings of the summaries can come to
    slack = 1e-6 * float(np.abs(anchors.x).max(initial=1)) * float(np.abs(rows.x).max(initial=1)) * anchors.x.shape[1] + 0.5
    at = None
    for k in range(len(LEVELS)):
        (am, ad), (rm, rd) = anchors.level(k), rows.level(k)
        if at is None:
            middle, reach = am @ rm.T, ad @ rd.T
            keep = allowed & (middle + reach >= least[:, None] - slack)
            if most is not None:
                keep &= middle - reach <= most[:, None] + slack
            at = np.nonzero(keep)
        elif len(at[0]) * 4 < allowed.size:  # where more is left, scoring all is cheaper than gathering pairs
            middle, reach = np.einsum("ij,ij->i", am[at[0]], rm[at[1]]), np.einsum("ij,ij->i", ad[at[0]], rd[at[1]])
            keep = middle + reach >= least[at[0]] - slack
            if most is not None:
                keep &= middle - reach <= most[at[0]] + slack
            at = at[0][keep], at[1][keep]
    i, j = at
    score = products(anchors.x[i], rows.x[j], paired=True) if len(i) * 8 < allowed.size else products(anchors.x, rows.x)[i, j]
    keep = score >= least[i]
    if most is not None:
        keep &= score <= most[i]
    return i[keep], j[keep], score[keep]


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: higher scores first, then smaller ids; in order of groups and rank."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[rank < k]


NONE = np.iinfo(np.int64).min
EMPTY = (np.zeros(0, np.int64),) * 3


class Positives:
    """The best rows of the anchors' own labels."""

    def __init__(self, anchors: Rows, _: list, k: int, share: int):
        self.anchors, self.k = anchors, k
        self.held, self.least = EMPTY, np.full(len(anchors.ids), NONE // 2, np.int64)

    def see(self, rows: Rows) -> None:
        a = self.anchors
        allowed = (a.labels[:, None] == rows.labels) & (a.ids[:, None] != rows.ids)
        i, j, score = candidates(a, rows, allowed, self.least, None)
        group, score, ids = (np.concatenate(p) for p in zip(self.held, (i, score, rows.ids[j]), strict=True))
        chosen = best(group, score, ids, self.k)
        self.held = group[chosen], score[chosen], ids[chosen]
        full = np.bincount(self.held[0], minlength=len(a.ids)) == self.k
        last = np.full(len(a.ids), NONE // 2, np.int64)
        last[self.held[0]] = self.held[1]  # a group's last one is its lowest
        self.least = np.where(full, last, NONE // 2)

    def found(self) -> pd.DataFrame:
        group, score, ids = self.held
        return pd.DataFrame({"anchor_id": self.anchors.ids[group], "positive_id": ids, "score": score, "negative_id": NONE, "negative_score": NONE})


class Negatives:
    """For each positive of the anchors, the best rows of other labels within the share of its score."""

    def __init__(self, anchors: Rows, positives: list, k: int, share: int):
        """positives: for each anchor its (positive id, score)."""
        self.anchors, self.k = anchors, k
        pairs = [(i, p, s) for i, own in enumerate(positives) for p, s in own if s >= 0]
        self.anchor, self.positive, self.score = (np.array(c, np.int64) for c in (zip(*pairs, strict=True) if pairs else EMPTY))
        self.low = -(-share * self.score // 100)
        self.held, self.least = EMPTY, self.low.copy()
        self.order = np.argsort(self.anchor, kind="stable")

    def see(self, rows: Rows) -> None:
        if not len(self.anchor):
            return
        a, n = self.anchors, len(self.anchors.ids)
        least, most = np.full(n, np.iinfo(np.int64).max // 2), np.full(n, NONE // 2, np.int64)
        np.minimum.at(least, self.anchor, self.least)
        np.maximum.at(most, self.anchor, self.score)
        i, j, score = candidates(a, rows, a.labels[:, None] != rows.labels, least, most)
        # each found row is held against the positives of its anchor
        starts, ends = np.searchsorted(self.anchor, i), np.searchsorted(self.anchor, i, "right")
        times = ends - starts
        again = np.repeat(np.arange(len(i)), times)
        pair = np.repeat(starts - np.r_[0, np.cumsum(times)[:-1]] if len(times) else starts, times) + np.arange(len(again))
        keep = (score[again] >= self.least[pair]) & (score[again] <= self.score[pair])
        pair, again = pair[keep], again[keep]
        group, score, ids = (np.concatenate(p) for p in zip(self.held, (pair, score[again], rows.ids[j[again]]), strict=True))
        chosen = best(group, score, ids, self.k)
        self.held = group[chosen], score[chosen], ids[chosen]
        full = np.bincount(self.held[0], minlength=len(self.anchor)) == self.k
        last = self.low.copy()
        last[self.held[0]] = self.held[1]
        self.least = np.where(full, last, self.low)

    def found(self) -> pd.DataFrame:
        pair, score, ids = self.held
        return pd.DataFrame({"anchor_id": self.anchors.ids[self.anchor[pair]], "positive_id": self.positive[pair], "score": self.score[pair], "negative_id": ids, "negative_score": score})


def met(rows: DataFrame, anchors: DataFrame, kind: type, n_rows: int, n_anchors: int, k: int, share: int) -> DataFrame:
    """Each block of anchors with each part of the rows: what the tasks keep. anchors: rows with positives (id, score)."""
    spark = rows.sparkSession
    blocks = max(1, -(-n_anchors // BLOCK))
    parts = max(1, min(-(-n_rows // STEP), max(-(-n_rows // PART), 2 * spark.sparkContext.defaultParallelism // blocks)))
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    none = F.array().cast("array<struct<positive_id: long, score: long>>")
    left = anchors.select(F.explode(numbers(parts)).alias("part"), own("vec_id", blocks).alias("block"), F.lit(0).alias("side"), "vec_id", "label", "dim", "whole", "summary", "positives")
    right = rows.select(own(F.struct("vec_id", F.lit("part")), parts).alias("part"), F.explode(numbers(blocks)).alias("block"), F.lit(1).alias("side"), "vec_id", "label", "dim", "whole", "summary", none.alias("positives"))
    both = left.unionByName(right).repartition(blocks * parts, "part", "block").sortWithinPartitions("part", "block", "dim", "side")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by task and length, anchors first."""
        key, given, states = None, [], []
        for batch in batches:
            for now, own in batch.groupby(["part", "block", "dim"], sort=False):
                if now != key:
                    yield from (s.found() for s in states)
                    key, given, states = now, [], []
                first, rest = own[own["side"] == 0], own[own["side"] == 1]
                if len(first):
                    given.append(first)
                if len(rest) and given:
                    whole, given = pd.concat(given), []
                    for at in range(0, len(whole), ABREAST):
                        part = whole.iloc[at : at + ABREAST]
                        states.append(kind(Rows.of(part, now[2]), [[(p["positive_id"], p["score"]) for p in r] for r in part["positives"]], k, share))
                for at in range(0, len(rest) if states else 0, STEP):
                    step = Rows.of(rest.iloc[at : at + STEP], now[2])
                    for state in states:
                        state.see(step)
        yield from (s.found() for s in states)

    return both.mapInPandas(meet, "anchor_id long, positive_id long, score long, negative_id long, negative_score long")


def mined(vectors: DataFrame, anchors: Column | None = None, k: int = FIRST, share: int = SHARE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors: which rows are anchors."""
    index = stored(indexed(vectors), "index")
    chosen = index.filter(F.col("vec_id") % ANCHORS == 0 if anchors is None else anchors)
    n_rows, n_anchors = index.count(), chosen.count()
    none = F.array().cast("array<struct<positive_id: long, score: long>>")
    found = met(index, chosen.withColumn("positives", none), Positives, n_rows, n_anchors, k, share)
    place = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    top = found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
    positives = top.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "score"))).alias("positives"))
    known = stored(chosen.join(positives, "vec_id"), "positives")
    found = met(index, known, Negatives, n_rows, n_anchors, k, share)
    place = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"))


SQL = f"""
with g as (select vec_id, label, embedding::double[] e from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
u as (select vec_id, (case when vec_id % {SHIFTED} = 0 then (label + 1) % {LABELS} else label end)::bigint label, e from g),
v as materialized (select vec_id, label, list_transform(e, lambda x: floor({SCALE} * x)) x from u qualify row_number() over (partition by vec_id order by u.label, e) = 1),
p as (select a.vec_id a, a.label l, b.vec_id b, b.label = a.label same, list_inner_product(a.x, b.x)::bigint s from v a join v b on a.vec_id % {ANCHORS} = 0 and a.vec_id <> b.vec_id and len(a.x) = len(b.x)),
q as materialized (select * from p),
t as (select a, b, s from q where same qualify row_number() over (partition by a order by s desc, b) <= {FIRST})
select t.a anchor_id, t.b positive_id, (row_number() over (partition by t.a, t.b order by q.s desc, q.b))::int as rank, q.b negative_id, t.s positive_score, q.s negative_score
from t join q on q.a = t.a and not q.same and {SHARE} * t.s <= 100 * q.s and q.s <= t.s qualify rank <= {FIRST}"""
