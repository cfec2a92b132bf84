"""Embedding near-duplicates by spherical-cap filters from random product codes.

A filter is a direction put together from one code word for each block of (rotated) coordinates; a
vector is in a filter if its product with the direction reaches a threshold. All such directions of
a vector are listed by walking the blocks with a bound on what the rest can add. A few independent
codes are used; their sizes and thresholds follow from the number of vectors: a filter holds about
BUCKET unrelated vectors, and a vector lies in about FILTERS filters.

Vectors that share a filter are compared by 8-bit roundings; what may link (or, in a filter with very
many vectors, all of it) is tied together, and the tied clusters are verified exactly, block by
block: each pair of a cluster is compared once, a task returns the number of links of each vector and
a spanning forest, never all pairs. Equal vectors are one class throughout.

Cases: null vectors, null or non-finite components and zero vectors link with nothing; vectors of
different lengths are never linked; a null vec_id keeps its row (component null, not kept) and links
nothing; rows that share an id and a vector count once; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import forest, stored, table
from dossier.operators.components import connected_components

COSINE = 0.95
CODES, BUCKET, FILTERS, WORDS, SEED = 8, 16, 32, 256, 5
#: Vectors that a part of a cluster holds in verification, and at most in a very large one.
BLOCK, WIDEST = 192, 2048
#: Filters with more vectors (a dense cone: chance puts about BUCKET there) are tied whole, since such a cone shares very many
#: filters and is verified exactly once in any case; how far 8-bit roundings may put a cosine off.
HOT, ROUNDING = 512, 0.02


@dataclass(frozen=True)
class Code:
    """A random product code for vectors of one length."""

    rotation: np.ndarray
    words: list[np.ndarray]  # for each block: code words x its coordinates
    threshold: float

    @classmethod
    def for_size(cls, dim: int, n: int, seed: int, filters: float, bucket: int = BUCKET) -> Code:
        """The threshold is set so that random directions reach `filters` filters in the mean."""
        total = max(2.0, filters / min(0.2, bucket / max(n, 1)))
        blocks = min(dim, max(1, int(np.ceil(np.log(total) / np.log(WORDS)))))
        each = int(np.ceil(total ** (1 / blocks)))
        rng = np.random.default_rng([SEED, seed])
        rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        words = []
        for part in np.array_split(np.arange(dim), blocks):
            w = rng.normal(size=(each, len(part)))
            words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * len(part) ** 0.5)
        probe = rng.normal(size=(400, dim))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        low, high = -(dim**0.5), dim**0.5
        low = 0.0 if filters * 2 < each**blocks else low
        for _ in range(24):
            mid = (low + high) / 2
            low, high = (mid, high) if len(cls(rotation, words, mid).decode(probe)[0]) > filters * len(probe) else (low, mid)
        return cls(rotation, words, high)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for all filters that each row reaches."""
        turned = unit @ self.rotation
        cuts = np.cumsum([w.shape[1] for w in self.words])[:-1]
        scores = [x @ w.T for x, w in zip(np.split(turned, cuts, axis=1), self.words, strict=True)]
        best = np.cumsum([s.max(1) for s in scores][::-1], axis=0)[::-1]
        row, key, held = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for i, s in enumerate(scores):
            rest = best[i + 1] if i + 1 < len(scores) else np.zeros(len(unit))
            total = held[:, None] + s[row]
            keep, word = np.nonzero(total + rest[row][:, None] >= self.threshold)
            row, key, held = row[keep], key[keep] * s.shape[1] + word, total[keep, word]
        return row, key


def classes(vectors: DataFrame) -> DataFrame:
    """(rep, weight, embedding): one row for each different usable vector."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(good)
    wide = usable.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return wide.distinct().groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither tiny nor huge components under- or overflow."""
    x = np.stack(vectors.to_list()).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def how_many(n: int) -> int:
    """Codes for n vectors: the more, the narrower are the caps, which a pair must then share in more tries."""
    return min(64, round(CODES * (1 + max(0.0, float(np.log10(max(n, 1) / 1e5))))))


def memberships(reps: DataFrame) -> DataFrame:
    """(dim, filter, rep, rounded): a row for each filter that a vector reaches; rounded: its 8-bit form."""
    sizes = reps.groupBy(F.size("embedding").alias("dim")).count().collect()  # a row for each length
    codes = {r["dim"]: [Code.for_size(r["dim"], r["count"], k, FILTERS / CODES) for k in range(how_many(r["count"]))] for r in sizes}
    sent = reps.sparkSession.sparkContext.broadcast(codes)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for dim, own in rows.groupby(rows["embedding"].map(len)):
                for at in range(0, len(own), 1000):
                    part = own.iloc[at : at + 1000]
                    x, rep = unit(part["embedding"]), part["rep"].to_numpy()
                    top = np.abs(x).max(1, keepdims=True)
                    small = np.array([r.tobytes() for r in np.rint(x / top * 127).astype(np.int8)], object)
                    for k, code in enumerate(sent.value[dim]):
                        row, key = code.decode(x)
                        yield pd.DataFrame({"dim": dim, "filter": key * 64 + k, "rep": rep[row], "rounded": small[row]})

    return reps.select("embedding", "rep").mapInPandas(decode, "dim int, filter long, rep long, rounded binary")


def ties(entries: DataFrame, cosine: float, tasks: int) -> DataFrame:
    """(a, b): vectors of a filter that may link, as spanning forests; hot filters as stars."""
    sizes = entries.groupBy("dim", "filter").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).filter("n > 1")
    sizes = stored(sizes, "filters")
    met = entries.join(sizes, ["dim", "filter"])
    stars = met.filter((F.col("n") > HOT) & (F.col("rep") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("rep").alias("b"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.groupby(["dim", "filter"]):
            x = np.stack([np.frombuffer(r, np.int8) for r in own["rounded"]]).astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            rep = own["rep"].to_numpy()
            out += [(rep[i], rep[j]) for i, j in forest(x @ x.T >= cosine - ROUNDING)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    few = met.filter(F.col("n") <= HOT).withColumn("task", F.pmod(F.xxhash64("dim", "filter"), F.lit(tasks)))
    few = few.groupBy("task").applyInPandas(compare, "a long, b long")
    return stars.unionByName(few).distinct()


def blocks(members: DataFrame) -> DataFrame:
    """(rep, task, cluster, side): which verification tasks a member (rep, cluster) goes to.

    Clusters of up to BLOCK members are dealt whole, many to a task. Larger ones are cut by a hash into parts, of which each
    two meet in a task (sides 0 and 1). Parts grow with the cluster up to WIDEST members, so that a member is copied 16
    times up to some 30,000 members, and n / WIDEST times beyond.
    """
    sizes = stored(members.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    members = members.join(sizes, "cluster")
    tasks = F.lit(max(1, members.count() // 1000))
    small = members.filter(F.col("n") <= BLOCK).select("rep", F.pmod(F.xxhash64("cluster"), tasks).alias("task"), "cluster", F.lit(0).alias("side"))
    parts = F.ceil(F.col("n") / F.greatest(F.lit(BLOCK), F.least(F.lit(WIDEST), F.col("n") / 16))).cast("int")
    large = members.filter(F.col("n") > BLOCK).withColumn("parts", parts).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    meets = lambda j: F.struct(F.xxhash64("cluster", F.least(F.col("i"), j), F.greatest(F.col("i"), j)).alias("task"), F.when(j < F.col("i"), 1).otherwise(0).alias("side"))
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), meets)
    return small.unionByName(large.select("rep", F.explode(met).alias("m"), "cluster").select("rep", "m.task", "cluster", "m.side"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    vectors = vectors.select("vec_id", "embedding")
    reps = stored(classes(vectors), "classes")
    entries = stored(memberships(reps), "members")
    tied = stored(connected_components(ties(entries, cosine, max(8, reps.count() * FILTERS // 20_000))), "tied")
    whole = blocks(tied.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))).join(reps, "rep")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.groupby(["cluster", rows["embedding"].map(len)]):
            x, rep, side = unit(own["embedding"]), own["rep"].to_numpy(), own["side"].to_numpy()
            links = x @ x.T >= cosine
            np.fill_diagonal(links, False)
            #: Between two blocks only pairs across count here; those inside have a task of their own.
            across = side[:, None] != side[None, :] if side.any() else np.ones_like(links)
            n = ((links & across) * own["weight"].to_numpy()[None, :]).sum(1)
            out += [(rep[i], n[i], None) for i in np.flatnonzero(n)]
            out += [(rep[i], 0, rep[j]) for i, j in forest(links)]
        return pd.DataFrame(out, columns=["rep", "n", "other"]).astype({"rep": "int64", "n": "int64", "other": "Int64"})

    made = stored(whole.groupBy("task").applyInPandas(verify, "rep long, n long, other long"), "links")
    counts = made.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = connected_components(made.filter("other is not null"), "rep", "other")
    per_class = reps.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = stored(per_class.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "by-class")
    wide = vectors.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("embedding").cast("array<double>")).alias("embedding"))
    out = wide.join(per_class, "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Exact; the filters lose about one pair in 200 of those at the limit on 51,000 vectors (tests measure it), none on these tables.
SQL = f"""
with recursive v as (select vec_id, embedding::double[] e from embeddings),
u as (select vec_id, e, sqrt(list_dot_product(e, e)) n from v where e is not null),
l as (select a.vec_id x, b.vec_id y from u a join u b on a.vec_id <> b.vec_id and a.n > 0 and b.n > 0 and list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
d as (select x, count(*) n from l group by x), c as (select x, min(y) m from r group by x)
select v.vec_id, coalesce(d.n, 0)::bigint n_links, least(v.vec_id, coalesce(m, v.vec_id)) component_id, v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) kept
from v left join d on d.x = v.vec_id left join c on c.x = v.vec_id"""
