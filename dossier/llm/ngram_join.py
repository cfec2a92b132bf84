"""N-gram Jaccard join: a grouped prefix join over word shingles, exact, up to connected components.

1. Texts become sets of 64-bit shingle hashes, made from cryptographic hashes of their words; equal
   sets are one member, named by a 128-bit digest of the set (its `sig`).
2. Shingles get one global order: rare before frequent. Two sets that link must share a shingle among
   the first |x| - ceil(t |x|) + 1 of each (the prefix). To find frequencies without shuffling every
   shingle, sets post only shingles of the lowest part of the hash range (all, if those are fewer than
   the prefix); a shingle found in one set only has no partner, so a set whose prefix is filled by
   such shingles is done. Shingles that a sample of documents shows to be very common come last in
   the order and are not posted; the sample decides the order alone, not the result.
3. Members of equal size and prefix become a group. Two groups are a pair if they share a prefix
   shingle at places from which their sizes still allow a link, and share as many prefix shingles as
   a link needs (what lies behind the prefixes cannot make up for more).
4. Pairs are expanded to members and verified in two passes. The first takes neighbours alone: groups
   that follow one another in a shingle's list, members that follow one another in a group, and long
   lists' parts with their first. What it links is connected. The second takes all pairs that are left
   between members not connected yet. In either, the members of a shingle's pairs (or of a group's) are
   compared together by matrix products, many of them in blocks of pairs of parts; a block returns a
   spanning forest of its links, so no pass emits all pairs of a group of copies.

Cases: a null text, or one without words, has an empty set and links with nothing; fewer words than
a shingle make one shingle; a null doc_id keeps its row (component null) and links nothing; rows
with words that share an id are one node, whatever their texts; repeated rows get equal rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, broadcast_up_to, forest, stored, table
from dossier.operators.components import connected_components

N_WORDS, PERCENT = 4, 85
#: Share of the hash range that is posted; postings a range task holds, about, and those a task holds before it passes them on.
POSTED, RANGE_ROWS, HELD = 0.25, 400_000, 600_000
#: Documents sampled to find common shingles, and the share of them that makes one common.
SAMPLE_DOCS, COMMON = 4000, 0.01
#: Members and bytes of text in a part of what is compared together; bytes of text a verification task reads, about.
BLOCK, BLOCK_BYTES, TASK_BYTES = 512, 8 << 20, 16 << 20
#: Entries of a list that follow one another in one task; rows up to which small sides are broadcast.
CHAIN, BROADCAST_ROWS = 10_000, 200_000
#: Entries up to which a list's pairs are spelt out; entries of a part of a longer list, of which two are compared at once,
#: and entries that a task reads for that, about.
SPELT, PART, TASK_ROWS = 16, 512, 4_000
#: Words whose hashes a task keeps, those of at most so many bytes; bytes of a text that are split at once.
KEPT_WORDS, KEPT_BYTES, AT_ONCE = 200_000, 64, 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Cryptographic 64-bit hashes of words, those of the words seen last kept."""

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found


class Shingler:
    """Shingle hashes of texts; words are runs of other bytes than white space, A-Z lower-cased."""

    def __init__(self, n: int = N_WORDS):
        self.n, self.hashes = n, WordHashes()

    def words(self, data: bytes) -> np.ndarray:
        """A hash of each word; the text is cut at white space into pieces that are split at once."""
        out, at = [], 0
        while at < len(data):
            cut = _SPACE.search(data, at + AT_ONCE) if len(data) - at > AT_ONCE else None
            end = cut.start() if cut else len(data)
            found = data[at:end].lower().split()
            out.append(np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found)))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def of(self, data: bytes) -> np.ndarray:
        """Sorted distinct shingle hashes of one text."""
        w = self.words(data)
        if not len(w):
            return w
        n, out = min(self.n, len(w)), []
        for at in range(0, len(w) - n + 1, AT_ONCE):
            size = min(AT_ONCE, len(w) - n + 1 - at)
            h = np.full(size, n, np.uint64)
            for k in range(n):
                h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + w[at + k : at + k + size])
            out.append(np.unique(h))
        return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def signature(h: np.ndarray) -> bytes:
    """A 128-bit digest that stands for a set."""
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


@dataclass(frozen=True)
class Rule:
    n: int
    percent: int
    ranges: int
    common: np.ndarray | None = None

    def prefix(self, size: int) -> int:
        return size - -(-self.percent * size // 100) + 1

    def is_common(self, h: np.ndarray) -> np.ndarray:
        if self.common is None or not len(self.common):
            return np.zeros(len(h), bool)
        return self.common[np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)] == h

    def behind(self, size: Column) -> Column:
        """Shingles behind the prefix of a set."""
        return F.floor((size * self.percent + 99) / 100).cast("int") - 1

    def shared(self, a: Column, b: Column) -> Column:
        """Shingles that sets of these sizes share if they link, at least."""
        whole = 100 + self.percent
        return F.floor(((a + b) * self.percent + whole - 1) / whole).cast("int")


CUT = np.uint64(int(POSTED * 2**64))
SETS = "doc_id long, sig binary, mark binary, bytes long, size int, low int, high int, common array<bigint>, part int, keys binary, owners binary, sigs binary"
KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
NAMES = [c.split()[0] for c in SETS.split(", ")]


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)


def shingle_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """Two kinds of rows from one pass over the texts.

    A document's: doc_id, sig (null for an empty set), mark (MD5 of the text) and bytes of the text, size, how many
    shingles it posts below and above the cut, and its common shingles that its prefix may reach. A batch's postings of
    one hash range (`part` set): packed keys, the places of their owners in the packed sigs; equal sets once.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(rule.n), set()
        keys: list[np.ndarray] = []
        sigs: list[bytes] = []
        held = 0

        def postings() -> pa.RecordBatch:
            k, s = np.concatenate(keys), np.repeat(np.arange(len(keys)), list(map(len, keys)))
            part = (k >> np.uint64(20)) % np.uint64(rule.ranges)
            order = np.argsort(part, kind="stable")
            k, s, part = k[order], s[order], part[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            names, columns = np.frombuffer(b"".join(sigs), "V16"), [[], [], [], []]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own, at = np.unique(s[a:b], return_inverse=True)
                for column, value in zip(columns, (int(part[a]), k[a:b].tobytes(), at.astype(np.int32).tobytes(), names[own].tobytes()), strict=True):
                    column.append(value)
            return _batch([*[[None] * len(columns[0])] * 8, *columns])

        for batch in batches:
            out: list[list] = [[] for _ in NAMES]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                h = shingler.of(data)
                sig, p = signature(h) if len(h) else None, rule.prefix(len(h))
                is_common = rule.is_common(h)
                rare = h[~is_common]
                low = int(np.searchsorted(rare, CUT))
                high = 0 if low >= p else len(rare) - low
                last = h[is_common][: max(p - low - high, 0)].view(np.int64).tolist()
                for column, value in zip(out, (doc, sig, hashlib.md5(data).digest(), len(data), len(h), low, high, last, None, None, None, None), strict=True):
                    column.append(value)
                if sig and doc is not None and sig not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(sig)
                    if low + high:
                        keys.append(rare[: low + high])
                        sigs.append(sig)
                        held += low + high
            yield _batch(out)
            if held > HELD:
                yield postings()
                keys, sigs, held = [], [], 0
        if held:
            yield postings()

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(build, SETS)


def common_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles in at least COMMON of a sample of documents: at most (mean set size) / COMMON of them."""
    total = docs.count()
    drawn = docs.filter(F.pmod(F.xxhash64(F.lit("common"), "doc_id"), F.lit(1 << 20)) < F.lit(min(1.0, SAMPLE_DOCS / max(total, 1)) * (1 << 20)))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, seen = Shingler(n), set()
        for rows in batches:
            sets = [h for t in rows["text"] if len(h := shingler.of((t or "").encode())) and (s := signature(h)) not in seen and not seen.add(s)]
            yield pd.DataFrame({"h": np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)})

    least = max(20, int(COMMON * min(total, SAMPLE_DOCS)))
    found = bounded_batches(drawn).select("text").mapInPandas(each, "h long").groupBy("h").count().filter(F.col("count") >= least).select("h").collect()
    return np.sort(np.array([r["h"] for r in found], np.int64).view(np.uint64))


def shared_postings(sets: DataFrame) -> DataFrame:
    """(sig, key, df) for posted shingles of at least two different sets."""

    def reduce(rows: pa.Table) -> pa.Table:
        packed = {c: rows.column(c).to_pylist() for c in ("keys", "owners", "sigs")}
        shift = np.cumsum([0, *[len(x) // 16 for x in packed["sigs"]]])
        k = np.frombuffer(b"".join(packed["keys"]), np.uint64)
        s = np.concatenate([np.frombuffer(x, np.int32).astype(np.int64) + at for x, at in zip(packed["owners"], shift[:-1], strict=True)])
        halves = np.frombuffer(b"".join(packed["sigs"]), np.uint64).reshape(-1, 2)
        by_name = np.lexsort((halves[:, 1], halves[:, 0]))
        new_name = np.concatenate([[True], (np.diff(halves[by_name], axis=0) != 0).any(1)])
        number = np.empty(len(by_name), np.int64)
        number[by_name] = np.cumsum(new_name) - 1
        s = number[s]
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
        k, s = k[new], s[new]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        df = np.diff(np.append(np.flatnonzero(first), len(k)))
        df = df[np.cumsum(first) - 1]
        keep = df >= 2
        names = halves[by_name[new_name]][s[keep]]
        owner = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(names), [None, pa.py_buffer(np.ascontiguousarray(names).tobytes())]).cast(pa.binary())
        return pa.table([owner, pa.array(k[keep].view(np.int64)), pa.array(df[keep])], ["sig", "key", "df"])

    return sets.filter("part is not null").select("part", "keys", "owners", "sigs").groupBy("part").applyInArrow(reduce, "sig binary, key long, df long")


def prefixes(members: DataFrame, shared: DataFrame, rule: Rule) -> DataFrame:
    """(sig, grp, size, prefix): shingles of each member's prefix that others have too, with their places, in the global order.

    The order: posted below the cut by (frequency, hash), then posted above it, then common ones by hash; those that one set
    alone has are the first of their part. Members whose prefix holds only such are left out. A group (`grp`) is members
    of equal size and equal whole prefix, or a member whose prefix has a shingle of its own.
    """
    is_low = F.expr(f"key between 0 and {int(CUT) - 1}")
    lists = shared.withColumn("low", is_low).groupBy("sig").agg(
        F.array_sort(F.collect_list(F.when(F.col("low"), F.struct("df", "key")))).alias("lows"),
        F.array_sort(F.collect_list(F.when(~F.col("low"), F.struct("df", "key")))).alias("highs"),
    )
    none = F.array().cast("array<struct<df:bigint,key:bigint>>")
    m = members.join(lists, "sig", "left").withColumns({"lows": F.coalesce("lows", none), "highs": F.coalesce("highs", none)})
    take = lambda name, n: F.slice(name, F.lit(1), F.greatest(n, F.lit(0)))
    only_low, only_high = F.col("low") - F.size("lows"), F.col("high") - F.size("highs")
    at = lambda key, place: F.struct(key.alias("key"), place.cast("int").alias("pos"))
    m = m.withColumn("p", F.col("size") - rule.behind(F.col("size"))).select(
        "sig", "size",
        F.concat(
            F.transform(take("lows", F.col("p") - only_low), lambda x, i: at(x["key"], only_low + i)),
            F.transform(take("highs", F.col("p") - F.col("low") - only_high), lambda x, i: at(x["key"], F.col("low") + only_high + i)),
            F.transform(take("common", F.col("p") - F.col("low") - F.col("high")), lambda x, i: at(x, F.col("low") + F.col("high") + i)),
        ).alias("prefix"),
        (F.least(only_low, F.col("p")) + F.least(only_high, F.greatest(F.col("p") - F.col("low"), F.lit(0)))).alias("alone"),
    )
    whole = F.unhex(F.md5(F.concat_ws(",", "size", F.transform("prefix", lambda x: x["key"].cast("string")))))
    return m.filter(F.size("prefix") > 0).select("sig", F.when(F.col("alone") == 0, whole).otherwise(F.col("sig")).alias("grp"), "size", "prefix")


def possible(rule: Rule, a: str, b: str) -> Column:
    """Whether two entries of a shingle's list (struct columns of size and pos) leave room for a link."""
    x, y = F.col(a), F.col(b)
    return F.least(x["size"] - x["pos"], y["size"] - y["pos"]) >= rule.shared(x["size"], y["size"])


def enough(pairs: DataFrame, groups: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b, ...) of groups whose prefixes share what a link needs beyond the shingles behind them."""
    of = lambda end: groups.select(F.col("grp").alias(end), F.col("size").alias(f"{end}_size"), F.col("keys").alias(f"{end}_keys"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    need = rule.shared(F.col("a_size"), F.col("b_size")) - F.greatest(rule.behind(F.col("a_size")), rule.behind(F.col("b_size")))
    return met.filter(F.size(F.array_intersect("a_keys", "b_keys")) >= need).select(*pairs.columns)


def chained(rows: DataFrame, by: str, order: list[str], entry: Column) -> DataFrame:
    """(by, x, y): each entry with the next one of its list; in a list of over CHAIN entries, which falls into parts
    by hash, each also with the list's first."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"), F.min(entry).alias("x")).filter("n > 1")
    sizes = stored(sizes, "lists")
    salt = F.pmod(F.xxhash64(*order), F.ceil(F.col("n") / CHAIN)).alias("salt")
    met = rows.join(sizes, by).select(by, "n", F.col("x").alias("first"), entry.alias("x"), salt)
    nxt = met.withColumn("y", F.lead("x").over(W.partitionBy(by, "salt").orderBy("x"))).filter("y is not null").select(by, "x", "y")
    stars = met.filter((F.col("n") > CHAIN) & (F.col("x") != F.col("first"))).select(by, F.col("first").alias("x"), F.col("x").alias("y"))
    return nxt.unionByName(stars)


def in_common(sets: list[np.ndarray]) -> np.ndarray:
    """members x members: |x & y|."""
    sizes = np.array([len(s) for s in sets])
    _, token, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[n[token] > 1]
    _, token = np.unique(token[n[token] > 1], return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both, at, wide = np.zeros((len(sets), len(sets)), np.float64), 0, max(1, 4_000_000 // len(sets))
    while len(token) and at <= token[-1]:
        a, b = np.searchsorted(token, [at, at + wide])
        grid = np.zeros((len(sets), min(wide, int(token[-1]) + 1 - at)), np.float32)
        grid[owner[a:b], token[a:b] - at] = 1
        both += grid @ grid.T
        at += wide
    return both


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """members x members: whether 100 |x & y| >= percent |x | y|."""
    sizes, both = np.array([len(s) for s in sets]), in_common(sets)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def in_long_lists(spread: DataFrame, groups: DataFrame, rule: Rule) -> DataFrame:
    """(list, grp, comp): what of two parts of a long list may link with something there, and is not connected with it.

    spread: key, comp, e, of lists of any length. A list falls into parts: components of few entries by hash, one of many
    into parts of its own, which need not meet each other. Two parts are compared in a task by the long lists that
    they share, all shingles of other lists being taken for shared. A pair counts in one of the long lists it shares,
    that of the smallest key, so what comes out of a list are its entries that have such a pair, and never the pairs.
    """
    spread = spread.withColumn("g", F.col("e.grp"))
    prefix = spread.groupBy("g").agg(F.collect_set("key").alias("lists"))  # no more than a prefix has
    prefix = stored(prefix.join(groups.select(F.col("grp").alias("g"), F.size("keys").alias("all")), "g").select("g", "lists", (F.col("all") - F.size("lists")).alias("others")), "prefixes")
    many = spread
    by_comp = spread.groupBy("key", "comp").agg(F.count("*").alias("c"))
    small = F.when(F.col("c") <= PART, F.col("c")).otherwise(0)
    by_comp = by_comp.join(by_comp.groupBy("key").agg(F.ceil(F.sum(small) / PART).alias("parts")), "key")
    big = F.col("c") > PART
    many = many.join(by_comp, ["key", "comp"]).withColumn("own", F.when(big, F.col("comp"))).withColumn(
        "node", F.when(big, F.xxhash64("comp", F.pmod(F.xxhash64("g"), F.ceil(F.col("c") / PART)))).otherwise(F.pmod(F.xxhash64("comp"), F.greatest("parts", F.lit(1))))
    )
    many = stored(many.select("key", "node", "own", "comp", "g", F.col("e.size").alias("size")), "long")
    nodes = many.groupBy("key", "node").agg(F.first("own").alias("own"))
    twice = nodes.join(nodes.select("key", F.col("node").alias("node2"), F.col("own").alias("own2")), "key")
    twice = twice.filter("node <= node2 and (node < node2 or own is null) and not coalesce(own = own2, false)")
    units = twice.select("key", F.xxhash64("key", "node", "node2").alias("unit"), F.explode(F.array("node", "node2")).alias("node")).distinct()
    tasks = max(1, many.count() // TASK_ROWS)
    rows = many.join(units, ["key", "node"]).join(broadcast_up_to(prefix, BROADCAST_ROWS), "g").select(F.pmod("unit", F.lit(tasks)).alias("task"), "unit", "key", "comp", "g", "size", "lists", "others")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out, whole = [], 100 + rule.percent
        for _, own in rows.groupby("unit"):
            comp, size = pd.factorize(own["comp"])[0], own["size"].to_numpy(np.int64)
            shared = ((size[:, None] + size[None]) * rule.percent + whole - 1) // whole
            behind = (size * rule.percent + 99) // 100 - 1
            fits = (comp[:, None] != comp[None]) & (np.minimum(size[:, None], size[None]) >= shared)
            if fits.any():
                others = own["others"].to_numpy(np.int64)
                fits &= in_common(list(own["lists"])) + np.minimum(others[:, None], others[None]) >= shared - np.maximum(behind[:, None], behind[None])
            if fits.any():
                fits &= in_common([k[k < own["key"].iloc[0]] for k in own["lists"]]) == 0
            some = fits.any(1)
            out += zip(own["unit"][some], own["g"][some], own["comp"][some], strict=True)
        return pd.DataFrame(out, columns=["list", "grp", "comp"])

    return rows.groupBy("task").applyInPandas(compare, "list long, grp binary, comp binary")


def verified(docs: DataFrame, pairs: DataFrame, ends: DataFrame, rule: Rule, name: str, together: DataFrame | None = None) -> DataFrame:
    """(a, b): links that connect whatever members of the pairs (list, x, y), or of what is `together` (list, id), are linked.

    x, y: ids of ends; ends: id, sig, rep, the members that an id stands for (a bounded number). What the pairs of a list
    name is compared together; if that is much, it falls into parts, and each two parts with a pair between them (all
    parts of what is together) meet. Texts are read again by (doc_id, MD5).
    """
    pairs = stored(pairs, f"{name}-pairs")
    both = lambda *more: F.explode(F.array(*[F.struct(*more, F.col(c).alias("id")) for c in ("x", "y")])).alias("e")
    weights = ends.groupBy("id").agg(F.count("*").alias("n"), F.sum("rep.bytes").alias("bytes"))
    in_parts = lambda named: named.distinct().join(weights, "id").groupBy("list").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).alias("parts"))
    lists = in_parts(pairs.select("list", both()).select("list", "e.id"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    unit = F.xxhash64("list", F.least(part("x"), part("y")), F.greatest(part("x"), part("y")))
    units = pairs.join(lists, "list").select(both(unit.alias("unit"))).select("e.unit", "e.id").distinct()
    if together is not None:
        each = together.join(in_parts(together), "list").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        units = units.unionByName(each.select(F.xxhash64("list", F.least(part("id"), "other"), F.greatest(part("id"), "other")).alias("unit"), "id").distinct())
    rows = stored(units.join(ends, "id").select("unit", "sig", "rep.*").distinct(), f"{name}-units")
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    met = docs.join(broadcast_up_to(rows, BROADCAST_ROWS), "doc_id").filter(F.unhex(F.md5("text")) == F.col("mark"))
    met = met.select(F.pmod(F.xxhash64("unit"), F.lit(max(1, total // TASK_BYTES))).alias("task"), "unit", "sig", "text")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        shingler, known, out = Shingler(rule.n), {}, []
        for _, own in rows.drop_duplicates(["unit", "sig"]).groupby("unit"):
            for sig, text in zip(own["sig"], own["text"], strict=True):
                if sig not in known:
                    known[sig] = shingler.of(text.encode())
            sigs = own["sig"].to_list()
            out += [(sigs[i], sigs[j]) for i, j in forest(linked([known[s] for s in sigs], rule.percent))]
        return pd.DataFrame(out, columns=["a", "b"])

    return stored(met.groupBy("task").applyInPandas(verify, "a binary, b binary"), f"{name}-links")


def all_links(docs: DataFrame, members: DataFrame, prefixed: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): links between members that connect all that are connected."""
    member = stored(prefixed, "grouped")
    groups = member.groupBy("grp").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.min("sig").alias("head"))
    groups = stored(groups.withColumn("keys", F.transform("prefix", lambda x: x["key"])), "groups")
    entries = groups.select("grp", "size", F.explode("prefix").alias("e")).select("e.key", F.struct("size", "grp", "e.pos").alias("e"))
    keys = stored(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "keys")
    entries = stored(entries.join(keys, "key"), "entries")
    of_key, of_group = F.xxhash64(F.lit("key"), "key").alias("list"), F.xxhash64(F.lit("group"), "grp").alias("list")
    # First pass: neighbours.
    near = chained(entries.withColumn("grp", F.col("e.grp")), "key", ["grp"], F.col("e")).filter(possible(rule, "x", "y"))
    pairs = near.select(of_key, F.least("x.grp", "y.grp").alias("a"), F.greatest("x.grp", "y.grp").alias("b")).groupBy("a", "b").agg(F.min("list").alias("list"))
    near = stored(enough(pairs, groups, rule), "neighbours")
    head = lambda end, name: groups.select(F.col("grp").alias(end), F.col("head").alias(name))
    across = near.join(head("a", "x"), "a").join(head("b", "y"), "b").select("list", "x", "y")
    inside = chained(member.join(groups.filter("n > 1").select("grp"), "grp").select("grp", "sig"), "grp", ["sig"], F.col("sig")).select(of_group, "x", "y")
    alone = members.select(F.col("sig").alias("id"), "sig", "rep")
    links = verified(docs, across.unionByName(inside), alone, rule, "near")
    # Second pass: all others that are not connected yet; the ends are members of a group that are connected, in parts.
    known = stored(connected_components(links), "connected").withColumnsRenamed({"node": "sig", "component": "comp"})
    placed = member.select("sig", "grp").join(known, "sig", "left").withColumn("comp", F.coalesce("comp", "sig")).join(members.select("sig", "rep"), "sig")
    placed = stored(placed, "placed")
    many = F.least(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("rep.bytes") / BLOCK_BYTES)), F.count("*")).cast("int")
    subgroups = stored(placed.groupBy("grp", "comp").agg(F.greatest(many, F.lit(1)).alias("parts")), "subgroups")
    id_of = lambda grp, comp, part: F.unhex(F.md5(F.concat(F.col(grp), F.col(comp), part.cast("string").cast("binary"))))
    ends = placed.join(subgroups, ["grp", "comp"]).select(id_of("grp", "comp", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")).alias("id"), "sig", "rep")
    spread = entries.select("key", "e", F.col("e.grp").alias("grp")).join(subgroups.select("grp", "comp"), "grp").select("key", "comp", "e")
    mixed = spread.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("n")).filter("least <> most").select("key", "n")
    spread = stored(spread.join(mixed, "key"), "spread")
    short = spread.filter(F.col("n") <= SPELT).groupBy("key").agg(F.collect_list(F.struct("comp", "e")).alias("all"))
    spelt = short.select("key", F.explode("all").alias("p"), "all").select("key", "p", F.explode(F.filter("all", lambda q: q["comp"] > F.col("p.comp"))).alias("q"))
    spelt = spelt.select("key", F.col("p.comp").alias("x"), F.col("q.comp").alias("y"), F.col("p.e").alias("p"), F.col("q.e").alias("q")).filter(possible(rule, "p", "q"))
    spelt = spelt.select(of_key, F.col("p.grp").alias("a"), "x", F.col("q.grp").alias("b"), "y")
    found = stored(in_long_lists(spread.filter(F.col("n") > SPELT).drop("n"), groups, rule), "found")
    others = spelt.groupBy("a", "x", "b", "y").agg(F.min("list").alias("list"))
    torn = subgroups.select("grp", "comp")
    own = torn.join(torn.withColumnRenamed("comp", "y"), "grp").filter("comp < y").select(F.col("grp").alias("a"), F.col("comp").alias("x"), F.col("grp").alias("b"), "y", of_group)
    #: Two groups of one member each were compared if they were neighbours.
    lone = lambda end: groups.filter("n = 1").select(F.col("grp").alias(end))
    done = near.join(lone("a"), "a", "left_semi").join(lone("b"), "b", "left_semi").select("a", "b")
    done = done.unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = enough(others.filter("a <> b").join(done, ["a", "b"], "left_anti"), groups, rule).unionByName(own)
    sizes = lambda g, c, n: subgroups.select(F.col("grp").alias(g), F.col("comp").alias(c), F.col("parts").alias(n))
    left = left.join(sizes("a", "x", "m"), ["a", "x"]).join(sizes("b", "y", "n"), ["b", "y"])
    left = left.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    left = left.select("list", id_of("a", "x", F.col("i")).alias("x"), id_of("b", "y", F.col("j")).alias("y"))
    found = found.join(subgroups, ["grp", "comp"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = found.select("list", id_of("grp", "comp", F.col("i")).alias("id"))
    return links.unionByName(verified(docs, left, ends, rule, "far", found))


def jaccard_components(docs: DataFrame, n: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, and its `sig` (equal for equal sets, null for empty ones)."""
    docs = docs.select("doc_id", "text")
    common = common_shingles(docs, n)
    n_rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 24  # postings, about
    rule = Rule(n, percent, max(8, int(n_rows // RANGE_ROWS)), common)
    sets = stored(shingle_sets(docs, rule), "sets")
    rows = sets.filter("part is null").select("doc_id", "sig", "mark", "bytes", "size", "low", "high", "common")
    named = rows.filter("doc_id is not null and sig is not null")
    members = named.groupBy("sig").agg(F.min(F.struct("doc_id", "mark", "bytes")).alias("rep"), *[F.first(c).alias(c) for c in ("size", "low", "high", "common")])
    members = stored(members, "members")
    links = all_links(docs, members, prefixes(members, shared_postings(sets), rule), rule)
    node = members.select("sig", F.col("rep.doc_id").alias("node"))
    edges = links.join(node.withColumnsRenamed({"sig": "a", "node": "x"}), "a").join(node.withColumnsRenamed({"sig": "b", "node": "y"}), "b").select("x", "y")
    #: Ids with several texts tie the sets of those.
    torn = named.groupBy("doc_id").agg(F.min("sig").alias("least"), F.max("sig").alias("most")).filter("least <> most").select("doc_id")
    tied = named.join(torn, "doc_id").select("doc_id", "sig").join(node, "sig").select(F.col("doc_id").alias("x"), F.col("node").alias("y"))
    joined = connected_components(edges.unionByName(tied), "x", "y")
    component = stored(node.join(joined, "node", "left").select("sig", F.coalesce("component", "node").alias("component")), "components")
    out = rows.select("doc_id", "sig", "size").join(component, "sig", "left")
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), "sig")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("sig")


SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws from documents),
s as (select distinct doc_id, unnest(list_transform(range(1, len(ws) - least(len(ws), {N_WORDS}) + 2), lambda i: array_to_string(ws[i:i + {N_WORDS} - 1], ' '))) g from w where len(ws) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
l as (select a.doc_id x, b.doc_id y from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  where na.n * 100 >= {PERCENT} * nb.n and nb.n * 100 >= {PERCENT} * na.n
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= {PERCENT} * (na.n + nb.n - count(*))),
r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, least(w.doc_id, coalesce(min(r.y), w.doc_id)) component_id
from w left join n on n.doc_id = w.doc_id left join r on r.x = w.doc_id group by w.doc_id"""
