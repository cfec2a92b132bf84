"""Reversible line dedup: exact reference counts of line keys, with sharded cuckoo filters in front.

A store is a folder of Parquet tables, one new version for each change:
  holders (key, doc_id)            which documents hold a key, one row each
  refs    (key, n_docs, keeper)    exact counts; keeper is the smallest doc_id holding the key
  filters (shard, n_keys, table)   a cuckoo filter of the repeated keys of each shard
insert() adds documents' keys, delete() takes documents out again; both touch only the keys of the
documents given: counts go up or down, keepers move, and fingerprints enter or leave the filters.
Deleting what was inserted gives back the earlier results. A store with a path can be opened again later. A filter never misses a repeated key, so
lines it refuses are kept without a look at the counts; lines it passes are joined with the counts.
Filters that are small together are sent to all tasks; otherwise lines and filters meet by shard.

A key: the line, `[\\x20\\x09-\\x0D]` stripped at both ends, A-Z lower-cased; keys under min_chars
code points are never dropped. Keys are held as 128-bit digests.

Cases: a null or empty text is one empty line; documents without an id take no part and keep all
lines; rows that repeat an id are one document to the counts, each row being rewritten; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import ascii_lower, shared_dir, table

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
MIN_CHARS = 10
SLOTS, MAX_ROUNDS = 4, 500
#: Keys a filter shard should hold; bytes of all shards up to which tasks are sent the filters; beyond, lines are dealt
#: to their shards, those of a shard over so many tasks, since one line may make up much of a table.
SHARD_KEYS, FILTER_BYTES, SALTS = 500_000, 32 << 20, 16


#: A row for each whole change of a store that is kept: where its tables are.
STATE = "version int, shards int, min_chars int, holders string, refs string, filters string"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key has two buckets, each found from the other and the fingerprint."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        n = 1 << max(4, int(np.ceil(np.log2(max(capacity, 1) / SLOTS / 0.85))))
        self.table = np.zeros((n, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        prints = ((keys >> np.uint64(48)) & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (keys & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self.other(first, prints)

    def other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(3)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(keys)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Whole batch at once: those without room evict a resident, which moves to its other bucket. False if full."""
        prints, at, alt = self.places(keys)
        for turn in range(2):
            left = self._place(prints, alt if turn else at)
            prints, at, alt = prints[left], at[left], alt[left]
        rng = np.random.default_rng(7)
        for _ in range(MAX_ROUNDS):
            if not len(prints):
                return True
            #: One eviction for each bucket and round; the others wait.
            _, one = np.unique(at, return_index=True)
            wait = np.setdiff1d(np.arange(len(at)), one)
            slot = rng.integers(0, SLOTS, len(one))
            out = self.table[at[one], slot].copy()
            self.table[at[one], slot] = prints[one]
            moved = self.other(at[one], out)
            prints, at = np.concatenate([out, prints[wait]]), np.concatenate([moved, at[wait]])
            left = self._place(prints, at)
            prints, at = prints[left], at[left]
        return not len(prints)

    def _place(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put what fits into free slots; the indices of the rest."""
        live = np.flatnonzero(prints)
        for slot in range(SLOTS):
            if not len(live):
                break
            free = live[self.table[bucket[live], slot] == 0]
            _, one = np.unique(bucket[free], return_index=True)
            self.table[bucket[free[one]], slot] = prints[free[one]]
            live = np.setdiff1d(live, free[one])
        return live

    def delete(self, keys: np.ndarray) -> None:
        """Take out one fingerprint for each key; the keys must have been inserted."""
        prints, *both = self.places(keys)
        live = np.arange(len(prints))
        for bucket in both:
            for slot in range(SLOTS):
                hit = live[self.table[bucket[live], slot] == prints[live]]
                _, one = np.unique(bucket[hit], return_index=True)
                self.table[bucket[hit[one]], slot] = 0
                live = np.setdiff1d(live, hit[one])


def line_keys(text: Column) -> Column:
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    return F.transform(F.split(lowered, "\n"), lambda line: F.btrim(line, F.lit(SPACE)))


def digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def word_of(key: Column) -> Column:
    """The 64 bits of a digest that filters and shards use."""
    return F.xxhash64(key)


def shard_of(word: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(word, 20), F.lit(shards)).cast("int")


def holders_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id), once for each key and document."""
    keys = F.array_distinct(F.filter(line_keys(F.col("text")), lambda k: F.char_length(k) >= min_chars))
    return docs.filter("doc_id is not null").select("doc_id", F.explode(keys).alias("line")).select(digest(F.col("line")).alias("key"), "doc_id")


def counted(holders: DataFrame) -> DataFrame:
    """Exact reference counts; partial sums are made before the shuffle, so a common line costs a row a task."""
    return holders.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("keeper"))


def build_filters(refs: DataFrame, shards: int) -> DataFrame:
    """(shard, n_keys, table) over the repeated keys."""

    def build(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, size = rows["word"].to_numpy(np.int64).view(np.uint64), len(rows)
        while not (cuckoo := CuckooFilter(size)).insert(keys):
            size *= 2
        return pd.DataFrame({"shard": [shard[0]], "n_keys": [len(rows)], "table": [cuckoo.table.tobytes()]})

    words = refs.filter("n_docs >= 2").select(word_of(F.col("key")).alias("word")).withColumn("shard", shard_of(F.col("word"), shards))
    return words.groupBy("shard").applyInPandas(build, "shard int, n_keys long, table binary")


class LineStore:
    """Versions of the three tables under `path`; each change writes new ones and then points to them.

    A store with a path of its own is kept: after each change a row is added to its log (state), and open() goes on from the
    last row, in any later session. A change that was cut off left no row, so it counts as not made, and can be made again:
    documents that the store holds already are not counted twice. A store has one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = MIN_CHARS):
        self.spark, self.min_chars, self.version, self.shards = spark, min_chars, 0, 1
        self.path, self.kept = path or shared_dir(spark, "lines"), path is not None
        self.holders = self.refs = self.filters = None
        self.places: dict[str, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineStore:
        """The store that was kept under path, as it was after its last whole change."""
        last = spark.read.schema(STATE).parquet(f"{path}/state").orderBy(F.desc("version")).first()
        if last is None:
            raise ValueError(f"no line store under {path}")
        store = cls(spark, path, last["min_chars"])
        store.version, store.shards = last["version"], last["shards"]
        for name in ("holders", "refs", "filters"):
            store.places[name] = last[name]
            setattr(store, name, spark.read.parquet(f"{path}/{last[name]}"))
        return store

    def _write(self, **tables: DataFrame) -> None:
        self.version += 1
        for name, df in tables.items():
            self.places[name] = f"{name}-{self.version}"
            to = f"{self.path}/{self.places[name]}"
            #: A change that was cut off may have left a folder of this number.
            df.write.mode("overwrite").parquet(to)
            setattr(self, name, self.spark.read.schema(df.schema).parquet(to))

    def _log(self) -> LineStore:
        if self.kept:
            row = (self.version, self.shards, self.min_chars, *[self.places[name] for name in ("holders", "refs", "filters")])
            self.spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(f"{self.path}/state")
        return self

    def insert(self, docs: DataFrame) -> LineStore:
        """Add documents that the store doesn't hold yet."""
        if self.refs is None:
            self._write(holders=holders_of(docs, self.min_chars).distinct())
            self._write(refs=counted(self.holders))
            self.shards = 1 + self.refs.filter("n_docs >= 2").count() // SHARD_KEYS
            self._write(filters=build_filters(self.refs, self.shards))
            return self._log()
        self._write(more=holders_of(docs, self.min_chars).distinct().join(self.holders, ["key", "doc_id"], "left_anti"))
        new = counted(self.more).select("key", F.col("n_docs").alias("n"), F.col("keeper").alias("k"))
        joined = self.refs.join(new, "key", "full").select("key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.least("keeper", "k").alias("keeper"), F.coalesce("n_docs", F.lit(0)).alias("before"))
        self._change(joined, self.holders.unionByName(self.more))
        return self._log()

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """Take out the documents of one column doc_id: counts go down, keepers move to the next document."""
        gone = doc_ids.select("doc_id").distinct()
        self._write(left=self.holders.join(gone, "doc_id", "left_anti").select("key", "doc_id"))
        touched = self.holders.join(gone, "doc_id", "left_semi").select("key").distinct()
        now = counted(self.left.join(touched, "key", "left_semi")).withColumnRenamed("n_docs", "n").withColumnRenamed("keeper", "k")
        joined = self.refs.join(touched.withColumn("touched", F.lit(True)), "key", "left").join(now, "key", "left")
        seen = F.coalesce("touched", F.lit(False))
        after = joined.select("key", F.when(seen, F.coalesce("n", F.lit(0))).otherwise(F.col("n_docs")).alias("n_docs"), F.when(seen, F.col("k")).otherwise(F.col("keeper")).alias("keeper"), F.col("n_docs").alias("before"))
        self._change(after, self.left)
        return self._log()

    def _change(self, after: DataFrame, holders: DataFrame) -> None:
        """Store changed counts; filters take in keys that became repeated and let go those that no longer are."""
        self._write(after=after, holders=holders)
        shard = shard_of(F.col("word"), self.shards)
        moved = self.after.filter("(n_docs >= 2) <> (before >= 2)").select(word_of(F.col("key")).alias("word"), (F.col("n_docs") >= 2).alias("enters")).withColumn("shard", shard)

        def update(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
            shard = int((old if len(old) else change)["shard"].iloc[0])
            cuckoo = CuckooFilter.of(old["table"].iloc[0]) if len(old) else CuckooFilter(len(change))
            word = change["word"].to_numpy(np.int64).view(np.uint64)
            enters = change["enters"].to_numpy(bool)
            cuckoo.delete(word[~enters])
            n = int(old["n_keys"].sum() + enters.sum() - (~enters).sum())
            fits = n <= 0.9 * cuckoo.table.size and cuckoo.insert(word[enters])
            return pd.DataFrame({"shard": [shard], "n_keys": [n], "table": [cuckoo.table.tobytes() if fits else None]})

        changed = self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(update, self.filters.schema)
        self._write(refs=self.after.filter("n_docs > 0").select("key", "n_docs", "keeper"), changed=changed)
        wanted = 1 + (self.changed.agg(F.sum("n_keys")).first()[0] or 0) // SHARD_KEYS
        if wanted > 2 * self.shards:  # the keys have outgrown their shards
            self.shards = wanted
            self._write(filters=build_filters(self.refs, self.shards))
            return
        full = self.changed.filter("table is null").select("shard")
        word = self.refs.select("key", "n_docs", word_of(F.col("key")).alias("word")).withColumn("shard", shard)
        rebuilt = build_filters(word.join(full, "shard", "left_semi"), self.shards)
        self._write(filters=self.changed.filter("table is not null").unionByName(rebuilt))

    def maybe_repeated(self, lines: DataFrame) -> DataFrame:
        """The rows of lines (key, ...) that some filter passes: all with a repeated key, and few others."""
        if self.filters.agg(F.coalesce(F.sum(F.octet_length("table")), F.lit(0))).first()[0] > FILTER_BYTES:
            return self._met_by_shard(lines)
        sent = self.spark.sparkContext.broadcast({r["shard"]: r["table"] for r in self.filters.collect()})
        shards = self.shards

        def passed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            filters = {k: CuckooFilter.of(v) for k, v in sent.value.items()}
            for words in batches:
                word = words.to_numpy(np.int64).view(np.uint64)
                shard, out = (word >> np.uint64(20)) % np.uint64(shards), np.zeros(len(word), bool)
                for k, cuckoo in filters.items():
                    own = np.flatnonzero(shard == np.uint64(k))
                    out[own] = cuckoo.contains(word[own])
                yield pd.Series(out)

        return lines.filter(F.pandas_udf(passed, "boolean")(word_of(F.col("key"))))

    def _met_by_shard(self, lines: DataFrame) -> DataFrame:
        """Each shard's filter, sent to its SALTS parts, goes before the lines of that part; a task holds one filter at a time."""
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        first = self.filters.select("shard", salts.alias("salt"), F.col("table"))
        salt = F.pmod(F.xxhash64(*[c for c in lines.columns if c != "key"]), F.lit(SALTS)).cast("int")
        dealt = lines.withColumn("word", word_of(F.col("key"))).withColumn("shard", shard_of(F.col("word"), self.shards)).withColumn("salt", salt)
        both = dealt.unionByName(first, allowMissingColumns=True)
        columns = lines.columns
        ordered = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("table").isNull())

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, cuckoo = None, None
            for batch in batches:
                shard, salt, word = (batch.column(c).fill_null(0).to_numpy() for c in ("shard", "salt", "word"))
                part, tables, keep = shard.astype(np.int64) * SALTS + salt, batch.column("table"), np.zeros(len(shard), bool)
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a < b and part[a] != at:
                        at, cuckoo = part[a], CuckooFilter.of(tables[a].as_py()) if tables[a].is_valid else None
                        a += cuckoo is not None
                    if a < b and cuckoo is not None:
                        keep[a:b] = cuckoo.contains(word[a:b].view(np.uint64))
                yield batch.select(columns).filter(pa.array(keep))

        return ordered.mapInArrow(passed, lines.schema)

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """docs' rows (doc_id, text, ...) with n_lines, n_dropped and the kept text; columns of these names are replaced, _text and _lost go."""
        rows = docs.drop("_lost").withColumn("_text", digest(F.coalesce("text", F.lit(""))))
        lines = (
            rows.filter("doc_id is not null")
            .select("doc_id", "_text", F.posexplode(line_keys(F.col("text"))).alias("at", "line"))
            .filter(F.char_length("line") >= self.min_chars)
            .select("doc_id", "_text", "at", digest(F.col("line")).alias("key"))
        )
        repeated = self.refs.filter("n_docs >= 2").select("key", "keeper")
        lost = self.maybe_repeated(lines).join(repeated, "key").filter("doc_id <> keeper")
        by_row = lost.groupBy("doc_id", "_text").agg(F.collect_set("at").alias("_lost"))
        whole = F.split(F.coalesce("text", F.lit("")), "\n")
        left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.coalesce("_lost", F.array().cast("array<int>"))))
        kept = F.transform(F.array(whole), lambda lines: F.transform(left, lambda i: F.get(lines, i)))[0]
        return (
            rows.join(by_row, ["doc_id", "_text"], "left")
            .withColumn("n_lines", F.size(whole).cast("long"))
            .withColumn("n_dropped", F.coalesce(F.size("_lost"), F.lit(0)).cast("long"))
            .withColumn("kept", F.when(F.col("_lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.concat_ws("\n", kept)))
            .drop("_text", "_lost")
        )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = LineStore(spark).insert(docs).deduplicated(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
k as (select doc_id, line, i, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) key from l),
r as (select key, min(doc_id) keeper from k where length(key) >= {MIN_CHARS} group by key having count(distinct doc_id) >= 2)
select doc_id, count(*) n_lines, count(*) filter (keeper <> doc_id) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (keeper is null or keeper = doc_id), '')) kept_sha256
from k left join r on k.key = r.key group by doc_id"""
