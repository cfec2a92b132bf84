"""The registry on a stream, as a log: a micro-batch writes what it brings, runs of batches are merged now and then.

Batch b writes run [b, b+1). Whenever the number of batches divides by a power of FANOUT, the FANOUT runs before it become
one, so a row is rewritten once for each power, and a reader merges a few runs of each size. Names of runs follow from the
batch's number alone: a batch that runs again writes the same runs, and no list of runs has to be kept.

What is stored merges in any order and any number of times: an entity's sightings are kept by piece of evidence, so that
evidence seen again, in the same batch or a later one, is counted once; a relation keeps its first row and its first dated one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 8
ENTITY, RELATION = ["case_id", "node_type", "normalized"], ["case_id", "src", "dst", "edge_type"]


def seen_entities(found: DataFrame, batch: int) -> DataFrame:
    """Sightings (key, value, evidence_id, confidence, engine, snippet, seen) in the form that is stored."""
    n = F.lit(batch).cast("long")
    first = F.struct(n.alias("batch"), F.col("seen").cast("long").alias("seen"), "value")
    best = F.struct(F.col("confidence").cast("double").alias("confidence"), (-n).alias("batch"), (-F.col("seen").cast("long")).alias("seen"), "engine", "snippet")
    return found.select(*ENTITY, F.col("evidence_id").cast("long").alias("evidence_id"), first.alias("first"), best.alias("best"))


def merged_entities(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*ENTITY, "evidence_id").agg(F.min("first").alias("first"), F.max("best").alias("best"))


def entities(rows: DataFrame) -> DataFrame:
    """Stored sightings as registry rows: value and evidence of the first, engine and snippet of the surest one."""
    start = F.min(F.struct("first", "evidence_id"))
    out = merged_entities(rows).groupBy(*ENTITY).agg(start.alias("f"), F.max("best").alias("b"), F.count("evidence_id").alias("mention_count"))
    return out.select(*ENTITY, F.col("f.first.value").alias("value"), F.col("f.evidence_id").alias("evidence_id"), "b.confidence", "b.engine", "b.snippet", "mention_count")


def seen_relations(found: DataFrame, batch: int) -> DataFrame:
    """Relations (key, relation_id, evidence_id, confidence, status, snippet, valid_from) in the form that is stored; loops are dropped."""
    order = [F.lit(batch).cast("long").alias("batch"), F.col("relation_id").cast("long").alias("relation_id"), F.col("confidence").cast("double").alias("confidence")]
    first = F.struct(*order, F.coalesce("valid_from", F.lit("9999-12-31").cast("date")).alias("by_date"), F.col("evidence_id").cast("long").alias("evidence_id"), "status", "snippet")
    dated = F.when(F.col("valid_from").isNotNull(), F.struct(*order, "valid_from"))
    return found.filter("src <> dst").select(*RELATION, first.alias("first"), dated.alias("dated"))


def merged_relations(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*RELATION).agg(F.min("first").alias("first"), F.min("dated").alias("dated"))


def relations(rows: DataFrame) -> DataFrame:
    """Stored relations as registry rows: the first one stays, with the first date that any has."""
    return merged_relations(rows).select(*RELATION, "first.relation_id", "first.evidence_id", "first.confidence", "first.status", "first.snippet", "dated.valid_from")


class Log:
    """Runs of merged rows under a shared path."""

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], fanout: int = FANOUT):
        self.spark, self.path, self.schema, self.merge, self.fanout = spark, path.rstrip("/"), schema, merge, fanout

    def place(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run-{run[0]}-{run[1]}"

    def runs(self, n: int) -> list[tuple[int, int]]:
        """The runs that hold batches 0 to n-1: the largest that have been merged by then."""
        out, at = [], 0
        while at < n:
            size = 1
            while at % (size * self.fanout) == 0 and at + size * self.fanout <= n:
                size *= self.fanout
            out.append((at, at + size))
            at += size
        return out

    def read(self, runs: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*map(self.place, runs)) if runs else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Writes a batch's run, and the merged runs that end with it."""
        self.merge(rows).write.mode("overwrite").parquet(self.place((batch, batch + 1)))
        n, size = batch + 1, self.fanout
        while n % size == 0:
            parts = [(at, at + size // self.fanout) for at in range(n - size, n, size // self.fanout)]
            self.merge(self.read(parts)).write.mode("overwrite").parquet(self.place((n - size, n)))
            size *= self.fanout

    def rows(self, batch: int) -> DataFrame:
        """All rows after a batch; none before the first."""
        return self.read(self.runs(batch + 1))

    def vacuum(self, batch: int) -> int:
        """Removes runs that neither a reader after the batch nor the batch run again needs; returns how many."""
        keep = {self.place(r) for r in [*self.runs(batch + 1), *self.runs(batch), (batch, batch + 1)]}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = 0
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("run-") and int(name.split("-")[2]) <= batch + 1 and f"{self.path}/{name}" not in keep:
                gone += bool(fs.delete(status.getPath(), True))
        return gone


class RegistryStore:
    """Entities and relations under a shared path, each a log of micro-batches."""

    SEEN = "case_id int, node_type string, normalized string, evidence_id long, first struct<batch:long,seen:long,value:string>, best struct<confidence:double,batch:long,seen:long,engine:string,snippet:string>"
    LINKED = "case_id int, src string, dst string, edge_type string, first struct<batch:long,relation_id:long,confidence:double,by_date:date,evidence_id:long,status:string,snippet:string>, dated struct<batch:long,relation_id:long,confidence:double,valid_from:date>"

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark = spark
        self.entities = Log(spark, f"{path}/entities", self.SEEN, merged_entities, fanout)
        self.relations = Log(spark, f"{path}/relations", self.LINKED, merged_relations, fanout)

    def apply(self, found: DataFrame, batch: int) -> None:
        """A batch's sightings; one that runs again takes its own place."""
        self.entities.append(seen_entities(found, batch), batch)

    def link(self, found: DataFrame, batch: int) -> None:
        """A batch's relations."""
        self.relations.append(seen_relations(found, batch), batch)

    def version(self, batch: int) -> DataFrame:
        """The entity registry after a batch; undecided (`operators.registry.decide` adds decisions)."""
        return entities(self.entities.rows(batch)).withColumn("status", F.lit("pending"))

    def links(self, batch: int) -> DataFrame:
        """The relation registry after a batch."""
        return relations(self.relations.rows(batch))

    def vacuum(self, batch: int) -> int:
        return self.entities.vacuum(batch) + self.relations.vacuum(batch)
