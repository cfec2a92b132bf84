"""The registry: folding extracted rows, decisions, merges, and the graph derived from confirmed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.operators.components import connected_components, stored


def fold_entities(found: DataFrame) -> DataFrame:
    """One row for (case_id, node_type, normalized).

    found: case_id, node_type, normalized, value, evidence_id, confidence, engine, snippet, seen (order of arrival).
    Value and evidence come from the first sighting, engine and snippet from the most confident one; mentions count
    distinct evidence, so that reading a file again changes nothing.
    """
    best = F.max_by(F.struct("engine", "snippet"), F.struct("confidence", -F.col("seen")))
    return found.groupBy("case_id", "node_type", "normalized").agg(
        F.min_by("value", "seen").alias("value"), F.min_by("evidence_id", "seen").alias("evidence_id"),
        F.max("confidence").alias("confidence"), best["engine"].alias("engine"), best["snippet"].alias("snippet"),
        F.count_distinct("evidence_id").alias("mention_count"), F.min("seen").alias("seen"),
    )


def upsert_entities(stored_rows: DataFrame, found: DataFrame) -> DataFrame:
    """The registry with a batch of sightings folded in. A decided status stays; new rows are pending."""
    new = fold_entities(found)
    key = ["case_id", "node_type", "normalized"]
    old = stored_rows.select(*key, *[F.col(c).alias(f"o_{c}") for c in ("value", "evidence_id", "confidence", "engine", "snippet", "mention_count", "status")])
    joined = old.join(new, key, "full")
    stronger = F.coalesce(F.col("confidence") > F.col("o_confidence"), F.col("o_confidence").isNull())
    return joined.select(
        *key, F.coalesce("o_value", "value").alias("value"), F.coalesce("o_evidence_id", "evidence_id").alias("evidence_id"),
        F.greatest("confidence", "o_confidence").alias("confidence"),
        F.when(stronger, F.col("engine")).otherwise(F.col("o_engine")).alias("engine"),
        F.when(stronger, F.col("snippet")).otherwise(F.col("o_snippet")).alias("snippet"),
        (F.coalesce("mention_count", F.lit(0)) + F.coalesce("o_mention_count", F.lit(0))).alias("mention_count"),
        F.coalesce("o_status", F.lit("pending")).alias("status"),
    )


def fold_relations(found: DataFrame) -> DataFrame:
    """One row for (case_id, src, dst, edge_type): the first wins, a later date fills a missing one; loops are dropped.

    First is the smallest relation_id, then the smallest confidence and date, so that the order of rows doesn't matter.
    """
    ends = found.filter("src <> dst")
    cols = ("evidence_id", "confidence", "status", "snippet")
    order = F.struct("relation_id", "confidence", F.coalesce("valid_from", F.lit("9999-12-31").cast("date")))
    return ends.groupBy("case_id", "src", "dst", "edge_type").agg(
        F.min("relation_id").alias("relation_id"),
        *[F.min_by(c, order).alias(c) for c in cols],
        F.min_by("valid_from", F.when(F.col("valid_from").isNotNull(), order)).alias("valid_from"),
    )


def upsert_relations(stored_rows: DataFrame, found: DataFrame) -> DataFrame:
    """The stored relations with a batch folded in: a stored row stays as it is, but a missing date is filled; others are new."""
    key = ["case_id", "src", "dst", "edge_type"]
    new = fold_relations(found)
    cols = [c for c in new.columns if c not in key]
    old = stored_rows.select(*key, *[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("o_there"))
    joined = old.join(new, key, "full")
    kept = [F.when(F.col("o_there"), F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in cols if c != "valid_from"]
    return joined.select(*key, *kept, F.coalesce("o_valid_from", "valid_from").alias("valid_from"))


def resolve_ends(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Relations given by (type, normalized) ends get registry ids; rows with an unknown or equal end are dropped."""
    ids = registry.select("case_id", "node_type", "normalized", "entity_id")
    for end in ("src", "dst"):
        named = ids.select("case_id", F.col("node_type").alias(f"{end}_type"), F.col("normalized").alias(end), F.col("entity_id").alias(f"{end}_id"))
        found = found.join(named, ["case_id", f"{end}_type", end])
    return found.filter("src_id <> dst_id")


def confirmed_graph(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): confirmed rows, and of edges those with both ends confirmed."""
    nodes = entities.filter("status = 'confirmed'")
    keys = nodes.select("key")
    edges = relations.filter("status = 'confirmed'")
    edges = edges.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return nodes, edges


def vocabulary_check(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with a reason): a value must be one of those allowed."""
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return rows.filter(ok), rows.filter(~ok).withColumn("reason", F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))


def decide(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status from the latest decision (entity_id, status, ts) for each row; undecided rows keep theirs."""
    last = decisions.groupBy("entity_id").agg(F.max_by("status", "ts").alias("decided"))
    return registry.join(last, "entity_id", "left").withColumn("status", F.coalesce("decided", "status")).drop("decided")


def merge_survivors(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entity_id, survivor_id) for every entity of approved pairs (a_id, b_id).

    Chains merge as a whole: of each connected component the row with the most mentions survives, then the most
    confident, then the smallest id.
    """
    groups = connected_components(pairs, "a_id", "b_id").withColumnRenamed("node", "entity_id")
    ranked = groups.join(entities.select("entity_id", "mention_count", "confidence"), "entity_id")
    best = ranked.groupBy("component").agg(F.max_by("entity_id", F.struct("mention_count", "confidence", -F.col("entity_id"))).alias("survivor_id"))
    return stored(groups.join(best, "component").select("entity_id", "survivor_id"), "survivors")


def merge_entities(entities: DataFrame, survivors: DataFrame) -> DataFrame:
    """Survivors carry the component's mentions; the others are `merged`, with a pointer."""
    total = entities.join(survivors, "entity_id").groupBy("survivor_id").agg(F.sum("mention_count").alias("total")).withColumnRenamed("survivor_id", "entity_id")
    rows = entities.join(survivors, "entity_id", "left").join(total, "entity_id", "left")
    gone = F.col("survivor_id").isNotNull() & (F.col("survivor_id") != F.col("entity_id"))
    return rows.select(
        *[c for c in entities.columns if c not in ("mention_count", "status")],
        F.coalesce("total", "mention_count").cast("int").alias("mention_count"),
        F.when(gone, "merged").otherwise(F.col("status")).alias("status"), F.when(gone, F.col("survivor_id")).alias("merged_into"),
    )


def repoint_relations(relations: DataFrame, survivors: DataFrame) -> DataFrame:
    """Relations (src_id, dst_id, edge_type, confidence, snippet) moved to survivors; loops go, clashes keep the most confident."""
    for end in ("src_id", "dst_id"):
        to = survivors.select(F.col("entity_id").alias(end), F.col("survivor_id").alias("to"))
        relations = relations.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    key = ["case_id", "src_id", "dst_id", "edge_type"]
    ranked = relations.filter("src_id <> dst_id").withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("confidence"), "relation_id")))
    return ranked.filter("rank = 1").drop("rank")
