"""Evidence packages: what a case's file holds, in tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.operators.ranking import ranked

ENTITIES, LINKS = 40, 30


def evidence_package(evidence: DataFrame, custody: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(case_id, section, place, subject, detail): manifest, custody, the most confident confirmed entities and links, hashes.

    evidence: evidence_id, case_id, file_name, size, sha256, created_at; custody: evidence_id, ts, action, actor; entities: key,
    case_id, value, node_type, confidence, status; relations: src, dst, edge_type, case_id, confidence, status, relation_id.
    A case may hold any number of files and custody rows; only the sections with a limit are ranked by a window.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def section(rows: DataFrame, name: str, subject: Column, detail: Column, order: list, most: int | None = None) -> DataFrame:
        if most is None:
            placed = ranked(rows, ["case_id"], order, "place")
        else:
            placed = rows.withColumn("place", F.row_number().over(W.partitionBy("case_id").orderBy(*order))).filter(F.col("place") <= most)
        return placed.select("case_id", F.lit(name).alias("section"), "place", text(subject).alias("subject"), text(detail).alias("detail"))

    by_time = [F.col("created_at"), F.col("evidence_id")]
    kept = custody.join(evidence.select("evidence_id", "case_id", "file_name"), "evidence_id")
    sure = lambda rows: rows.filter("status = 'confirmed'")
    return reduce(DataFrame.unionByName, [
        section(evidence, "manifest", F.col("file_name"), F.concat_ws(" ", text(F.col("size")), F.left("sha256", F.lit(20))), by_time),
        section(kept, "custody", F.col("file_name"), F.concat_ws(" ", text(F.col("ts")), "action", text(F.coalesce("actor", F.lit("pipeline")))), [F.col(c) for c in ("evidence_id", "ts", "action")]),
        section(sure(entities), "entities", F.col("value"), F.col("node_type"), [F.desc("confidence"), "key"], ENTITIES),
        section(sure(relations), "links", F.concat_ws(" ", "src", "edge_type", "dst"), F.col("confidence"), [F.desc("confidence"), "relation_id", "src", "dst", "edge_type"], LINKS),
        section(evidence, "hashes", F.col("file_name"), F.col("sha256"), by_time),
    ])
