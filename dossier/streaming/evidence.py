"""Evidence as it arrives: the stages from text to chunks, the registry kept up to date, and indexing again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, ArithmeticException, IllegalArgumentException, NumberFormatException, PythonException, SparkRuntimeException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dossier.operators import resolve, retrieval
from dossier.operators import text as X
from dossier.streaming.registry import RegistryStore


def readable(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence with text, quarantined rows with the error): a row that cannot be read does not fail its batch."""
    error = F.when(F.col("evidence_id").isNull(), "no id").when(F.col("case_id").isNull(), "no case").when(F.col("text").isNull(), "no text").when(~F.is_valid_utf8("text"), "not UTF-8")
    rows = evidence.withColumn("error", error)
    return rows.filter("error is null").drop("error"), rows.filter("error is not null")


def process_evidence(evidence: DataFrame) -> dict[str, DataFrame]:
    """entities, relations, suggestions, chunks and quarantine of evidence (evidence_id, case_id, text)."""
    good, bad = readable(evidence)
    found = X.extract_entities(good)
    ids = found.withColumn("entity_id", F.xxhash64("case_id", "node_type", "normalized")).select("case_id", "node_type", "normalized", "entity_id").distinct()
    return {"entities": found, "relations": X.extract_relations(good, found), "suggestions": resolve.suggestions(ids), "chunks": retrieval.chunks(good), "quarantine": bad}


def sightings(found: DataFrame) -> DataFrame:
    """Extracted entities as the registry folds them; the order of arrival is that of evidence."""
    return found.select("case_id", "node_type", "normalized", "value", "evidence_id", "confidence", "engine", F.col("value").alias("snippet"), F.col("evidence_id").alias("seen"))


def linked(relations: DataFrame) -> DataFrame:
    """Extracted relations as the registry folds them; a relation's number is its evidence's, its ends are types and names."""
    end = lambda e: F.concat_ws(":", F.col(f"{e}_type"), F.col(e))
    return relations.select("case_id", end("src").alias("src"), end("dst").alias("dst"), "edge_type", F.col("evidence_id").alias("relation_id"), "evidence_id", "confidence", F.lit("pending").alias("status"), "snippet", "valid_from")


def evidence_stream(evidence: DataFrame, store: RegistryStore, out: str, checkpoint: str) -> StreamingQuery:
    """Runs every stage on each micro-batch of a stream of evidence; tables of the stages are written by batch under `out`.

    A stage reads what earlier ones have written, so that text is extracted once. A stage that fails for its data does not
    fail the batch: its error goes to the table `errors` (stage, error), later stages go on with what there is, and the
    registry takes nothing from a failed stage. Other errors, as of lost storage, still end the query.
    """
    spark = store.spark

    def batch(rows: DataFrame, number: int) -> None:
        failed: list[tuple[str, str]] = []
        place = lambda name: f"{out}/{name}/batch={number}"

        def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame | None:
            try:
                df = make()
                df.write.mode("overwrite").parquet(place(name))
                return spark.read.schema(df.schema).parquet(place(name))
            except (AnalysisException, NumberFormatException, ArithmeticException, SparkRuntimeException, PythonException, IllegalArgumentException) as e:
                failed.append((name, f"{type(e).__name__}: {str(e)[:500]}"))
                return None

        good, bad = readable(rows)
        stage("quarantine", lambda: bad)
        good = stage("readable", lambda: good)
        found = stage("entities", lambda: X.extract_entities(good)) if good is not None else None
        if found is not None:
            ids = found.withColumn("entity_id", F.xxhash64("case_id", "node_type", "normalized")).select("case_id", "node_type", "normalized", "entity_id").distinct()
            links = stage("relations", lambda: X.extract_relations(good, found))
            stage("suggestions", lambda: resolve.suggestions(ids))
        if good is not None:
            stage("chunks", lambda: retrieval.chunks(good))
        nothing = X.extract_entities(spark.createDataFrame([], "evidence_id long, case_id int, text string"))
        store.apply(sightings(nothing if found is None else found), number)
        store.link(linked(X.extract_relations(spark.createDataFrame([], "evidence_id long, case_id int, text string"), nothing) if found is None or links is None else links), number)
        spark.createDataFrame(failed, "stage string, error string").write.mode("overwrite").parquet(place("errors"))

    return evidence.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reindex(evidence: DataFrame, path: str, case_id: int | None = None) -> None:
    """Chunks of all cases, or of one, written anew under path by case; other cases' chunks stay, and running it again changes nothing."""
    rows = evidence if case_id is None else evidence.filter(F.col("case_id") == case_id)
    retrieval.chunks(rows).repartition("case_id", F.pmod(F.xxhash64("evidence_id"), F.lit(32))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(path)
