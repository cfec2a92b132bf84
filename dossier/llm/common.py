"""Helpers that the training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.components import broadcast_up_to, shared_dir, stored

__all__ = ["ascii_lower", "bounded_batches", "broadcast_up_to", "forest", "shared_dir", "stored", "table"]

#: Rows of text that Spark hands to Python at once: whole texts may be long, and a batch is held in memory.
BATCH_ROWS = 500

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII text takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on hands Python tasks at most BATCH_ROWS rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (first member, other) of each component of a symmetric relation."""
    left, out = np.ones(len(links), bool), []
    for i in range(len(links)):
        if left[i]:
            left[i] = False
            reach = front = np.array([i])
            while len(front):
                front = np.flatnonzero(links[front].any(0) & left)
                left[front] = False
                reach = np.concatenate([reach, front])
            out += [(i, int(j)) for j in reach[1:]]
    return out
