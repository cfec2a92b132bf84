"""Places within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.operators.components import stored


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place (from 1, without gaps) within their group; rows that tie in all of order share a task.

    Rows are dealt by ranges of group and order, so that a hot group takes several tasks. Each task counts its own groups'
    rows; the few counts are summed up and added. A null group is a group. No order by a window over the rows is made.
    """
    by = [*map(F.col, group), *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    counts = dealt.groupBy("_part", *group).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    #: A row for each task and group in it.
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_from", before.alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_part") == F.col("_p"))
    return dealt.join(offsets, same).withColumn(name, F.col("_at") - F.col("_from") + 1 + F.col("_before")).select(*rows.columns, name)
