"""Row scope: what a user may see comes first in every query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators.components import broadcast_up_to

#: Cases and users up to which they are broadcast.
BROADCAST_ROWS = 100_000


def visible_cases(cases: DataFrame, assignments: DataFrame, user_id: int, supervisor: bool = False) -> DataFrame:
    """case_id of the cases a user owns or is assigned to; a supervisor sees all."""
    if supervisor:
        return cases.select("case_id").distinct()
    owned = cases.filter(F.col("owner_id") == user_id).select("case_id")
    return owned.union(assignments.filter(F.col("user_id") == user_id).select("case_id")).distinct()


def scoped(rows: DataFrame, visible: DataFrame) -> DataFrame:
    return rows.join(visible, "case_id", "left_semi")


def visibility(cases: DataFrame, assignments: DataFrame) -> DataFrame:
    """(user_id, case_id) for everyone but supervisors."""
    return cases.select(F.col("owner_id").alias("user_id"), "case_id").union(assignments.select("user_id", "case_id")).distinct()


def permissions(cases: DataFrame, assignments: DataFrame, users: DataFrame) -> DataFrame:
    """users (user_id, supervisor) with the cases they have a part in: can_view, can_edit, can_contribute.

    Owners and edit or admin assignments edit; contributing is editing by someone who is no supervisor. A supervisor
    has one row, whose null case stands for all cases.
    """
    owned = cases.select("case_id", F.col("owner_id").alias("user_id"), F.lit("owner").alias("part"))
    held = owned.unionByName(assignments.select("case_id", "user_id", F.col("permission").alias("part")))
    edits = F.bool_or(F.col("part").isin("owner", "edit", "admin"))
    known = broadcast_up_to(users, BROADCAST_ROWS)
    own = held.join(known.filter("not supervisor").select("user_id"), "user_id").groupBy("user_id", "case_id").agg(F.lit(True).alias("can_view"), edits.alias("can_edit"), edits.alias("can_contribute"))
    yes = F.lit(True)
    every = users.filter("supervisor").select("user_id", F.lit(None).cast(cases.schema["case_id"].dataType).alias("case_id"), yes.alias("can_view"), yes.alias("can_edit"), F.lit(False).alias("can_contribute"))
    return own.unionByName(every)
