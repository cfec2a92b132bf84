"""Rollups and lists: every function aggregates children before joining, so no fan-out needs undoing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.operators.components import broadcast_up_to

ACTIVE = ("closed", "archived")


def counts_by(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def dashboard(cases: DataFrame, evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of seven counts over tables that are already scoped: one aggregate a table."""
    c = cases.agg(F.count("*").alias("total_cases"), F.count_if(F.col("status") != "closed").alias("active_cases"), F.count_if(F.col("risk_level") == "high").alias("high_risk"))
    e = evidence.agg(F.count("*").alias("files"), F.count_if(F.col("extraction_status").isin("pending", "processing")).alias("files_pending"))
    x = entities.agg(F.count("*").alias("entities"), F.count_if(F.col("status") == "pending").alias("entities_pending"))
    return c.crossJoin(e).crossJoin(x)  # one row each


def annotated_cases(cases: DataFrame, **children: DataFrame) -> DataFrame:
    """cases with n_<child> for each child table."""
    out = cases
    for name, rows in children.items():
        out = out.join(counts_by(rows, "case_id", name=f"n_{name}"), "case_id", "left")
    return out.fillna(0, [f"n_{name}" for name in children])


def progress(annotated: DataFrame, steps: list[str]) -> DataFrame:
    """A flag for each step (its count is positive) and how many are done; a step may be one of the counts a caller adds."""
    out = annotated.withColumns({f"has_{s}": F.col(f"n_{s}") > 0 for s in steps})
    return out.withColumn("done", reduce(lambda a, b: a + b, [F.col(f"has_{s}").cast("int") for s in steps]))


def relation_histogram(relations: DataFrame) -> DataFrame:
    return counts_by(relations.filter("status <> 'rejected'"), "edge_type").orderBy(F.desc("n"), "edge_type")


def node_kinds(entities: DataFrame) -> DataFrame:
    """Counts by display kind: the type's name decides, by what it contains."""
    t = F.lower("node_type")
    kinds = [("person", "person"), ("phone", "phone"), ("vehicle", "vehicle"), ("org", "org"), ("location", "location"), ("event", "event")]
    kind = F.coalesce(*[F.when(F.contains(t, F.lit(sign)), F.lit(k)) for sign, k in kinds], F.lit("other"))
    return counts_by(entities.withColumn("kind", kind), "kind").orderBy(F.desc("n"), "kind")


def shared_entities(entities: DataFrame, cases: DataFrame, limit: int | None = 100) -> DataFrame:
    """Entities (type, normalized) of at least two cases: best row, up to ten case references, strength min(n / 4, 1)."""
    live = entities.filter("status <> 'rejected'").join(cases.select("case_id", "fir_no"), "case_id")
    found = live.groupBy("node_type", "normalized").agg(
        F.count_distinct("case_id").alias("case_count"),
        F.max_by(F.struct("value", "confidence"), F.struct("confidence", -F.col("entity_id"))).alias("best"),
        F.slice(F.array_sort(F.collect_set("fir_no")), 1, 10).alias("firs"),
    ).filter("case_count >= 2")
    out = found.select(
        "node_type", "normalized", F.col("best.value").alias("value"), F.col("best.confidence").alias("confidence"), "case_count",
        F.concat_ws(",", "firs").alias("firs"), F.round(F.least(F.col("case_count") / 4.0, F.lit(1.0)), 3).alias("strength"),
    )
    return out if limit is None else out.orderBy(F.desc("case_count"), "value", "node_type").limit(limit)


def cross_case_counts(entities: DataFrame) -> DataFrame:
    return entities.filter("status <> 'rejected'").groupBy("node_type", "normalized").agg(F.count_distinct("case_id").alias("cases"))


def district_cross_case(entities: DataFrame, cases: DataFrame, district: str, limit: int = 10) -> DataFrame:
    """The entities that most cases of a district share, the ten of most cases first."""
    own = cases.filter(F.col("district") == district)
    return shared_entities(entities.join(own.select("case_id"), "case_id", "left_semi"), own, limit)


def stage_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """(part, value, n): how many rows have each value of each column, as a stage reports them; nulls count as `none`."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns]))
    return counts_by(rows.select(parts.alias("x")).select("x.*"), "part", "value")


def audit_trail(log: DataFrame, user_id: int, supervisor: bool = False) -> DataFrame:
    """The log (user_id, ts, ...) that a user may read: all of it for supervisors, else the own entries."""
    return log if supervisor else log.filter(F.col("user_id") == user_id)


def report_list(reports: DataFrame, visible: DataFrame, case_id: int | None = None, limit: int = 50) -> DataFrame:
    """The newest reports (report_id, case_id, ts) of visible cases, or of one of them."""
    rows = reports if case_id is None else reports.filter(F.col("case_id") == case_id)
    return rows.join(visible, "case_id", "left_semi").orderBy(F.desc("ts"), F.desc("report_id")).limit(limit)


def case_links(links: DataFrame) -> DataFrame:
    """Links between cases (a, b, ...), one for each two cases whichever way it was made (the first by link_id), none of a case with itself."""
    ends = links.filter("a <> b").withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    first = F.row_number().over(W.partitionBy("low", "high").orderBy("link_id"))
    return ends.withColumn("_r", first).filter("_r = 1").drop("_r", "low", "high")


def links_of(links: DataFrame, case_ids: DataFrame) -> DataFrame:
    """(case_id, other, link_id): the links of given cases from either side."""
    both = F.explode(F.array(F.struct(F.col("a").alias("case_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("case_id"), F.col("a").alias("other"))))
    return links.select("link_id", both.alias("x")).select("x.case_id", "x.other", "link_id").join(case_ids, "case_id", "left_semi")


def linked_cases(entities: DataFrame, case_id: int, limit: int = 12) -> DataFrame:
    """Other cases that share entities with one case, and the strongest shared entity of each."""
    live = entities.filter("status <> 'rejected'").select("case_id", "node_type", "normalized", "confidence")
    own = live.filter(F.col("case_id") == case_id).select("node_type", "normalized").distinct()
    met = live.filter(F.col("case_id") != case_id).join(own, ["node_type", "normalized"])
    found = met.groupBy("case_id").agg(
        F.count_distinct("node_type", "normalized").alias("shared"), F.max_by("normalized", F.struct("confidence", "normalized")).alias("top_signal"),
    )
    return found.orderBy(F.desc("shared"), "case_id").limit(limit)


def districts(cases: DataFrame, limit: int = 100) -> DataFrame:
    return cases.filter("district <> ''").select("district").distinct().orderBy("district").limit(limit)


def district_overview(cases: DataFrame) -> DataFrame:
    """Totals by district, and by status and by risk within it, as one grouping-sets aggregate."""
    c = cases.groupingSets([["district"], ["district", "status"], ["district", "risk_level"]], "district", "status", "risk_level").agg(F.count("*").alias("n"), F.grouping("status").alias("gs"), F.grouping("risk_level").alias("gr"))
    part = F.when((F.col("gs") == 1) & (F.col("gr") == 1), "total").when(F.col("gs") == 0, "status").otherwise("risk")
    return c.select("district", part.alias("part"), F.coalesce("status", "risk_level", F.lit("all")).alias("value"), "n")


def district_map(cases: DataFrame, entities: DataFrame, evidence: DataFrame, places: DataFrame) -> DataFrame:
    """Counts by district with coordinates where the gazetteer has the district; others are counted without a place."""
    by_case = annotated_cases(cases, entities=entities, evidence=evidence)
    sums = by_case.groupBy("district").agg(F.count("*").alias("cases"), F.sum("n_entities").alias("entities"), F.sum("n_evidence").alias("evidence"))
    return sums.join(broadcast_up_to(places.select(F.col("name").alias("place"), "lat", "lng"), 100_000), F.lower("district") == F.col("place"), "left").drop("place").withColumn("located", F.col("lat").isNotNull())


def workload(cases: DataFrame, assignments: DataFrame, entities: DataFrame) -> DataFrame:
    """Active cases by user, a case counting for each role the user has in it, and pending entities in owned cases; idle users are left out."""
    active = cases.filter(~F.col("status").isin(*ACTIVE))
    roles = active.select(F.col("owner_id").alias("user_id"), "case_id").unionAll(assignments.join(active, "case_id", "left_semi").select("user_id", "case_id"))
    waiting = counts_by(entities.filter("status = 'pending'"), "case_id", name="p")
    pending = cases.select(F.col("owner_id").alias("user_id"), "case_id").join(waiting, "case_id").groupBy("user_id").agg(F.sum("p").alias("pending_reviews"))
    out = counts_by(roles, "user_id", name="active_cases").join(pending, "user_id", "full").fillna(0, ["active_cases", "pending_reviews"])
    return out.filter("active_cases + pending_reviews > 0").orderBy(F.desc("active_cases"), "user_id")


def weekly_growth(evidence: DataFrame, weeks: int = 26) -> DataFrame:
    """Files by week (from Monday), the first `weeks` of them."""
    week = F.to_date(F.date_trunc("week", "created_at")).alias("week")
    return evidence.groupBy(week).agg(F.count("*").alias("n")).orderBy("week").limit(weeks)


def latest(rows: DataFrame, per: str, ts: str, n: int, tie: str) -> DataFrame:
    """The newest n rows of each key."""
    rank = F.row_number().over(W.partitionBy(per).orderBy(F.desc(ts), tie))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def activity_feed(audits: DataFrame, tasks: DataFrame, comments: DataFrame, limit: int = 50) -> DataFrame:
    """Newest 50 audits, 20 tasks and 20 comments (ts, id, message each), the newest of all of them."""
    capped = [
        rows.orderBy(F.desc("ts"), "id").limit(n).select(F.lit(kind).alias("kind"), "ts", "id", "message")
        for kind, rows, n in (("audit", audits, 50), ("task", tasks, 20), ("comment", comments, 20))
    ]
    return reduce(DataFrame.unionByName, capped).orderBy(F.desc("ts"), "kind", "id").limit(limit)


def team_matrix(cases: DataFrame, assignments: DataFrame) -> DataFrame:
    held = cases.select(F.col("owner_id").alias("user_id"), "case_id").unionAll(assignments.select("user_id", "case_id"))
    return held.groupBy("user_id").agg(F.count_distinct("case_id").alias("cases")).orderBy("user_id")


def summary(cases: DataFrame, entities: DataFrame) -> DataFrame:
    """The visible cases with their number of pending entities."""
    return cases.select("case_id", "fir_no", "title").join(counts_by(entities.filter("status = 'pending'"), "case_id", name="pending"), "case_id", "left").fillna(0, ["pending"])


def page(rows: DataFrame, key: str, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one page in order of key, the total): limit is held to 1..500, offset to 0 and more."""
    limit, offset = max(1, min(500, limit)), max(0, offset)
    return rows.orderBy(key).offset(offset).limit(limit), rows.agg(F.count("*").alias("total"))


def pending_queue(tables: dict[str, DataFrame], limit: int = 50) -> DataFrame:
    """Pending rows of several tables (case_id, id): each table's total and its first ids."""
    limit = max(1, min(200, limit))
    parts = []
    for name, rows in tables.items():
        pending = rows.filter("status = 'pending'")
        total = pending.agg(F.count("*").alias("total"))
        first = pending.select("case_id", "id").orderBy("id").limit(limit).withColumn("queue", F.lit(name))
        parts.append(first.crossJoin(total))  # one row
    return reduce(DataFrame.unionByName, parts)


def entity_lookup(entities: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Entities not rejected whose value or normalized name holds text, whatever the case of letters; the most confident first."""
    hit = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    found = entities.filter("status <> 'rejected'").filter(hit("value") | hit("normalized")).orderBy(F.desc("confidence"), "entity_id")
    return found if limit is None else found.limit(limit)


def case_search(cases: DataFrame, text: str = "", **equals: str) -> DataFrame:
    """Cases by exact column values and by a part of number or title, whatever the case of letters."""
    for column, value in equals.items():
        cases = cases.filter(F.col(column) == value)
    hit = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    return cases.filter(hit("fir_no") | hit("title")) if text else cases
