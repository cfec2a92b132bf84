"""Queries over cases, entities and relations, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.operators import graph as G
from dossier.operators import registry as R
from dossier.operators import rollups as A
from dossier.operators import scope as S
from dossier.plans.common import register
from dossier.sources import domain as D
from dossier.sources.domain import CASES_SQL, ENTITIES_SQL, RELATIONS_SQL, graph_sql, table, with_sql

USER = 3
QUERIES: dict = {}
ORACLE_SQL: dict = {}
ALL = (CASES_SQL, ENTITIES_SQL)
VISIBLE = f"visible as (select case_id from cases where owner_id = {USER} union select case_id from assignments where user_id = {USER})"
EVIDENCE_SQL = "evidence as (select o_orderkey evidence_id, c_nationkey case_id, o_orderdate created_at, case o_orderstatus when 'F' then 'done' when 'O' then 'pending' else 'processing' end extraction_status from orders join customer on o_custkey = c_custkey)"


def query(sql: str, dates: tuple[str, ...] = ()):
    """Register a query and its SQL; dates are given as text, which compares alike in both engines."""
    return register(QUERIES, ORACLE_SQL, sql, dates)


def evidence(spark, sf_dir):
    """An evidence file an order: its status stands for how far its extraction is."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("evidence_id"), F.col("c_nationkey").alias("case_id"), F.col("o_orderdate").alias("created_at"), status.alias("extraction_status"))


def seen(spark, sf_dir):
    return S.visible_cases(D.cases(spark, sf_dir), D.assignments(spark, sf_dir), USER)


@query(with_sql(*ALL, VISIBLE) + """
select node_type, normalized, arg_max(value, struct_pack(c := confidence, i := -entity_id)) as value, max(confidence) confidence, count(distinct e.case_id) case_count,
  array_to_string(list_sort(list(distinct fir_no))[1:10], ',') firs, round(least(count(distinct e.case_id) / 4.0, 1.0), 3)::double strength
from entities e join visible v on e.case_id = v.case_id join cases c on c.case_id = e.case_id where e.status <> 'rejected' group by node_type, normalized having count(distinct e.case_id) >= 2""")  # fmt: skip
def shared_entities(spark, sf_dir):
    """A5 after F1: what several visible cases share."""
    own = S.scoped(D.entities(spark, sf_dir), seen(spark, sf_dir))
    return A.shared_entities(own, D.cases(spark, sf_dir), limit=None)


@query(with_sql(*ALL) + """
select node_type, normalized, count(distinct case_id) cases from entities where status <> 'rejected' group by 1, 2""")  # fmt: skip
def cross_case_counts(spark, sf_dir):
    return A.cross_case_counts(D.entities(spark, sf_dir))


@query(with_sql(CASES_SQL) + """,
held as (select owner_id user_id, case_id from cases union select user_id, case_id from assignments) select user_id::int user_id, case_id from held""")  # fmt: skip
def visible_cases(spark, sf_dir):
    return S.visibility(D.cases(spark, sf_dir), D.assignments(spark, sf_dir)).select(F.col("user_id").cast("int"), "case_id")


@query(with_sql(CASES_SQL) + f""",
users as (select (c_custkey % {D.USERS})::int user_id, bool_or(c_custkey % {D.USERS} = {D.SUPERVISOR}) supervisor from customer group by 1),
held as (select owner_id::int user_id, case_id, 'owner' part from cases union select user_id, case_id, permission from assignments)
select h.user_id, case_id, true can_view, bool_or(part in ('owner', 'edit', 'admin')) can_edit, bool_or(part in ('owner', 'edit', 'admin')) can_contribute
from held h join users u on u.user_id = h.user_id where not supervisor group by 1, 2 union all select user_id, null, true, true, false from users where supervisor""")  # fmt: skip
def permissions(spark, sf_dir):
    users = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % D.USERS).cast("int").alias("user_id")).agg(F.bool_or(F.col("c_custkey") % D.USERS == D.SUPERVISOR).alias("supervisor"))
    c = D.cases(spark, sf_dir).withColumn("owner_id", F.col("owner_id").cast("int"))
    return S.permissions(c, D.assignments(spark, sf_dir), users)


@query(with_sql(*ALL, VISIBLE, EVIDENCE_SQL) + """
select (select count(*) from cases join visible using (case_id)) total_cases, (select count(*) from cases join visible using (case_id) where status <> 'closed') active_cases,
  (select count(*) from cases join visible using (case_id) where risk_level = 'high') high_risk, (select count(*) from evidence join visible using (case_id)) files,
  (select count(*) from evidence join visible using (case_id) where extraction_status in ('pending', 'processing')) files_pending,
  (select count(*) from entities join visible using (case_id)) entities, (select count(*) from entities join visible using (case_id) where status = 'pending') entities_pending""")  # fmt: skip
def dashboard(spark, sf_dir):
    v = seen(spark, sf_dir)
    return A.dashboard(S.scoped(D.cases(spark, sf_dir), v), S.scoped(evidence(spark, sf_dir), v), S.scoped(D.entities(spark, sf_dir), v))


@query(with_sql(*ALL, RELATIONS_SQL, EVIDENCE_SQL) + """
select c.case_id, fir_no, status, coalesce(e.n, 0) n_evidence, coalesce(x.n, 0) n_entities, coalesce(r.n, 0) n_relations, coalesce(a.n, 0) n_assignments
from cases c left join (select case_id, count(*) n from evidence group by 1) e on e.case_id = c.case_id left join (select case_id, count(*) n from entities group by 1) x on x.case_id = c.case_id
left join (select case_id, count(*) n from relations group by 1) r on r.case_id = c.case_id left join (select case_id, count(*) n from assignments group by 1) a on a.case_id = c.case_id""")  # fmt: skip
def annotated_cases(spark, sf_dir):
    c = D.cases(spark, sf_dir).select("case_id", "fir_no", "status")
    return A.annotated_cases(c, evidence=evidence(spark, sf_dir), entities=D.entities(spark, sf_dir), relations=D.relations(spark, sf_dir), assignments=D.assignments(spark, sf_dir))


@query(with_sql(*ALL, RELATIONS_SQL, EVIDENCE_SQL) + """
select c.case_id, coalesce(x.n, 0) > 0 has_entities, coalesce(r.n, 0) > 0 has_relations, (coalesce(x.n, 0) > 0)::int + (coalesce(r.n, 0) > 0)::int done, coalesce(f.n, 0) files_read
from cases c left join (select case_id, count(*) n from evidence where extraction_status = 'done' group by 1) f on f.case_id = c.case_id left join (select case_id, count(*) n from entities group by 1) x on x.case_id = c.case_id left join (select case_id, count(*) n from relations group by 1) r on r.case_id = c.case_id""")  # fmt: skip
def case_progress(spark, sf_dir):
    read = evidence(spark, sf_dir).filter("extraction_status = 'done'")
    c = A.annotated_cases(D.cases(spark, sf_dir).select("case_id"), entities=D.entities(spark, sf_dir), relations=D.relations(spark, sf_dir), read=read)
    return A.progress(c, ["entities", "relations"]).drop("n_entities", "n_relations").withColumnRenamed("n_read", "files_read")


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL) + "select edge_type, count(*) n from relations where status <> 'rejected' group by 1")
def relation_histogram(spark, sf_dir):
    return A.relation_histogram(D.relations(spark, sf_dir))


@query(with_sql(ENTITIES_SQL) + "select case node_type when 'Organization' then 'org' else lower(node_type) end kind, count(*) n from entities group by 1")
def node_kinds(spark, sf_dir):
    return A.node_kinds(D.entities(spark, sf_dir))


@query(with_sql(CASES_SQL) + "select distinct district from cases where district <> ''")
def district_list(spark, sf_dir):
    return A.districts(D.cases(spark, sf_dir))


@query(with_sql(CASES_SQL) + """select district, 'total' part, 'all' as value, count(*) n from cases group by district union all
select district, 'status', status, count(*) from cases group by district, status union all select district, 'risk', risk_level, count(*) from cases group by district, risk_level""")  # fmt: skip
def district_overview(spark, sf_dir):
    return A.district_overview(D.cases(spark, sf_dir))


@query(with_sql(*ALL, EVIDENCE_SQL) + """select district, count(*) cases, sum(coalesce(x.n, 0))::bigint entities, sum(coalesce(e.n, 0))::bigint evidence, any_value(r_regionkey * 10.0)::double lat, any_value(r_regionkey * 20.0)::double lng, any_value(r_regionkey) is not null located
from cases c left join (select * from region where r_regionkey % 2 = 0) on lower(r_name) = lower(district) left join (select case_id, count(*) n from entities group by 1) x on x.case_id = c.case_id left join (select case_id, count(*) n from evidence group by 1) e on e.case_id = c.case_id group by district""")  # fmt: skip
def district_map(spark, sf_dir):
    """The districts are regions, which the gazetteer lacks: those of even numbers are added to it, the others are counted without a place."""
    r = table(spark, sf_dir, "region").filter("r_regionkey % 2 = 0")
    placed = r.select(F.lower("r_name").alias("name"), (F.col("r_regionkey") * 10.0).alias("lat"), (F.col("r_regionkey") * 20.0).alias("lng"))
    return A.district_map(D.cases(spark, sf_dir), D.entities(spark, sf_dir), evidence(spark, sf_dir), D.gazetteer(spark).unionByName(placed))


@query(with_sql(*ALL) + """,
active as (select * from cases where status not in ('closed', 'archived')),
roles as (select owner_id::bigint user_id, case_id from active union all select user_id, case_id from assignments join active using (case_id)),
p as (select owner_id::bigint user_id, count(*) pending from entities e join cases c on c.case_id = e.case_id where e.status = 'pending' group by 1)
select coalesce(r.user_id, p.user_id)::int user_id, coalesce(n, 0) active_cases, coalesce(pending, 0) pending_reviews from (select user_id, count(*) n from roles group by 1) r full join p on p.user_id = r.user_id""")  # fmt: skip
def workload(spark, sf_dir):
    return A.workload(D.cases(spark, sf_dir), D.assignments(spark, sf_dir), D.entities(spark, sf_dir)).withColumn("user_id", F.col("user_id").cast("int"))


@query(with_sql(CASES_SQL, EVIDENCE_SQL) + "select date_trunc('week', created_at)::date as week_, count(*) n from evidence group by 1 order by 1 limit 26", ("week_",))
def weekly_growth(spark, sf_dir):
    """A feature limit: the first 26 weeks."""
    return A.weekly_growth(evidence(spark, sf_dir)).withColumnRenamed("week", "week_")


@query(with_sql(CASES_SQL) + """select user_id::int user_id, count(distinct case_id) cases from (select owner_id user_id, case_id from cases union all select user_id, case_id from assignments) group by 1""")
def team_matrix(spark, sf_dir):
    return A.team_matrix(D.cases(spark, sf_dir), D.assignments(spark, sf_dir)).withColumn("user_id", F.col("user_id").cast("int"))


@query(with_sql(*ALL, VISIBLE) + """select c.case_id, fir_no, title, coalesce(n, 0) pending from cases c join visible v on v.case_id = c.case_id
left join (select case_id, count(*) n from entities where status = 'pending' group by 1) p on p.case_id = c.case_id""")  # fmt: skip
def multi_case_summary(spark, sf_dir):
    return A.summary(S.scoped(D.cases(spark, sf_dir), seen(spark, sf_dir)), D.entities(spark, sf_dir))


@query(with_sql(ENTITIES_SQL) + """,live as (select * from entities where status <> 'rejected'),
met as (select b.case_id, b.node_type, b.normalized, b.confidence from live b join (select distinct node_type, normalized from live where case_id = 7) a on a.node_type = b.node_type and a.normalized = b.normalized where b.case_id <> 7)
select case_id, count(distinct (node_type, normalized)) shared, arg_max(normalized, struct_pack(c := confidence, n := normalized)) top_signal from met group by 1 order by shared desc, case_id limit 12""")  # fmt: skip
def linked_cases(spark, sf_dir):
    """A feature limit: the twelve cases that share most with case 7."""
    return A.linked_cases(D.entities(spark, sf_dir), 7)


@query("""with f as (select 'audit' kind, ts, event_id id, event_type message from events where event_type = 'view' order by ts desc, id limit 50),
t as (select 'task' kind, ts, event_id id, event_type message from events where event_type = 'purchase' order by ts desc, id limit 20),
c as (select 'comment' kind, ts, event_id id, event_type message from events where event_type = 'click' order by ts desc, id limit 20)
select * from (select * from f union all select * from t union all select * from c) order by ts desc, kind, id limit 50""")  # fmt: skip
def activity_feed(spark, sf_dir):
    """A feature limit: the newest 50 of three capped feeds."""
    e = table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("message"))
    return A.activity_feed(e.filter("message = 'view'"), e.filter("message = 'purchase'"), e.filter("message = 'click'"))


@query("""select event_id, user_id, ts from (select event_id, user_id, ts, row_number() over (partition by user_id order by ts desc, event_id) r from events) where r <= 20""")
def risk_history(spark, sf_dir):
    """A14's rule, the newest 20 reports of each key, over the event feed."""
    return A.latest(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 20, "event_id")


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL) + """, firsts as (select node_type, normalized, min(entity_id) one from entities group by 1, 2),
q as (select 'entities' queue, case_id, entity_id id from entities where status = 'pending' union all select 'relations', case_id, relation_id from relations where status = 'pending'
  union all select 'matches', case_id, entity_id from entities join firsts using (node_type, normalized) where status = 'pending' and entity_id <> one),
n as (select queue, count(*) total from q group by 1)
select case_id, id, q.queue, total from (select *, row_number() over (partition by queue order by id) r from q) q join n on n.queue = q.queue where r <= 50""")  # fmt: skip
def review_queue(spark, sf_dir):
    """A feature limit: the first 50 of each queue, with the whole queue's total. Matches are of an entity and its name's first one."""
    e, r = D.entities(spark, sf_dir), D.relations(spark, sf_dir)
    first = e.groupBy("node_type", "normalized").agg(F.min("entity_id").alias("first"))
    matches = e.join(first, ["node_type", "normalized"]).filter("entity_id <> first")
    queue = lambda rows, key: rows.select("case_id", F.col(key).alias("id"), "status")
    return A.pending_queue({"entities": queue(e, "entity_id"), "relations": queue(r, "relation_id"), "matches": queue(matches, "entity_id")})


@query(with_sql(ENTITIES_SQL) + "select entity_id, value, status from entities where case_id = 7 and status = 'pending' order by entity_id limit 50 offset 10")
def review_page(spark, sf_dir):
    """A feature limit: a page of 50."""
    rows = D.entities(spark, sf_dir).filter("case_id = 7 and status = 'pending'").select("entity_id", "value", "status")
    return A.page(rows, "entity_id", 50, 10)[0]


@query(with_sql(CASES_SQL) + "select case_id, fir_no, title from cases where status = 'open' and (contains(lower(fir_no), 'a') or contains(lower(title), 'a'))")
def case_search(spark, sf_dir):
    return A.case_search(D.cases(spark, sf_dir), "A", status="open").select("case_id", "fir_no", "title")


@query(with_sql(ENTITIES_SQL) + "select entity_id, value, confidence from entities where status <> 'rejected' and (contains(lower(value), '0042') or contains(normalized, '0042'))")
def entity_lookup(spark, sf_dir):
    return A.entity_lookup(D.entities(spark, sf_dir), "0042").select("entity_id", "value", "confidence")


@query(with_sql(ENTITIES_SQL) + "select entity_id, value, confidence, row_number() over (order by confidence desc, entity_id) place from entities where status <> 'rejected' and (contains(lower(value), 'pune') or contains(normalized, 'pune')) order by confidence desc, entity_id limit 25")
def entity_lookup_page(spark, sf_dir):
    """A feature limit: the 25 most confident."""
    found = A.entity_lookup(D.entities(spark, sf_dir), "Pune", 25)
    return found.withColumn("place", F.row_number().over(W.orderBy(F.desc("confidence"), "entity_id"))).select("entity_id", "value", "confidence", "place")  # 25 rows


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL) + """, own as (select min(key) as key from entities where node_type = 'Organization')
select relation_id, src, dst, edge_type, confidence, evidence_id from relations r, own where r.src = own.key or r.dst = own.key order by confidence desc, relation_id limit 100""")  # fmt: skip
def evidence_trail(spark, sf_dir):
    """A feature limit: the 100 most confident relations of one entity."""
    e = D.entities(spark, sf_dir)
    key = e.filter("node_type = 'Organization'").agg(F.min("key").alias("key")).first()["key"]
    return G.evidence_trail(e, D.relations(spark, sf_dir), key)


@query(with_sql(ENTITIES_SQL) + "select entity_id, case when entity_id % 4 = 0 then 'confirmed' when entity_id % 4 = 1 then 'rejected' else status end status from entities")
def review_decisions(spark, sf_dir):
    e = D.entities(spark, sf_dir).select("entity_id", "status")
    made = e.filter("entity_id % 4 < 2").select("entity_id", F.when(F.col("entity_id") % 4 == 0, "confirmed").otherwise("rejected").alias("status"), F.lit(2).alias("ts"))
    earlier = made.select("entity_id", F.lit("pending").alias("status"), F.lit(1).alias("ts"))
    return R.decide(e, made.unionByName(earlier))


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL) + "select case_id, src, dst, edge_type, relation_id, evidence_id, confidence, status, snippet, valid_from from relations", ("valid_from",))
def relation_registry(spark, sf_dir):
    return D.relations(spark, sf_dir)


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL) + """, f as (select *, k[2] node_type, k[3] normalized from (select *, string_split(src, ':') k from mentions))
select case_id, node_type, normalized, min(evidence_id) evidence_id, max(confidence) confidence, count(distinct evidence_id) mention_count from f group by 1, 2, 3""")  # fmt: skip
def entity_registry(spark, sf_dir):
    m = D.mentions(spark, sf_dir)
    parts = F.split("src", ":")
    found = m.select(
        "case_id", parts[1].alias("node_type"), parts[2].alias("normalized"), parts[2].alias("value"), "evidence_id", "confidence", F.lit("pattern").alias("engine"), "snippet",
        F.col("evidence_id").alias("seen"),
    )
    return R.fold_entities(found).select("case_id", "node_type", "normalized", "evidence_id", "confidence", "mention_count")


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL, graph_sql()) + "select src, dst, edge_type, case_id, confidence from edges")
def confirmed_edges(spark, sf_dir):
    return D.graph(spark, sf_dir)[1].select("src", "dst", "edge_type", "case_id", "confidence")


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL, graph_sql()) + """, t as (select * from nodes where node_type in ('Person', 'Organization') and confidence >= 0.3)
select src, dst, edge_type, valid_from, e.confidence from edges e join t a on a.key = src join t b on b.key = dst where e.confidence >= 0.3 and (valid_from is null or valid_from between date '1993-01-01' and date '1995-12-31')""", ("valid_from",))  # fmt: skip
def filtered_subgraph(spark, sf_dir):
    n, e = D.graph(spark, sf_dir)
    return G.subgraph(n, e, ("Person", "Organization"), 0.3, "1993-01-01", "1995-12-31")[1].select("src", "dst", "edge_type", "valid_from", "confidence")


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL, graph_sql()) + """select e.case_id, valid_from, edge_type, a.value src_value, b.value dst_value, e.confidence from edges e join nodes a on a.key = src join nodes b on b.key = dst where valid_from is not null""", ("valid_from",))
def timeline(spark, sf_dir):
    return G.timeline(*D.graph(spark, sf_dir))


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL, graph_sql()) + """select case edge_type when 'CALLED' then 'communication' when 'TRANSFERRED_MONEY_TO' then 'financial' when 'PRESENT_AT' then 'movement' when 'OWNS' then 'ownership' else 'other' end category, count(*) n from edges where valid_from is not null group by 1""")
def timeline_categories(spark, sf_dir):
    e = D.graph(spark, sf_dir)[1].filter("valid_from is not null")
    return e.groupBy(G.timeline_category().alias("category")).agg(F.count("*").alias("n"))


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL, graph_sql()) + "select case_id, count(*) n, min(valid_from) as first, max(valid_from) as last from edges where valid_from is not null group by 1", ("first", "last"))
def timeline_range(spark, sf_dir):
    return G.timeline_range(D.graph(spark, sf_dir)[1])


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL, graph_sql(), "ends as materialized (select k, count(*) n from (select src k from edges union all select dst from edges) group by 1)") + "select key, case_id, coalesce(n, 0) degree from nodes left join ends on k = key")
def degrees(spark, sf_dir):
    return G.degrees(*D.graph(spark, sf_dir))


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL) + """select src, dst, valid_from, confidence from (select *, row_number() over (partition by src order by valid_from desc nulls last, relation_id) r from relations where edge_type = 'PRESENT_AT') where r = 1""", ("valid_from",))
def latest_presence(spark, sf_dir):
    return G.latest_presence(D.relations(spark, sf_dir)).select("src", "dst", "valid_from", "confidence")


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL) + """select case_id, src, dst, valid_from, confidence from (select *, row_number() over (partition by src, dst, valid_from order by confidence desc, relation_id) r from mentions where edge_type = 'PRESENT_AT' and valid_from is not null) where r = 1""", ("valid_from",))
def trails(spark, sf_dir):
    return G.trail(D.mentions(spark, sf_dir))


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL) + """select src || '->' || edge_type || '->' || dst edge_id, case when confidence >= 0.5 then 'removed' else 'added' end change, confidence from relations where (confidence >= 0.5 and confidence < 0.6) or confidence < 0.1""")
def snapshot_diff(spark, sf_dir):
    e = G.edge_id(D.relations(spark, sf_dir)).select("edge_id", "confidence")
    return G.snapshot_diff(e.filter("confidence >= 0.5"), e.filter("confidence >= 0.6 or confidence < 0.1"), "edge_id")


@query(with_sql(ENTITIES_SQL) + "select key, case when confidence >= 0.5 then 'removed' else 'added' end change, value, confidence from entities where (confidence >= 0.5 and confidence < 0.6) or confidence < 0.1")
def snapshot_node_diff(spark, sf_dir):
    n = D.entities(spark, sf_dir).select("key", "value", "confidence")
    return G.snapshot_diff(n.filter("confidence >= 0.5"), n.filter("confidence >= 0.6 or confidence < 0.1"), "key")


ALLOWED = ("view", "click", "purchase")


@query(f"select event_id, case when event_type in {ALLOWED} then 'accepted' else 'unknown event_type: ' || coalesce(event_type, 'null') end outcome from events")
def vocabulary(spark, sf_dir):
    """The event feed against a vocabulary: what is not in it is kept apart with a reason."""
    good, bad = R.vocabulary_check(table(spark, sf_dir, "events"), "event_type", ALLOWED)
    return good.select("event_id", F.lit("accepted").alias("outcome")).unionByName(bad.select("event_id", F.col("reason").alias("outcome")))
