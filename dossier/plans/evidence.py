"""Queries over files, custody, packages, merges and feeds, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import alerts, package
from dossier.operators import registry as R
from dossier.operators import rollups as A
from dossier.operators import scope as S
from dossier.plans.common import register
from dossier.sources import domain as D
from dossier.sources import files
from dossier.sources.domain import CASES_SQL, ENTITIES_SQL, RELATIONS_SQL, table, with_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}
USER = 3
VISIBLE = f"visible as (select case_id from cases where owner_id = {USER} union select case_id from assignments where user_id = {USER})"


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    return register(QUERIES, ORACLE_SQL, sql, dates)


def documents(spark, sf_dir):
    """Documents as files: text in UTF-8, or in UTF-16 for every third."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "source", F.coalesce("text", F.lit("")).alias("text"))
    content = F.when(F.col("evidence_id") % 3 == 0, F.encode("text", "UTF-16")).otherwise(F.col("text").cast("binary"))
    return d.withColumns({"file_name": F.concat_ws("/", "source", "evidence_id"), "content": content})


@query("select doc_id evidence_id, sha256(coalesce(text, '')) sha256, source || '_' || doc_id safe_name, coalesce(text, '') <> '' ok from documents")
def ingested_files(spark, sf_dir):
    return files.ingest(documents(spark, sf_dir).withColumn("content", F.col("text").cast("binary"))).select("evidence_id", "sha256", "safe_name", "ok")


@query("select doc_id evidence_id, sha256(coalesce(text, '')) text_sha256 from documents")
def decoded_texts(spark, sf_dir):
    """What is read from either encoding is the text."""
    return documents(spark, sf_dir).select("evidence_id", F.sha2(files.decoded(F.col("content")).cast("binary"), 256).alias("text_sha256"))


@query("select doc_id evidence_id, sha256(left(coalesce(text, ''), 4000)) head_sha256 from documents")
def head_samples(spark, sf_dir):
    content = F.col("text").cast("binary")
    return documents(spark, sf_dir).select("evidence_id", F.sha2(files.sample(content, F.lit(True)).cast("binary"), 256).alias("head_sha256"))


@query("""select doc_id evidence_id, case when doc_id % 11 = 0 then 'failed' when coalesce(text, '') = '' then 'skipped' when doc_id % 2 = 0 then 'done' else 'unavailable' end status,
  case when doc_id % 11 <> 0 and coalesce(text, '') <> '' and doc_id % 2 = 0 then length(text) end n from documents""")  # fmt: skip
def text_results(spark, sf_dir):
    """Files of even numbers are text, others PDFs; every eleventh cannot be read."""
    d = documents(spark, sf_dir)
    mime = F.when(F.col("evidence_id") % 2 == 0, "text/plain").otherwise("application/pdf")
    content = F.when(F.col("evidence_id") % 11 != 0, F.col("text").cast("binary"))
    return d.select("evidence_id", files.text_result(mime, F.lit("f"), content).alias("r")).select("evidence_id", "r.status", F.char_length("r.text").cast("long").alias("n"))


@query("select doc_id evidence_id, action, source || '/' || doc_id file_name, doc_id % 5 <> 0 as \"exists\" from documents, (values ('ingested'), ('reviewed')) a(action) where action = 'ingested' or doc_id % 2 = 0")
def custody_log(spark, sf_dir):
    """Entries outlive the files: every fifth is gone."""
    d = files.ingest(documents(spark, sf_dir))
    none = d.limit(0).select("evidence_id", F.lit("").alias("actor"), F.lit("").alias("action"), F.lit(None).cast("timestamp").alias("ts"), "file_name", "sha256")
    log = files.log_custody(none, d, "ingested", "pipeline", "2024-01-01 00:00:00")
    log = files.log_custody(log, d.filter("evidence_id % 2 = 0"), "reviewed", "officer", "2024-01-02 00:00:00")
    return files.custody(log, d.filter("evidence_id % 5 <> 0")).select("evidence_id", "action", "file_name", "exists")


@query("select doc_id evidence_id, doc_id % 13 <> 0 and doc_id % 10 <> 0 intact from documents")
def integrity(spark, sf_dir):
    """Every tenth file has changed since its digest was taken, every thirteenth is missing."""
    d = documents(spark, sf_dir)
    manifest = d.select("evidence_id", F.col("file_name").alias("path"), F.sha2("content", 256).alias("sha256"))
    now = d.filter("evidence_id % 13 <> 0").select(F.col("file_name").alias("path"), F.when(F.col("evidence_id") % 10 == 0, F.concat(F.col("content"), F.lit("x").cast("binary"))).otherwise(F.col("content")).alias("content"))
    return files.integrity(manifest, now)


@query("""select evidence_id, line::int line, 'Tower ' || event_id % 7 tower, ts::date as day from (select *, event_id // 100 evidence_id, row_number() over (partition by event_id // 100 order by event_id) - 1 line from events) where event_id % 7 <> 0""", ("day",))
def call_records(spark, sf_dir):
    """The event feed as delimited files of up to a hundred rows, with blank lines between some; every seventh row has no tower."""
    e = table(spark, sf_dir, "events")
    row = F.concat_ws(",", F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit('"Tower '), (F.col("event_id") % 7).cast("string"), F.lit('"'))).otherwise(""), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    text = F.concat(row, F.when(F.col("event_id") % 5 == 0, "\r\n  \n").otherwise("\r\n"))
    one = e.groupBy(F.floor(F.col("event_id") / 100).alias("evidence_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", text.alias("text")))).alias("rows"))  # a hundred at most
    written = F.concat(F.lit("Id,TOWER_ID,Timestamp\r\n"), F.array_join(F.transform("rows", lambda r: r["text"]), ""))
    return files.cdr_rows(one.select("evidence_id", written.alias("text"))).select("evidence_id", "line", "tower", F.col("date").alias("day"))


_FOLD = """select case_id, src, dst, edge_type, min(relation_id) relation_id, arg_min(confidence, o) confidence, arg_min(valid_from, o) filter (valid_from is not null) valid_from from ordered where relation_id % 2 = {r} group by 1, 2, 3, 4"""


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL) + f""", a as ({_FOLD.format(r=0)}), b as ({_FOLD.format(r=1)})
select coalesce(a.case_id, b.case_id) case_id, coalesce(a.src, b.src) src, coalesce(a.dst, b.dst) dst, coalesce(a.edge_type, b.edge_type) edge_type, coalesce(a.relation_id, b.relation_id) relation_id,
  case when a.src is not null then a.confidence else b.confidence end confidence, coalesce(a.valid_from, b.valid_from) valid_from
from a full join b on a.case_id = b.case_id and a.src = b.src and a.dst = b.dst and a.edge_type = b.edge_type""", ("valid_from",))  # fmt: skip
def relation_upserts(spark, sf_dir):
    """Mentions of even numbers are stored, then those of odd numbers arrive."""
    m = D.mentions(spark, sf_dir)
    stored = R.fold_relations(m.filter("relation_id % 2 = 0"))
    return R.upsert_relations(stored, m.filter("relation_id % 2 = 1")).select("case_id", "src", "dst", "edge_type", "relation_id", "confidence", "valid_from")


MERGED_SQL = """best as (select node_type, normalized, arg_max(entity_id, struct_pack(m := mention_count, c := confidence, i := -entity_id)) survivor_id, sum(mention_count) total from entities where node_type <> 'Location' group by 1, 2 having count(*) > 1)"""


def approved(spark, sf_dir):
    """Entities of one name (but places) are merged: each is paired with the smallest of its name."""
    e = D.entities(spark, sf_dir)
    first = e.filter("node_type <> 'Location'").groupBy("node_type", "normalized").agg(F.min("entity_id").alias("a_id"))
    pairs = e.join(first, ["node_type", "normalized"]).filter("entity_id <> a_id").select("a_id", F.col("entity_id").alias("b_id"))
    return e, R.merge_survivors(e, pairs)


@query(with_sql(ENTITIES_SQL, MERGED_SQL) + """select entity_id, case when survivor_id = entity_id then total else mention_count end::int mention_count, case when survivor_id <> entity_id then 'merged' else status end status, case when survivor_id <> entity_id then survivor_id end merged_into
from entities left join best using (node_type, normalized)""")  # fmt: skip
def merged_entities(spark, sf_dir):
    return R.merge_entities(*approved(spark, sf_dir)).select("entity_id", "mention_count", "status", "merged_into")


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL, MERGED_SQL) + """, ids as (select key, coalesce(survivor_id, entity_id) id from entities left join best using (node_type, normalized)),
moved as (select relation_id, r.case_id, a.id src_id, b.id dst_id, edge_type, confidence from relations r join ids a on a.key = src join ids b on b.key = dst where a.id <> b.id)
select relation_id, src_id, dst_id, confidence from (select *, row_number() over (partition by case_id, src_id, dst_id, edge_type order by confidence desc, relation_id) k from moved) where k = 1""")  # fmt: skip
def repointed_relations(spark, sf_dir):
    e, survivors = approved(spark, sf_dir)
    of = lambda end: e.select(F.col("key").alias(end), F.col("entity_id").alias(f"{end}_id"))
    r = D.relations(spark, sf_dir).join(of("src"), "src").join(of("dst"), "dst")
    return R.repoint_relations(r, survivors).select("relation_id", "src_id", "dst_id", "confidence")


FILES_SQL = """ev as (select o_orderkey evidence_id, c_nationkey case_id, 'order-' || o_orderkey || '.txt' file_name, o_custkey size, sha256(o_orderkey::varchar) sha256, o_orderdate::date created_at, o_orderstatus from orders join customer on o_custkey = c_custkey),
kept as (select evidence_id, case_id, file_name, created_at ts, 'ingested' act, null who from ev union all select evidence_id, case_id, file_name, created_at + 1, 'reviewed', 'officer' from ev where o_orderstatus = 'F')"""


@query(with_sql(CASES_SQL, ENTITIES_SQL, RELATIONS_SQL, FILES_SQL) + """,
r as (select case_id, 'manifest' section, row_number() over (partition by case_id order by created_at, evidence_id) place, file_name subject, size || ' ' || left(sha256, 20) detail from ev
union all select case_id, 'custody', row_number() over (partition by case_id order by evidence_id, ts, act), file_name, ts || ' ' || act || ' ' || coalesce(who, 'pipeline') from kept
union all select case_id, 'entities', row_number() over (partition by case_id order by confidence desc, key), value, node_type from entities where status = 'confirmed'
union all select case_id, 'links', row_number() over (partition by case_id order by confidence desc, relation_id, src, dst, edge_type), src || ' ' || edge_type || ' ' || dst, confidence::varchar from relations where status = 'confirmed'
union all select case_id, 'hashes', row_number() over (partition by case_id order by created_at, evidence_id), file_name, sha256 from ev)
select * from r where (section <> 'entities' or place <= 40) and (section <> 'links' or place <= 30)""")  # fmt: skip
def evidence_package(spark, sf_dir):
    """A feature limit: forty entities and thirty links a case."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key = F.col("o_orderkey").cast("string")
    ev = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("evidence_id"), F.col("c_nationkey").alias("case_id"), F.concat(F.lit("order-"), key, F.lit(".txt")).alias("file_name"), F.col("o_custkey").alias("size"),
        F.sha2(key.cast("binary"), 256).alias("sha256"), F.to_date("o_orderdate").alias("created_at"), "o_orderstatus",
    )
    entry = lambda rows, ts, action, actor: rows.select("evidence_id", ts.alias("ts"), F.lit(action).alias("action"), F.lit(actor).cast("string").alias("actor"))
    kept = entry(ev, F.col("created_at"), "ingested", None).unionByName(entry(ev.filter("o_orderstatus = 'F'"), F.date_add("created_at", 1), "reviewed", "officer"))
    return package.evidence_package(ev, kept, D.entities(spark, sf_dir), D.relations(spark, sf_dir))


def feed(spark, sf_dir):
    """The event feed as alerts, notifications, reports and a log: its case, severity, channel and state come from its number."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("id"), (n % 25).cast("int").alias("case_id"), F.col("event_type").alias("kind"), F.when(n % 3 == 0, "high").when(n % 3 == 1, "medium").otherwise("low").alias("severity"), "ts", "user_id",
        F.when(n % 2 == 0, "app").otherwise("mail").alias("channel"), (n % 3 == 0).alias("read"),
    )


def visible(spark, sf_dir):
    return S.visible_cases(D.cases(spark, sf_dir), D.assignments(spark, sf_dir), USER)


@query(with_sql(CASES_SQL, VISIBLE) + "select event_id alert_id, event_type kind, ts from events join visible on case_id = event_id % 25 where event_id % 3 = 0 and event_type = 'click' order by ts desc, event_id desc limit 100")
def alert_feed(spark, sf_dir):
    """A feature limit: the newest hundred."""
    rows = feed(spark, sf_dir).withColumnRenamed("id", "alert_id")
    return alerts.alert_feed(rows, visible(spark, sf_dir), "click", "high").select("alert_id", "kind", "ts")


@query("select event_id notification_id, ts from events where user_id = 7 and event_id % 3 <> 0 and event_id % 2 = 0 order by ts desc, event_id desc limit 100")
def notification_feed(spark, sf_dir):
    """A feature limit: the newest hundred."""
    rows = feed(spark, sf_dir).withColumnRenamed("id", "notification_id")
    return alerts.notification_feed(rows, 7, unread=True, channel="app").select("notification_id", "ts")


@query("select event_id id, ts, event_type kind from events where user_id = 7")
def audit_trail(spark, sf_dir):
    return A.audit_trail(feed(spark, sf_dir), 7).select("id", "ts", "kind")


@query(with_sql(CASES_SQL, VISIBLE) + "select event_id report_id, event_id % 25 case_id, ts from events join visible on case_id = event_id % 25 order by ts desc, event_id desc limit 50")
def report_list(spark, sf_dir):
    """A feature limit: the newest fifty."""
    return A.report_list(feed(spark, sf_dir).withColumnRenamed("id", "report_id"), visible(spark, sf_dir)).select("report_id", F.col("case_id").cast("long").alias("case_id"), "ts")


@query(with_sql(CASES_SQL, ENTITIES_SQL) + """, own as (select case_id, fir_no from cases where district = 'EUROPE')
select node_type, normalized, count(distinct case_id) case_count, array_to_string(list_sort(list(distinct fir_no))[1:10], ',') firs from entities join own using (case_id) where status <> 'rejected' group by 1, 2 having count(distinct case_id) >= 2
order by case_count desc, arg_max(value, struct_pack(c := confidence, i := -entity_id)), node_type limit 10""")  # fmt: skip
def district_cross_case(spark, sf_dir):
    """A feature limit: a district's ten most shared entities."""
    return A.district_cross_case(D.entities(spark, sf_dir), D.cases(spark, sf_dir), "EUROPE").select("node_type", "normalized", "case_count", "firs")


@query(with_sql(ENTITIES_SQL) + "select 'node_type' part, node_type as value, count(*) n from entities group by node_type union all select 'status', status, count(*) from entities group by status")
def stage_counts(spark, sf_dir):
    return A.stage_counts(D.entities(spark, sf_dir), "node_type", "status")


LINKS_SQL = """made as (select o_orderkey link_id, c_nationkey a, (o_custkey % 25)::int b from orders join customer on o_custkey = c_custkey),
links as (select link_id, a, b from (select *, row_number() over (partition by least(a, b), greatest(a, b) order by link_id) k from made where a <> b) where k = 1)"""


def links(spark, sf_dir):
    """Orders link the case of their customer with the case of their customer's number."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return A.case_links(o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("link_id"), F.col("c_nationkey").alias("a"), (F.col("o_custkey") % 25).cast("int").alias("b")))


@query(f"with {LINKS_SQL} select link_id, a, b from links")
def case_links(spark, sf_dir):
    return links(spark, sf_dir)


@query(with_sql(CASES_SQL, VISIBLE, LINKS_SQL) + "select v.case_id, case when v.case_id = a then b else a end other, link_id from links join visible v on v.case_id = a or v.case_id = b")
def links_of_cases(spark, sf_dir):
    return A.links_of(links(spark, sf_dir), visible(spark, sf_dir))


@query("""with f as (select 'case-' || doc_id % 30 folder, text is not null and text <> '' and doc_id % 13 <> 0 good from documents), n as (select folder, count(*) filter (good) good, count(*) filter (not good) bad from f group by 1),
c as (select n_nationkey k, 'case-' || n_nationkey folder, case when n_nationkey % 8 = 0 then '' else 'FIR-' || n_nationkey end fir_no from nation)
select c.folder, fir_no, case when fir_no = '' then 'rejected: no number' when k % 5 = 1 then 'rejected: known number' when coalesce(good, 0) = 0 then 'failed' when bad > 0 then 'partial' else 'success' end outcome, coalesce(good, 0) good, coalesce(bad, 0) bad
from c left join n using (folder)""")  # fmt: skip
def import_outcomes(spark, sf_dir):
    """Nations as cases and documents as their files: a thirteenth arrived empty, some cases have no number or a known one."""
    k = F.col("n_nationkey")
    named = table(spark, sf_dir, "nation").select(F.concat(F.lit("case-"), k.cast("string")).alias("folder"), F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("FIR-"), k.cast("string"))).alias("fir_no"), (k % 5 == 1).alias("known"))
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.coalesce("text", F.lit("")))
    got = d.select(F.concat(F.lit("case-"), (F.col("doc_id") % 30).cast("string")).alias("folder"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), text.cast("binary").alias("content"))
    return files.import_outcome(named.drop("known"), got, named.filter("known and fir_no <> ''").select("fir_no"))
