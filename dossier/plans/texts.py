"""Queries over texts, vectors, questions and alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dossier.functions.columns import SCRIPTS, script_language
from dossier.functions.arrays import matches
from dossier.operators import alerts, fulltext, resolve, retrieval
from dossier.operators import spans as S
from dossier.operators import text as X
from dossier.operators.components import stored
from dossier.plans.common import register
from dossier.sources import domain as D
from dossier.sources.domain import CASES_SQL, ENTITIES_SQL, RELATIONS_SQL, table, with_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    return register(QUERIES, ORACLE_SQL, sql, dates)


def evidence(spark, sf_dir):
    """A document is a piece of evidence of the case doc_id % 25."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), (F.col("doc_id") % 25).cast("int").alias("case_id"), "text", "lang")


@query()
def extracted_entities(spark, sf_dir):
    """Order of claims has no SQL form; tests compare with a plain version."""
    return X.extract_entities(evidence(spark, sf_dir)).select("evidence_id", "node_type", "normalized", "confidence", "start", "end")


@query()
def extracted_relations(spark, sf_dir):
    e = evidence(spark, sf_dir)
    return X.extract_relations(e, X.extract_entities(e)).select("evidence_id", "src", "dst", "edge_type", "confidence", "engine", F.col("valid_from").cast("string").alias("valid_from"))


@query("select doc_id evidence_id, count(*) n from (select doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+([A-Z0-9\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1) || '|।\\s*')) s from documents) where trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '' group by 1")
def sentence_counts(spark, sf_dir):
    return X.sentences(evidence(spark, sf_dir)).groupBy("evidence_id").agg(F.count("*").alias("n"))


@query("""select doc_id evidence_id, case when trusted and lang = 'es' then 'indic' when trusted and lang <> 'en' and regexp_matches(text, '[^\\x{0000}-\\x{024F}\\PL]') then 'unsupported' else 'english' end route
from (select *, length(coalesce(text, '')) >= 40 and length(coalesce(text, '')) % 100 >= 60 trusted from documents)""")
def language_routes(spark, sf_dir):
    """Detection as sure as the last two digits of a text's length; Spanish texts count as Hindi."""
    text = F.coalesce("text", F.lit(""))
    lang = F.when(F.col("lang") == "es", "hi").otherwise(F.col("lang"))
    return evidence(spark, sf_dir).select("evidence_id", X.route(lang, F.char_length(text) % 100 / 100.0, text).alias("route"))


def _classes_sql() -> str:
    """Two markers of a group in the text, in the groups' order; else what the made file name ends in."""
    count = lambda words: " + ".join("contains(b, '" + w + "')::int" for w in words)
    groups = " ".join(f"when {count(words)} >= 2 then ('{label}', {c}, 'content-markers')" for label, c, words in X.MARKERS)
    return f"""select doc_id evidence_id, r[1]::varchar as label, r[2]::double confidence, r[3]::varchar reason from (select doc_id, case {groups}
  when source = 'src1' then ('cdr', 0.55, 'spreadsheet-default') when source = 'src2' then ('audio_transcript', 0.85, 'extension') when source = 'src3' then ('document', 0.50, 'pdf-default') else ('other', 0.30, 'fallback') end r
from (select doc_id, source, lower(coalesce(text, '')) b from documents))"""


@query(_classes_sql())
def classified_documents(spark, sf_dir):
    """A row for every document. File names are made from the source: src1 is a spreadsheet, src2 audio, src3 a PDF."""
    d = table(spark, sf_dir, "documents")
    name = F.concat("source", F.when(F.col("source") == "src1", ".csv").when(F.col("source") == "src2", ".mp3").when(F.col("source") == "src3", ".pdf").otherwise(".bin"))
    return d.select(F.col("doc_id").alias("evidence_id"), X.classify(name, F.lit(""), F.col("text")).alias("c")).select("evidence_id", "c.label", "c.confidence", "c.reason")


@query()
def chunked_documents(spark, sf_dir):
    """The packing fold has no SQL form; tests compare with a plain version."""
    return retrieval.chunks(evidence(spark, sf_dir)).select("evidence_id", "chunk_index", F.char_length("chunk").alias("n"))


@query("""with q as (select vec_id query_id, embedding::double[] e from embeddings where vec_id % 20 = 0),
s as (select query_id, vec_id, round(1 / (2 - list_dot_product(v.embedding::double[], e) / sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]) * list_dot_product(e, e))) + 1e-9, 6) score from embeddings v, q where v.embedding is not null)
select query_id, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) r from s) where r <= 6""")  # fmt: skip
def vector_hits(spark, sf_dir):
    """Every twentieth vector as a query, against all vectors: the six best of each."""
    v = table(spark, sf_dir, "embeddings")
    return retrieval.vector_hits(v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")).drop("rank")


@query("""select doc_id evidence_id, round(0.9 * (contains(lower(text), 'the')::int + contains(lower(text), 'license')::int + contains(lower(text), 'thing')::int) / 3 + 1e-9, 6)::double score from documents
where contains(lower(text), 'the') or contains(lower(text), 'license') or contains(lower(text), 'thing')""")
def keyword_hits(spark, sf_dir):
    d = evidence(spark, sf_dir).withColumnRenamed("text", "chunk")
    return retrieval.keyword_coverage(d, "the License thing is").select("evidence_id", F.round(F.col("score") + 1e-9, 6).alias("score"))


@query()
def ranked_terms(spark, sf_dir):
    c = retrieval.chunks(evidence(spark, sf_dir))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return retrieval.bm25(c, asked).withColumn("score", F.round("score", 4))


@query(with_sql(ENTITIES_SQL, "g as (select entity_id, value, list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(value), '[^\\pL\\pN]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) t from entities where status <> 'rejected'), q as (select ['  s', ' su', 'sup', 'upp', 'ppl', 'pli', 'lir', 'ir '] t)") + """
select entity_id, round(len(list_intersect(g.t, q.t)) / len(list_distinct(list_concat(g.t, q.t))) + 1e-9, 6) similarity from g, q where len(list_intersect(g.t, q.t)) / len(list_distinct(list_concat(g.t, q.t))) > 0.15 or contains(lower(value), 'supplir')""")  # fmt: skip
def fuzzy_entities(spark, sf_dir):
    e = D.entities(spark, sf_dir).filter("status <> 'rejected'")
    return retrieval.fuzzy_search(e, "value", "supplir").select("entity_id", F.round(F.col("similarity") + 1e-9, 6).alias("similarity"))


_PATHS = [r"(?i)how\s+(?:is|are)\s+(.+?)\s+(?:connected|linked|related|associated)\s+(?:to|with)\s+(.+?)\s*\??$", r"(?i)(?:connection|link|relation|relationship)\s+(?:between|of)\s+(.+?)\s+and\s+(.+?)\s*\??$", r"(.+?)\s*(?:->|→)\s*(.+?)\s*\??$"]


def _intents_sql() -> str:
    slot = lambda p, g: f"trim(regexp_replace(trim(trim(regexp_extract(q, '{p}', {g}), ' '), chr(34) || chr(39)), '\\s+', ' ', 'g'), ' ')"
    fits = " ".join(f"when regexp_matches(q, '{p}') and length({slot(p, 1)}) between 1 and 119 and length({slot(p, 2)}) between 1 and 119 then ({slot(p, 1)}, {slot(p, 2)})" for p in _PATHS)
    return rf"""select conv_id, turn, case when s is not null then 'path' when regexp_matches(q, '(?i)\b(summar(y|ize|ise)|tldr)\b|\bkey\s+players?\b|\b(overview|brief(\s+me)?|status)\b') then 'summary' else 'generic' end intent, s[1]::varchar a, s[2]::varchar b
from (select *, case {fits} end s from (select conv_id, turn, trim(coalesce(text, ''), ' ') q from conversations))"""


@query(_intents_sql())
def question_intents(spark, sf_dir):
    """A row for every turn, path questions with both ends."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.intent(F.col("text")).alias("i")).select("conv_id", "turn", "i.intent", "i.a", "i.b")


@query(with_sql(ENTITIES_SQL) + """select node_type, normalized as name, case node_type when 'Person' then 0.95 when 'Vehicle' then 1.0 when 'PhoneNumber' then 1.0 else 0.9 end::double score, count(*) entities from entities where node_type <> 'Event' group by 1, 2 having count(*) > 1""")
def cross_case_matches(spark, sf_dir):
    """Names of any type that several entities bear, whose entities match by the type's exact rule."""
    found = resolve.shared_names(D.entities(spark, sf_dir))
    return found.select("node_type", F.col("a").alias("name"), "score", F.col("a_n").alias("entities"))


@query()
def entity_suggestions(spark, sf_dir):
    """Resolution across cases, of all types and by all rules, as pairs of names. Ratcliff-Obershelp has no SQL form; tests compare with a plain version."""
    return resolve.name_suggestions(D.entities(spark, sf_dir))


@query("""with recursive e as (select user_id || ':' || event_type as key, ts, event_id, row_number() over (partition by user_id, event_type order by ts, event_id) i from events),
w as (select key, ts, event_id, i, ts last, true emitted from e where i = 1 union all
  select e.key, e.ts, e.event_id, e.i, case when e.ts - w.last > interval 24 hours then e.ts else w.last end, e.ts - w.last > interval 24 hours from w join e on e.key = w.key and e.i = w.i + 1)
select event_id from w where emitted""")  # fmt: skip
def suppressed_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), "ts", F.col("event_id").alias("id"))
    return alerts.suppressed(e).select(F.col("id").alias("event_id"))


@query(with_sql(ENTITIES_SQL, RELATIONS_SQL) + """select case_id, case when confidence >= 0.8 then 'high' else 'medium' end severity, 'connection:' || src || ':' || edge_type || ':' || dst dedupe_key from relations where status = 'confirmed' and confidence >= 0.6""")
def relation_alerts(spark, sf_dir):
    return alerts.relation_alerts(D.relations(spark, sf_dir)).select("case_id", "severity", "dedupe_key")


@query(with_sql(ENTITIES_SQL) + """, live as (select * from entities where status <> 'rejected'), s as (select node_type, normalized, count(distinct case_id) cases from live group by 1, 2 having count(distinct case_id) > 1)
select case_id, 'cross:' || case_id || ':' || node_type || ':' || normalized dedupe_key, max(confidence) confidence, any_value(cases) - 1 others from live join s using (node_type, normalized) group by case_id, node_type, normalized""")  # fmt: skip
def cross_case_alerts(spark, sf_dir):
    return alerts.cross_case_alerts(D.entities(spark, sf_dir))[0].select("case_id", "dedupe_key", "confidence", "others")


@query(with_sql(CASES_SQL, ENTITIES_SQL) + """, live as (select * from entities where status <> 'rejected'),
a as (select x.case_id, x.node_type, x.normalized, max(x.confidence) confidence, list(distinct y.case_id) others from live x join live y on x.node_type = y.node_type and x.normalized = y.normalized and x.case_id <> y.case_id group by 1, 2, 3),
vis as (select owner_id::int user_id, case_id from cases union select user_id, case_id from assignments),
r as (select distinct user_id, (user_id % 4) / 10.0 min_confidence from vis)
select 'cross:' || a.case_id || ':' || a.node_type || ':' || a.normalized alert_id, r.user_id from a join r on a.confidence >= r.min_confidence join vis v on v.user_id = r.user_id and v.case_id = a.case_id
where list_has_all((select list(case_id) from vis w where w.user_id = r.user_id), a.others)""")  # fmt: skip
def routed_alerts(spark, sf_dir):
    """Cross-case alerts of all types reach users who see all cases named; a user's rule asks for a confidence of (user % 4) / 10."""
    from dossier.operators.scope import visibility

    vis = visibility(D.cases(spark, sf_dir), D.assignments(spark, sf_dir)).select(F.col("user_id").cast("int"), "case_id")
    made, named = alerts.cross_case_alerts(D.entities(spark, sf_dir))
    none = F.lit(None).cast("int")
    rules = vis.select("user_id").distinct().select("user_id", F.lit("any").alias("kind"), none.alias("case_id"), F.lit("low").alias("min_severity"), ((F.col("user_id") % 4) / 10.0).alias("min_confidence"), F.lit(True).alias("enabled"))
    return alerts.routed(made.withColumn("alert_id", F.col("dedupe_key")), rules, vis, named)


VECTORS_SQL = """q as (select vec_id query_id, embedding::double[] e from embeddings where vec_id % 20 = 0),
s as (select query_id, vec_id, round(1 / (2 - list_dot_product(v.embedding::double[], e) / sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]) * list_dot_product(e, e))) + 1e-9, 6) score from embeddings v, q where v.embedding is not null),
near as (select query_id, vec_id chunk_id, score, row_number() over (partition by query_id order by score desc, vec_id) r from s),
kw as (select doc_id chunk_id, round(0.9 * (contains(lower(text), 'the')::int + contains(lower(text), 'license')::int + contains(lower(text), 'thing')::int) / 3 + 1e-9, 6)::double score from documents where contains(lower(text), 'the') or contains(lower(text), 'license') or contains(lower(text), 'thing') order by 2 desc, 1 limit 6),
legs as (select query_id, chunk_id, score, 'vector' as method, 0 leg from near where r <= 6 and score >= 0.9 union all select query_id, chunk_id, score, 'keyword', 1 from q, kw),
once as (select * from (select *, row_number() over (partition by query_id, chunk_id order by leg) o from legs) where o = 1),
hits as (select query_id, chunk_id, score, method, rank from (select *, row_number() over (partition by query_id order by leg, score desc, chunk_id) rank from once) where rank <= 6)"""


def hybrid(spark, sf_dir):
    """Vectors stand for the documents of their number: near ones (0.9 and more) first, then the six best by keywords."""
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = retrieval.vector_hits(v, q).filter("score >= 0.9").withColumnRenamed("vec_id", "chunk_id")
    words = retrieval.keyword_coverage(evidence(spark, sf_dir).withColumnRenamed("text", "chunk"), "the License thing is").select(F.col("evidence_id").alias("chunk_id"), F.round(F.col("score") + 1e-9, 6).alias("score"))
    best = words.orderBy(F.desc("score"), "chunk_id").limit(6)
    return retrieval.hybrid(near, q.select("query_id").crossJoin(F.broadcast(best)))  # six rows


@query("with " + VECTORS_SQL + " select query_id, chunk_id, score, method, rank from hits")
def hybrid_hits(spark, sf_dir):
    return hybrid(spark, sf_dir).select("query_id", "chunk_id", "score", "method", "rank")


@query("with " + VECTORS_SQL + """ select query_id, rank number, doc_id evidence_id, left(coalesce(text, ''), 300) snippet, '[' || rank || '] ' || source || '-' || doc_id || ': ' || left(coalesce(text, ''), 220) || '…' line from hits join documents on doc_id = chunk_id""")
def cited_answers(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.concat_ws("-", "source", "doc_id").alias("file_name"), "text")
    return retrieval.cited_answers(hybrid(spark, sf_dir).select("query_id", F.col("chunk_id").alias("evidence_id"), "rank"), texts)


def _trigrams_sql(x: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({x}), '[^\\pL\\pN]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _similar_sql(a: str, b: str) -> str:
    return f"len(list_intersect({_trigrams_sql(a)}, {_trigrams_sql(b)})) / greatest(len(list_distinct(list_concat({_trigrams_sql(a)}, {_trigrams_sql(b)}))), 1)"


ASKED = "src1-42"


@query(with_sql(CASES_SQL, ENTITIES_SQL, "visible as (select case_id from cases where owner_id = 3 union select case_id from assignments where user_id = 3)") + f""",
e as (select 'entities' grp, 0 leg, entity_id id, value as label, {_similar_sql('value', f"'{ASKED}'")} score, confidence t from entities join visible using (case_id) where status <> 'rejected'),
n as (select doc_id id, source || '-' || doc_id as label, lower(text) b, {_similar_sql("source || '-' || doc_id", f"'{ASKED}'")} score from documents join visible on case_id = doc_id % 25),
f as (select 'evidence' grp, case when score > 0.15 or contains(label, '{ASKED}') then 0 else 1 end leg, id, label, case when score > 0.15 or contains(label, '{ASKED}') then score else 0.0 end score, 0.0 t from n where score > 0.15 or contains(label, '{ASKED}') or contains(b, '{ASKED}')),
c as (select 'cases' grp, 0 leg, case_id id, fir_no as label, {_similar_sql('fir_no', f"'{ASKED}'")} score, 0.0 t, title from cases join visible using (case_id)),
a as (select grp, leg, id, label, score, t from e where score > 0.15 or contains(lower(label), '{ASKED}') union all select * from f union all select grp, leg, id, label, score, t from c where score > 0.15 or contains(lower(label), '{ASKED}') or contains(lower(title), '{ASKED}'))
select grp as "group", rank, id, label, round(score, 6)::double score from (select *, row_number() over (partition by grp order by leg, score desc, t desc, id) rank from a) where rank <= 20""")  # fmt: skip
def grouped_search(spark, sf_dir):
    """A feature limit: the twenty best of each group for one text, within what a user sees."""
    from dossier.operators.scope import visible_cases

    c = D.cases(spark, sf_dir)
    files = evidence(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "source"), "evidence_id").withColumn("file_name", F.concat_ws("-", "source", "evidence_id"))
    out = retrieval.grouped_search(D.entities(spark, sf_dir), files, c, visible_cases(c, D.assignments(spark, sf_dir), 3), ASKED, 20)
    return out.withColumn("score", F.round("score", 6))


TODAY = dt.date(2026, 3, 12)
#: Phrases and what they mean on TODAY, a Thursday.
DATED = [
    ("today", "2026-03-12", "2026-03-12"), ("last night", "2026-03-11", "2026-03-11"), ("tomorrow", "2026-03-13", "2026-03-13"), ("this week", "2026-03-09", "2026-03-12"),
    ("last week", "2026-03-02", "2026-03-08"), ("past 3 days", "2026-03-09", "2026-03-12"), ("past 2 weeks", "2026-02-26", "2026-03-12"), ("past 1 month", "2026-02-10", "2026-03-12"),
    ("this month", "2026-03-01", "2026-03-12"), ("last month", "2026-02-01", "2026-02-28"), ("this year", "2026-01-01", "2026-03-12"), ("last year", "2025-01-01", "2025-12-31"),
    ("last thursday", "2026-03-05", "2026-03-05"), ("thursday", "2026-03-12", "2026-03-12"), ("friday", "2026-03-06", "2026-03-06"), ("february 2024", "2024-02-01", "2024-02-29"), ("no date", None, None),
]


@query("with dated(i, p, a, b) as (values " + ", ".join(f"({i}, '{p}', {f"'{a}'" if a else 'null'}, {f"'{b}'" if b else 'null'})" for i, (p, a, b) in enumerate(DATED)) + f""")
select conv_id, turn, least(x.a, y.a) as since, greatest(x.b, y.b) as until, array_to_string(list_sort(list_distinct(list_filter([case when x.p = 'last night' then 'yesterday' when x.a is not null then x.p end, case when y.p = 'last night' then 'yesterday' when y.a is not null then y.p end], lambda p: p is not null))), '; ') phrases
from conversations join dated x on x.i = conv_id % {len(DATED)} join (select y.*, z.i as before from dated y, dated z) w on w.i = turn % {len(DATED)} and w.before = conv_id % {len(DATED)}
  join dated y on y.i = case when x.p like 'past%' and w.p like 'past%' then x.i else w.i end where x.a is not null or y.a is not null""")
def question_dates(spark, sf_dir):
    """Two phrases a turn, by its numbers, before what was said: the range over both, for the turns that have any."""
    c = table(spark, sf_dir, "conversations")
    phrase = lambda n: F.element_at(F.array(*[F.lit(p) for p, _, _ in DATED]), (n % len(DATED) + 1).cast("int"))
    asked = c.select("conv_id", "turn", F.concat_ws(" ", F.lit("Calls of"), phrase(F.col("conv_id")), F.lit("and"), phrase(F.col("turn")), F.lit("?"), F.coalesce("text", F.lit(""))).alias("q"))
    found = asked.select("conv_id", "turn", X.temporal_range(F.col("q"), F.lit(TODAY)).alias("r")).filter("r is not null")
    return found.select("conv_id", "turn", F.col("r.from").cast("string").alias("since"), F.col("r.to").cast("string").alias("until"), "r.phrases")


@query(with_sql(ENTITIES_SQL) + """, sure as (select * from entities where status = 'confirmed'), asked as (select entity_id question_id, value as said from sure where entity_id % 20 = 0),
hits as (select question_id, said mention, e.* from asked join sure e on contains(lower(e.value), lower(said)) or contains(e.normalized, lower(said)) where question_id % 40 = 0
  union all select question_id, e.value, e.* from asked join sure e on contains('was anyone at ' || lower(said) || ' in march?', lower(e.value)) where question_id % 40 <> 0 and contains(e.value, ' ')),
ranked as (select *, row_number() over (partition by question_id, mention order by confidence desc, entity_id) r, count(*) over (partition by question_id, mention) n from hits)
select question_id, mention, entity_id, least(n, 10) candidates from ranked where r <= 10""")  # fmt: skip
def mention_links(spark, sf_dir):
    """Questions about every twentieth entity, half of them with its value in quotes, against all confirmed entities."""
    sure = D.entities(spark, sf_dir).filter("status = 'confirmed'")
    said = F.when(F.col("entity_id") % 40 == 0, F.concat(F.lit('Who called "'), "value", F.lit('" last week?'))).otherwise(F.concat(F.lit("Was anyone at "), "value", F.lit(" in March?")))
    asked = sure.filter("entity_id % 20 = 0").select(F.col("entity_id").alias("question_id"), said.alias("question"))
    return X.link_mentions(asked, sure).select("question_id", "mention", "entity_id", "candidates")


@query("select doc_id evidence_id, case when regexp_matches(coalesce(text, ''), '[aeiou]') then ['hi', 'bn', 'pa', 'gu', 'or', 'ta', 'te', 'kn', 'ml', null][doc_id % 10 + 1] end guess from documents")
def script_guesses(spark, sf_dir):
    """Texts with their vowels written in one of nine scripts, by number; a tenth stays as it is."""
    written = lambda first: F.translate(F.coalesce("text", F.lit("")), "aeiou", "".join(chr(first + 0x15 + i) for i in range(5)))
    said = F.coalesce(*[F.when(F.col("doc_id") % 10 == i, written(first)) for i, (_, first, _) in enumerate(SCRIPTS)], F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), script_language(said).alias("guess"))


@query("""with p as (select p_partkey % 500 evidence_id, lower(p_name) normalized, p_name as value from part), t as (select *, string_split_regex(normalized, '\\s+') w from (select distinct * from p)),
x as (select evidence_id, 0 slot, w[1] token, value from t union all select evidence_id, 1, w[-1], value from t),
a as (select evidence_id, slot, token, any_value(value) as value from x group by 1, 2, 3 having count(*) = 1)
select evidence_id, token, arg_max(value, slot) as value from a group by 1, 2""")  # fmt: skip
def name_aliases(spark, sf_dir):
    """Part names stand for persons' names, 500 pieces of evidence for documents."""
    named = table(spark, sf_dir, "part").select((F.col("p_partkey") % 500).alias("evidence_id"), F.col("p_name").alias("value"), F.lower("p_name").alias("normalized")).distinct()
    return X.aliases(named).select("evidence_id", "token", "value")


@query("""with t as (select *, string_split_regex(lower(trim(p_name)), '\\s+') w from part), n as (select p_partkey % 50 evidence_id, p_name as value, w, 'k' || p_partkey normalized from t union all select p_partkey % 50, w[1], [w[1]], 's' || p_partkey from t where p_partkey % 2 = 0)
select evidence_id, value, normalized from n a where len(w) > 1 or not exists (select 1 from n b where b.evidence_id = a.evidence_id and len(b.w) > 1 and list_contains(b.w, a.w[1]))""")  # fmt: skip
def folded_aliases(spark, sf_dir):
    """Part names stand for persons, and the first words of every second one for what else a name model might have found."""
    part = table(spark, sf_dir, "part")
    whole = part.select((F.col("p_partkey") % 50).alias("evidence_id"), F.lit("Person").alias("node_type"), F.col("p_name").alias("value"), F.concat(F.lit("k"), "p_partkey").alias("normalized"))
    first = part.filter("p_partkey % 2 = 0").select((F.col("p_partkey") % 50).alias("evidence_id"), F.lit("Person").alias("node_type"), F.split(F.lower(F.btrim("p_name")), r"\s+")[0].alias("value"), F.concat(F.lit("s"), "p_partkey").alias("normalized"))
    return X.fold_aliases(whole.unionByName(first)).select("evidence_id", "value", "normalized")


#: Tags of a made token classifier, whose scores are the bytes of a token's MD5 sum.
TAGS = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC", "B-ORG", "I-ORG", "B-MISC"]
_SCORES_SQL = "list_transform(range(0, 8), lambda k: ('0x' || substr(m, 2 * k + 1, 2))::int / 32.0::double)"
_NODE_TYPES_SQL = " ".join(f"when '{k}' then '{v}'" for k, v in S.NODE_TYPES.items())
SPANS_SQL = f"""
l as (select evidence_id, sentence, unnest(h) w, unnest(g[:len(h)]) g, generate_subscripts(h, 1) position from (select doc_id evidence_id, sentence - 1 sentence, regexp_extract_all(s, '[^ \t\n\r]+') h, string_split_regex(s, '[^ \t\n\r]+') g
  from (select doc_id, unnest(string_split(text, chr(10))) s, generate_subscripts(string_split(text, chr(10)), 1) sentence from documents where text is not null))),
p as (select *, (sum(length(g) + length(w)) over (partition by evidence_id, sentence order by position) - length(w))::int start_at, md5(lower(w)) m from l),
k as (select *, {_SCORES_SQL} s from p),
t as (select *, {TAGS}[list_position(s, list_max(s))] tag, 1 / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))) prob from k),
r as (select *, case when tag <> 'O' then split_part(tag, '-', 2) end raw, tag like 'B%' b from t),
i as (select *, sum((raw is not null and (b or before is distinct from raw))::int) over (partition by evidence_id, sentence order by position) island
  from (select *, lag(raw) over (partition by evidence_id, sentence order by position) before from r)),
spans as (select evidence_id, sentence, min(start_at) start_at, max(start_at + length(w)) end_at, any_value(raw) raw_label, case any_value(raw) {_NODE_TYPES_SQL} end node_type, round(avg(prob) + 1e-9, 4) confidence from i where raw is not null group by evidence_id, sentence, island)"""


def token_spans(spark, sf_dir):
    """The spans of the made classifier over all words of all documents; a line counts as a sentence."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.posexplode(F.split("text", "\n")).alias("sentence", "line"))
    t = d.select("evidence_id", "sentence", F.posexplode(matches(F.col("line"), r"[^ \t\n\r]+")).alias("position", "w")).select("evidence_id", "sentence", "position", "w.*")
    sums = F.md5(F.encode(F.lower("value"), "UTF-8"))
    #: Spelt out, as in a lambda the sum would be worked out for each score.
    scores = F.array(*[F.conv(F.substr("m", F.lit(2 * k + 1), F.lit(2)), 16, 10).cast("double") / 32.0 for k in range(len(TAGS))])
    return S.decoded(t.withColumn("m", sums).withColumn("scores", scores), TAGS)


@query("with " + SPANS_SQL + " select evidence_id, sentence::int sentence, start_at, end_at, raw_label, node_type, confidence from spans")
def bio_spans(spark, sf_dir):
    return token_spans(spark, sf_dir).withColumnsRenamed({"start": "start_at", "end": "end_at"})


@query("with " + SPANS_SQL + " select raw_label, count(*) n from spans where node_type is null group by 1")
def skipped_labels(spark, sf_dir):
    """Labels that stand for no type of node, and how many spans they name."""
    return S.skipped(token_spans(spark, sf_dir))


@query()
def text_hits(spark, sf_dir):
    """Each benchmark item asks for its first two words, or for its next two as a phrase without its fifth: the ten best documents. Stems have no SQL form; tests compare with a plain version."""
    w = F.split(F.btrim("text"), r"\s+")
    word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    asked = F.concat(word(0), F.lit(" "), word(1), F.lit(' or "'), word(2), F.lit(" "), word(3), F.lit('" -'), word(4))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), asked.alias("question"))
    return fulltext.search(table(spark, sf_dir, "documents").select("doc_id", "text"), items)


#: Letters and digits of person names and what they are written as in another script.
LATIN, NATIVE = "custome#0123456789", "कसतषमएटर०१२३४५६७८९"


@query(with_sql(ENTITIES_SQL, f"p as (select case_id, entity_id, normalized from entities where node_type = 'Person'), n as (select case_id, entity_id + 1000000000 entity_id, translate(normalized, '{LATIN}', '{NATIVE}') normalized from p where entity_id % 3 = 0)") + """
select a.case_id, a.entity_id a_id, n.entity_id b_id, n.normalized b, 0.85::double score, 'xlit-exact-name' reason from p a join n on n.entity_id = a.entity_id + 1000000000""")  # fmt: skip
def script_matches(spark, sf_dir):
    """Every third person also stands in a register in another script; the table of Latin forms brings both together."""
    persons = D.entities(spark, sf_dir).filter("node_type = 'Person'")
    third = persons.filter("entity_id % 3 = 0").withColumn("entity_id", F.col("entity_id") + 1_000_000_000).withColumn("latin", F.col("normalized"))
    third = third.withColumn("normalized", F.translate("normalized", LATIN, NATIVE))
    found = resolve.across_scripts(persons.unionByName(third.drop("latin")), third.select("normalized", "latin"))
    return found.filter("reason = 'xlit-exact-name'").select("case_id", "a_id", "b_id", "b", "score", "reason")


@query(with_sql(ENTITIES_SQL, f"""live as (select * from entities where status <> 'rejected'), q as (select entity_id query_id, replace(replace(value, 'er', 're'), '00', '0') as text from live where entity_id % 20 = 0),
v as (select value, {_trigrams_sql("value")} t from (select distinct value from live)), a as (select text, {_trigrams_sql("text")} t from (select distinct text from q)),
m as (select text, value, len(list_intersect(a.t, v.t)) / greatest(len(list_distinct(list_concat(a.t, v.t))), 1) similarity from a, v),
h as (select * from m where similarity > 0.6 or contains(lower(value), lower(text)))""") + " select query_id, entity_id id, round(similarity + 1e-9, 6) similarity from h join q using (text) join live using (value)")  # fmt: skip
def misspelt_entities(spark, sf_dir):
    """Every twentieth entity's value, misspelt, against all entities: values that resemble it by more than 0.6 or hold it."""
    live = stored(D.entities(spark, sf_dir).filter("status <> 'rejected'").select(F.col("entity_id").alias("id"), "value"), "live")
    asked = live.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.replace(F.replace(F.col("value"), F.lit("er"), F.lit("re")), F.lit("00"), F.lit("0")).alias("text"))
    return retrieval.fuzzy_hits(live, asked, 0.6).withColumn("similarity", F.round(F.col("similarity") + 1e-9, 6))
