"""Domain tables derived from the given tables: the same plan works on any scale of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("open", "under_investigation", "pending_review", "closed", "archived")
RISKS = ("low", "medium", "high")
PERMISSIONS = ("view", "edit", "admin")
NODE_TYPES = ("Person", "Location", "Organization", "Vehicle", "PhoneNumber", "Event")
EDGE_TYPES = ("CALLED", "TRANSFERRED_MONEY_TO", "ASSOCIATED_WITH", "OWNS", "EMPLOYED_BY", "PRESENT_AT", "MET_AT", "RELATED_TO")
SUPERVISOR, USERS = 0, 12

#: Place name, latitude, longitude (Bengaluru's longitude is that of the values, though the city lies at 77.59).
GAZETTEER = [
    ("pune", 18.5204, 73.8567),
    ("mumbai", 19.0760, 72.8777),
    ("nagpur", 21.1458, 79.0882),
    ("nashik", 19.9975, 73.7898),
    ("thane", 19.2183, 72.9781),
    ("sambhajinagar", 19.8762, 75.3433),
    ("aurangabad", 19.8762, 75.3433),
    ("solapur", 17.6599, 75.9064),
    ("kolhapur", 16.7050, 74.2433),
    ("surat", 21.1702, 72.8311),
    ("ahmedabad", 23.0225, 72.5714),
    ("delhi", 28.6139, 77.2090),
    ("new delhi", 28.6139, 77.2090),
    ("jaipur", 26.9124, 75.7873),
    ("lucknow", 26.8467, 80.9462),
    ("bhopal", 23.2599, 77.4126),
    ("patna", 25.5941, 85.1376),
    ("hyderabad", 17.3850, 78.4867),
    ("bengaluru", 12.9716, 80.5946),
    ("bangalore", 12.9716, 80.5946),
    ("chennai", 13.0827, 80.2707),
    ("kolkata", 22.5726, 88.3639),
    ("pune railway station", 18.5289, 73.8744),
    ("mumbai central", 18.9690, 72.8194),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GAZETTEER, "name string, lat double, lng double")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case a nation: its region is the district."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        k.alias("case_id"), F.concat(F.lit("FIR-"), k.cast("string")).alias("fir_no"), F.col("n_name").alias("title"),
        pick(STATUSES, k).alias("status"), pick(RISKS, k).alias("risk_level"),
        F.concat(F.lit("PS-"), (k % 10).cast("string")).alias("station"), F.col("r_name").alias("district"),
        (k % 6).alias("owner_id"), F.date_add(F.lit("2024-01-01").cast("date"), k * 3).alias("created_on"),
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0")
    who = (F.col("c_custkey") % USERS).cast("int")
    return c.groupBy(F.col("c_nationkey").alias("case_id"), who.alias("user_id")).agg(pick(PERMISSIONS, F.min("c_custkey")).alias("permission"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines 1 to 3 with their customer: what relations are made of. Orders meet customers first, so lines are shuffled once."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3")
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return li.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))


def _confidence(key: Column) -> Column:
    return F.round((key % 50 + 1) / 50, 2)


def _status(key: Column) -> Column:
    return F.when(key % 10 == 0, "rejected").when(key % 10 <= 2, "pending").otherwise("confirmed")


def node_key(case_id: Column, node_type: Column, normalized: Column) -> Column:
    return F.concat_ws(":", case_id.cast("string"), node_type, normalized)


def place(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g[0]) for g in GAZETTEER]), (key % len(GAZETTEER) + 1).cast("int"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons are customers; organisations (suppliers), vehicles (parts) and places appear in each case that names them."""
    lines = _lines(spark, sf_dir)
    customer = table(spark, sf_dir, "customer")
    person = customer.select(
        F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("case_id"), F.lit("Person").alias("node_type"),
        F.col("c_name").alias("value"), F.lower("c_name").alias("normalized"), F.col("c_custkey").alias("k"),
    )

    n, k = F.col("l_linenumber"), F.col("k")
    by_line = lambda *parts: F.coalesce(*[F.when(n == i, part) for i, part in enumerate(parts, 1)])
    found = lines.select("l_linenumber", F.col("c_nationkey").alias("case_id"), by_line(F.col("l_suppkey"), F.col("l_partkey"), F.col("l_orderkey") % len(GAZETTEER)).alias("k")).distinct()
    value = by_line(F.format_string("Supplier#%09d", k), F.format_string("MH%07d", k), place(k))
    others = found.select(
        (n * F.lit(10**10) + k * 100 + F.col("case_id")).alias("entity_id"), "case_id", by_line(F.lit("Organization"), F.lit("Vehicle"), F.lit("Location")).alias("node_type"),
        value.alias("value"), F.lower(value).alias("normalized"), "k",
    )
    return person.unionByName(others).select(
        F.col("entity_id").cast("long"), F.col("case_id").cast("int"), "node_type", "value", "normalized",
        _confidence(k).alias("confidence"), _status(k + F.col("case_id")).alias("status"), (k % 7 + 1).cast("int").alias("mention_count"),
        node_key(F.col("case_id"), F.col("node_type"), F.col("normalized")).alias("key"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation rows as extraction makes them, before equal edges are folded."""
    lines = _lines(spark, sf_dir)
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    case = F.col("c_nationkey")
    person = node_key(case, F.lit("Person"), F.lower("c_name"))
    org = node_key(case, F.lit("Organization"), F.lower(F.format_string("Supplier#%09d", "l_suppkey")))
    car = node_key(case, F.lit("Vehicle"), F.lower(F.format_string("MH%07d", "l_partkey")))
    spot = node_key(case, F.lit("Location"), place(F.col("l_orderkey")))
    back = (n == 1) & (flag == "R")
    return lines.select(
        (F.col("l_orderkey") * 8 + n).alias("relation_id"), case.cast("int").alias("case_id"), F.col("l_orderkey").alias("evidence_id"),
        F.when(back, org).otherwise(person).alias("src"),
        F.when(back, person).when(n == 1, org).when(n == 2, car).otherwise(spot).alias("dst"),
        F.when(n == 2, "OWNS").when(n == 3, "PRESENT_AT").when(flag == "A", "CALLED").when(flag == "N", "TRANSFERRED_MONEY_TO").otherwise("ASSOCIATED_WITH").alias("edge_type"),
        F.round(F.col("l_quantity") / 50, 2).alias("confidence"),
        F.when(F.col("l_linestatus") == "F", F.to_date("o_orderdate")).alias("valid_from"),
        _status(F.col("l_orderkey")).alias("status"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("snippet"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an edge (case, src, dst, type): the first mention, with the first date that any mention has."""
    from dossier.operators.registry import fold_relations

    return fold_relations(mentions(spark, sf_dir))


def graph(spark: SparkSession, sf_dir: str, min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The confirmed graph: (nodes, edges)."""
    from dossier.operators.registry import confirmed_graph

    edges = relations(spark, sf_dir).filter(F.col("confidence") >= min_confidence)
    return confirmed_graph(entities(spark, sf_dir), edges)


#: The same tables for DuckDB.
_K = "case when {k} % 10 = 0 then 'rejected' when {k} % 10 <= 2 then 'pending' else 'confirmed' end"
_PLACES = "[" + ", ".join(f"'{g[0]}'" for g in GAZETTEER) + "]"
_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
CASES_SQL = f"""
cases as (select n_nationkey case_id, 'FIR-' || n_nationkey fir_no, n_name title, {_LIST(STATUSES)}[n_nationkey % 5 + 1] status, {_LIST(RISKS)}[n_nationkey % 3 + 1] risk_level,
  'PS-' || n_nationkey % 10 station, r_name district, n_nationkey % 6 owner_id, date '2024-01-01' + n_nationkey * 3 created_on from nation join region on n_regionkey = r_regionkey),
assignments as (select c_nationkey case_id, (c_custkey % {USERS})::int user_id, {_LIST(PERMISSIONS)}[min(c_custkey) % 3 + 1] permission from customer where c_custkey % 5 = 0 group by 1, 2)"""
ENTITIES_SQL = f"""
lines as materialized (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, o_orderdate, c_custkey, c_name, c_nationkey
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_linenumber <= 3),
named as (select c_custkey entity_id, c_nationkey case_id, 'Person' node_type, c_name as value, c_custkey k from customer
  union all select 10000000000 + k * 100 + case_id, case_id, 'Organization', printf('Supplier#%09d', k), k from (select distinct c_nationkey case_id, l_suppkey k from lines where l_linenumber = 1)
  union all select 20000000000 + k * 100 + case_id, case_id, 'Vehicle', printf('MH%07d', k), k from (select distinct c_nationkey case_id, l_partkey k from lines where l_linenumber = 2)
  union all select 30000000000 + k * 100 + case_id, case_id, 'Location', {_PLACES}[k % 24 + 1], k from (select distinct c_nationkey case_id, l_orderkey % 24 k from lines where l_linenumber = 3)),
entities as materialized (select entity_id, case_id, node_type, value, lower(value) normalized, round((k % 50 + 1) / 50, 2) confidence, {_K.format(k="(k + case_id)")} status,
  (k % 7 + 1)::int mention_count, case_id || ':' || node_type || ':' || lower(value) as key from named)"""
RELATIONS_SQL = f"""
mentions as materialized (select l_orderkey * 8 + l_linenumber relation_id, c_nationkey case_id, l_orderkey evidence_id,
  case when l_linenumber = 1 and l_returnflag = 'R' then c_nationkey || ':Organization:' || lower(printf('Supplier#%09d', l_suppkey)) else c_nationkey || ':Person:' || lower(c_name) end src,
  case when l_linenumber = 1 and l_returnflag = 'R' then c_nationkey || ':Person:' || lower(c_name) when l_linenumber = 1 then c_nationkey || ':Organization:' || lower(printf('Supplier#%09d', l_suppkey))
    when l_linenumber = 2 then c_nationkey || ':Vehicle:' || lower(printf('MH%07d', l_partkey)) else c_nationkey || ':Location:' || {_PLACES}[l_orderkey % 24 + 1] end dst,
  case when l_linenumber = 2 then 'OWNS' when l_linenumber = 3 then 'PRESENT_AT' when l_returnflag = 'A' then 'CALLED' when l_returnflag = 'N' then 'TRANSFERRED_MONEY_TO' else 'ASSOCIATED_WITH' end edge_type,
  round(l_quantity / 50, 2) confidence, case when l_linestatus = 'F' then o_orderdate::date end valid_from, {_K.format(k="l_orderkey")} status, 'order ' || l_orderkey snippet from lines),
ordered as (select *, struct_pack(i := relation_id, c := confidence, d := coalesce(valid_from, date '9999-12-31')) o from mentions where src <> dst),
relations as materialized (select case_id, src, dst, edge_type, min(relation_id) relation_id, arg_min(evidence_id, o) evidence_id, arg_min(confidence, o) confidence, arg_min(status, o) status,
  arg_min(snippet, o) snippet, arg_min(valid_from, o) filter (valid_from is not null) valid_from from ordered group by case_id, src, dst, edge_type)"""



def graph_sql(min_confidence: float = 0.0) -> str:
    return f"""
nodes as materialized (select * from entities where status = 'confirmed'),
edges as materialized (select r.* from relations r join nodes a on a.key = r.src join nodes b on b.key = r.dst where r.status = 'confirmed' and r.confidence >= {min_confidence})"""


def with_sql(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",".join(parts)
