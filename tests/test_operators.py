"""Rules on literal frames."""

import datetime as dt
import difflib
import re

import pytest
from pyspark.sql import functions as F

from dossier.operators import alerts, geo, metrics, registry, resolve, retrieval, scoring
from dossier.operators import pattern as P
from dossier.operators import text as X
from dossier.sources import domain, files


def evidence(spark, *texts):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "evidence_id long, case_id int, text string")


def test_entities(spark):
    e = evidence(spark, "Call +91 98765 43210 or 9876543210 about MH-12-AB-1234 and Rahul Sharma. First Information Report", None, "")
    got = {(r["node_type"], r["normalized"], r["confidence"]) for r in X.extract_entities(e).collect()}
    assert got == {("PhoneNumber", "9876543210", 0.95), ("Vehicle", "MH12AB1234", 0.90), ("Person", "rahul sharma", 0.50)}


def test_dates(spark):
    e = evidence(spark, "on 12 March 2026, 2026-01-05 and 03/02/26; 32/13/2026, 31 Feb 2026, 5 Jan 26", "none", None)
    got = [r["d"] for r in e.orderBy("evidence_id").select(X.dates(F.coalesce("text", F.lit(""))).alias("d")).collect()]
    assert got == [[dt.date(2026, 1, 5), dt.date(2026, 2, 3), dt.date(2026, 3, 12)], [], []]


def relations(spark, text, ents):
    e = evidence(spark, text)
    rows = spark.createDataFrame([(0, 1, *x) for x in ents], "evidence_id long, case_id int, node_type string, value string, normalized string")
    return {(r["src"], r["edge_type"], r["dst"], r["confidence"], str(r["valid_from"])) for r in X.extract_relations(e, rows).collect()}


def test_relations(spark):
    people = [("Person", "Rahul Sharma", "rahul sharma"), ("Person", "Vikram Patil", "vikram patil"), ("Vehicle", "MH12AB1234", "MH12AB1234"), ("Organization", "Sharma Transports", "sharma transports"), ("Location", "Pune", "pune")]
    text = "On 12 March 2026 Rahul Sharma called Vikram Patil. Sharma Transports paid Rs.5,000 to Vikram Patil. Rahul owns MH12AB1234. Vikram Patil was at Pune."
    assert relations(spark, text, people) == {
        ("rahul sharma", "CALLED", "vikram patil", 0.60, "2026-03-12"), ("sharma transports", "TRANSFERRED_MONEY_TO", "vikram patil", 0.55, "None"),
        ("rahul sharma", "OWNS", "MH12AB1234", 0.60, "None"), ("vikram patil", "PRESENT_AT", "pune", 0.50, "None"),
    }
    assert relations(spark, "Rahul Sharma and Vikram Patil.", people) == {("rahul sharma", "ASSOCIATED_WITH", "vikram patil", 0.45, "None")}


def test_relations_of_a_long_sentence(spark):
    """Against brute force: every pair of persons in order of place, and every person with every vehicle."""
    names = ["Rahul Sharma", "Vikram Patil", "Anita Rao", "Sunil Joshi"]
    text = "then " * 300 + "Anita Rao called " + "and then " * 400 + "Rahul Sharma, " + "later " * 500 + "Vikram Patil and Sunil Joshi who owns MH12AB1234"
    people = [("Person", n, n.lower()) for n in names]
    order = sorted(names, key=text.index)
    assert len(text) > 2000 and not re.search(X.SENTENCE_END.removeprefix("(?U)"), text)
    want = {(a.lower(), "CALLED", b.lower(), 0.60, "None") for i, a in enumerate(order) for b in order[i + 1 :]} | {(a.lower(), "OWNS", "MH12AB1234", 0.60, "None") for a in order}
    assert relations(spark, text, [*people, ("Vehicle", "MH12AB1234", "MH12AB1234")]) == want
    #: Aliases: a first or last name counts where it is a word and no whole name covers it.
    said = "x " * 1200 + "Patil called Rahul, not Raokin"
    assert relations(spark, said, people) == {("rahul sharma", "CALLED", "vikram patil", 0.60, "None")}


def test_classify_and_intent(spark):
    rows = [("a.jpg", "", "", "photo"), ("x.csv", "", "", "cdr"), ("FIR_12.pdf", "", "", "fir"), ("x.pdf", "", "IFSC code and narration", "bank_statement"), ("x.bin", "audio/mp3", "", "audio_transcript"), (None, None, None, "other"), ("jpg", "", "", "other")]
    df = spark.createDataFrame(rows, "name string, mime string, body string, want string")
    assert [r["want"] for r in df.collect()] == [r["l"] for r in df.select(X.classify(F.col("name"), F.col("mime"), F.col("body"))["label"].alias("l")).collect()]
    asked = spark.createDataFrame([("How is Rahul connected to Vikram?", "path"), ("A -> B", "path"), ("key players please", "summary"), ("who?", "generic"), (None, "generic")], "q string, want string")
    got = asked.select("want", X.intent(F.col("q")).alias("i")).collect()
    assert [r["want"] for r in got] == [r["i"]["intent"] for r in got] and (got[0]["i"]["a"], got[0]["i"]["b"]) == ("Rahul", "Vikram")


def test_chunks_against_a_plain_version(spark):
    texts = ["One. Two! Three? " * 60, "x" * 2000, "", None, "Short one. " + "y" * 790 + ". End."]

    def plain(text):
        out, current = [], ""
        n = 0
        for s in [s.strip() for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]:
            if current and n + len(s) + 1 > 800:
                out.append(current)
                current = current[-100:]
                n = len(current)
            current = f"{current} {s}" if current else s
            n += len(s) + 1
        return [*out, current] if current else out

    got = {}
    for r in retrieval.chunks(evidence(spark, *texts)).orderBy("evidence_id", "chunk_index").collect():
        got.setdefault(r["evidence_id"], []).append(r["chunk"])
    assert [got.get(i, []) for i in range(len(texts))] == [plain(t) for t in texts]


def test_pair_scores(spark):
    rows = [
        ("Person", "rahul sharma", "rahul sharma"), ("Person", "r sharma", "rahul sharma"), ("Person", "rahul kumar sharma", "rahul sharma"), ("Person", "rahul sharma", "rahul verma"),
        ("PhoneNumber", "1", "1"), ("Vehicle", "MH12AB1234", "MH12AB1235"), ("Organization", "acme traders", "acme trader"), ("Location", "pune", "pune"), ("Person", "rahul sharma", "rahil sharma"), ("Event", "x", "x"),
    ]
    df = spark.createDataFrame([(i, 1, k, i, a, 100 + i, b) for i, (k, a, b) in enumerate(rows)], "i int, case_id int, node_type string, a_id int, a string, b_id int, b string")
    got = {r["i"]: (r["score"], r["reason"]) for r in resolve.scored(df).collect()}
    mixed = 0.5 * difflib.SequenceMatcher(None, "rahul sharma", "rahil sharma").ratio() + 0.5 / 3
    assert got == {0: (0.95, "exact-name"), 1: (0.80, "initial-surname"), 2: (0.78, "name-subset"), 4: (1.0, "same-phone"), 5: (0.9, "fuzzy-plate"), 6: (pytest.approx(0.861, abs=1e-3), "fuzzy"), 7: (0.90, "exact")} | ({8: (round(mixed, 3), "fuzzy-name")} if mixed >= 0.75 else {})
    e = spark.createDataFrame([(1, 1, "Person", "rahul sharma"), (2, 1, "Person", "r sharma"), (3, 1, "Person", "r verma"), (4, 2, "Person", "r sharma")], "entity_id long, case_id int, node_type string, normalized string")
    assert {(r["a_id"], r["b_id"]) for r in resolve.suggestions(e).collect()} == {(1, 2)}


def test_merge(spark):
    e = spark.createDataFrame([(1, 5, 0.5, "confirmed"), (2, 7, 0.4, "confirmed"), (3, 7, 0.9, "pending"), (4, 1, 0.1, "confirmed")], "entity_id long, mention_count int, confidence double, status string")
    s = registry.merge_survivors(e, spark.createDataFrame([(1, 2), (2, 3)], "a_id long, b_id long"))
    assert {(r["entity_id"], r["survivor_id"]) for r in s.collect()} == {(1, 3), (2, 3), (3, 3)}
    assert {(r["entity_id"], r["mention_count"], r["status"], r["merged_into"]) for r in registry.merge_entities(e, s).collect()} == {(1, 5, "merged", 3), (2, 7, "merged", 3), (3, 19, "pending", None), (4, 1, "confirmed", None)}
    r = spark.createDataFrame([(1, 1, 1, 4, "OWNS", 0.5), (2, 1, 2, 4, "OWNS", 0.7), (3, 1, 1, 2, "CALLED", 0.9)], "relation_id long, case_id int, src_id long, dst_id long, edge_type string, confidence double")
    assert {(x["relation_id"], x["src_id"], x["dst_id"]) for x in registry.repoint_relations(r, s).collect()} == {(2, 3, 4)}


def test_registry_upsert(spark):
    cols = "case_id int, node_type string, normalized string, value string, evidence_id long, confidence double, engine string, snippet string, seen long"
    found = spark.createDataFrame([(1, "Person", "a", "A", 1, 0.5, "x", "s1", 1), (1, "Person", "a", "A.", 2, 0.9, "y", "s2", 2), (1, "Person", "a", "A", 2, 0.4, "x", "s3", 3)], cols)
    (row,) = registry.fold_entities(found).collect()
    assert (row["value"], row["confidence"], row["engine"], row["mention_count"]) == ("A", 0.9, "y", 2)
    old = registry.fold_entities(found).withColumn("status", F.lit("confirmed"))
    new = spark.createDataFrame([(1, "Person", "a", "AA", 3, 0.95, "z", "s", 9), (1, "Person", "b", "B", 3, 0.2, "z", "s", 9)], cols)
    got = {r["normalized"]: (r["value"], r["confidence"], r["engine"], r["mention_count"], r["status"]) for r in registry.upsert_entities(old, new).collect()}
    assert got == {"a": ("A", 0.95, "z", 3, "confirmed"), "b": ("B", 0.2, "z", 1, "pending")}
    ok, bad = registry.vocabulary_check(found, "node_type", ("Event",))
    assert ok.count() == 0 and bad.count() == 3


def test_geo(spark):
    g = domain.gazetteer(spark)
    rows = spark.createDataFrame([("Pune",), ("pune-Kothrud",), ("New_Delhi",), ("nowhere",), ("new town",), (None,)], "name_ string")
    got = [(r["lat"], r["geo_source"]) for r in geo.geocode(rows, "name_", g).orderBy(F.monotonically_increasing_id()).collect()]
    assert sorted(got, key=str) == sorted([(18.5204, "gazetteer"), (18.5204, "gazetteer-city"), (28.6139, "gazetteer"), (None, None), (None, None), (None, None)], key=str)
    pts = spark.createDataFrame([("a", 18.52, 73.86, 1.0), ("b", 18.53, 73.87, None), ("c", 19.07, 72.87, None), ("d", 0.0, 179.99, None), ("e", None, 1.0, None)], "label string, lat double, lng double, weight double")
    assert [(r["n"], r["weight"]) for r in geo.hotspots(pts).collect()] == [(2, 1.5)]
    c = spark.createDataFrame([(1, 18.52, 73.86), (2, 0.0, -179.99)], "centre_id int, clat double, clng double")
    near = {(r["centre_id"], r["label"]) for r in geo.within_radius(pts, c, 5.0).collect()}
    assert near == {(1, "a"), (1, "b"), (2, "d")}
    assert geo.within_radius(pts, c, 130.0).filter("label = 'c'").first()["km"] == pytest.approx(120, abs=3)


def nodes_edges(spark):
    n = [(f"k{i}", 1, "Person", f"v{i}", f"v{i}", 0.9) for i in range(6)]
    e = [("k0", "k1", "CALLED", 0.9, None), ("k1", "k2", "CALLED", 0.8, "2024-01-01"), ("k2", "k3", "OWNS", 0.7, None), ("k0", "k4", "CALLED", 0.4, None), ("k4", "k3", "CALLED", 0.3, None)]
    nodes = spark.createDataFrame(n, "key string, case_id int, node_type string, value string, normalized string, confidence double")
    edges = spark.createDataFrame([(i, 1, s, d, t, c, v) for i, (s, d, t, c, v) in enumerate(e)], "evidence_id long, case_id int, src string, dst string, edge_type string, confidence double, valid_from string")
    return nodes, edges.withColumn("valid_from", F.col("valid_from").cast("date"))


def test_patterns(spark):
    n, e = nodes_edges(spark)
    m = P.match(n, e, None, [P.Node("a"), P.Edge("e", "CALLED"), P.Node("b"), P.Edge("f"), P.Node("c")])
    assert {(r["a_key"], r["b_key"], r["c_key"]) for r in m.collect()} == {("k0", "k1", "k2"), ("k1", "k2", "k3"), ("k0", "k4", "k3")}
    back = P.match(n, e, None, [P.Node("a", equals={"value": "v3"}), P.Edge("e", directed=False), P.Node("b")])
    assert {r["b_key"] for r in back.collect()} == {"k2", "k4"}
    both = P.match(n, e, n.select("case_id").limit(1), [P.Node("a"), P.Edge("e", "OWNS"), P.Node("b")], [P.Node("b"), P.Edge("f", "CALLED", reverse=True), P.Node("c")])
    assert {(r["a_key"], r["c_key"]) for r in both.collect()} == {("k2", "k4")}
    for bad in ([P.Node("a"), P.Edge("e")], [P.Node("a", "Ship")], [P.Node("a"), P.Edge("e", "SAILS"), P.Node("b")]):
        with pytest.raises(ValueError):
            P.match(n, e, None, bad)


def test_paths_and_communities(spark):
    from dossier.operators import graph as G

    n, e = nodes_edges(spark)
    pairs = spark.createDataFrame([("k0", "k3"), ("k0", "k5"), ("k2", "k2")], "a string, b string")
    got = {(r["a"], r["b"]): (r["hops"], r["path"]) for r in G.shortest_paths(e, pairs).collect()}
    assert got == {("k0", "k3"): (2, "k0 > k4 > k3"), ("k2", "k2"): (0, "k2")}
    clique = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0")]
    ce = spark.createDataFrame([(s, d, 1.0) for s, d in clique], "src string, dst string, confidence double")
    cn = spark.createDataFrame([(f"{g}{i}",) for g in "ab" for i in range(4)] + [("z",)], "key string")
    found = metrics.communities(cn, ce)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["community"], set()).add(r["key"])
    assert sorted(map(len, groups.values())) == [1, 4, 4] and groups["z"] == {"z"}
    assert metrics.modularity(ce, found) > metrics.modularity(ce, cn.withColumn("community", F.col("key")))
    assert sorted(found.collect()) == sorted(metrics.communities(cn, ce).collect())


def test_scores_equal_their_breakdown(spark):
    m = spark.createDataFrame([("a", 1, "Person", "a", 0.9, 2.0, 5.0, 4), ("b", 1, "Person", "b", 0.5, 1.0, None, 2)], "key string, case_id int, node_type string, normalized string, confidence double, pagerank double, betweenness double, degree long")
    x = spark.createDataFrame([("Person", "a", 9)], "node_type string, normalized string, cases long")
    got = {r["key"]: r for r in scoring.risk_scores(m, x).collect()}
    assert got["a"]["score"] == pytest.approx(0.99) and got["a"]["level"] == "high" and got["b"]["notes"] == ["no betweenness"]
    for r in got.values():
        assert r["score"] == pytest.approx(sum(f["contribution"] for f in r["factors"]))
    assert sum(scoring.WEIGHTS.values()) == pytest.approx(1)


def test_hub(spark):
    d = spark.createDataFrame([(f"k{i}", 1, 1) for i in range(6)] + [("hub", 1, 12)] + [(f"q{i}", 2, 1) for i in range(3)], "key string, case_id int, degree long")
    assert [r["subject"] for r in scoring.hub_outliers(d).collect()] == ["hub"]


def test_files(spark, tmp_path):
    import json

    for name, fir, parts in (("c1", "F1", {"a.txt": b"hi", "b.txt": b""}), ("c2", "F2", {"a.txt": b"hi"}), ("c3", "", {"a.txt": b"x"}), ("c4", "F0", {"x.csv": b"x"}), ("c5", "F5", {"x.csv": b""})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps({"case_id": name, "fir_no": fir}, indent=1))
        for f, data in parts.items():
            (tmp_path / name / f).write_bytes(data)
    known = spark.createDataFrame([("F0",)], "fir_no string")
    listed = spark.createDataFrame([("c1", "a.txt"), ("c1", "b.txt"), ("c2", "a.txt"), ("c5", "x.csv")], "folder string, file_name string")
    got = {r["folder"]: r["outcome"] for r in files.import_outcome(files.manifests(spark, str(tmp_path)), files.bundle_files(spark, str(tmp_path)), known, listed).collect()}
    assert got == {"c1": "partial", "c2": "success", "c3": "rejected: no number", "c4": "rejected: known number", "c5": "failed"}


def test_decode(spark):
    texts = [("héllo".encode(), "héllo"), ("héllo".encode("utf-16"), "héllo"), (b"caf\xe9s", "cafés"), (b"", "")]
    df = spark.createDataFrame(texts, "content binary, want string")
    assert all(r["want"].encode("utf-16") == r["got"].encode("utf-16") for r in df.withColumn("got", files.decoded(F.col("content"))).collect())


def test_cdr(spark):
    e = evidence(spark, "caller,Tower_Location,Timestamp\n1,Pune-A,2026-01-02T10:00:00\n2,,2026-01-02\n3,\"Mumbai\",bad", "no,columns\n1,2", "", None, "tower\nX")
    assert sorted((r["evidence_id"], r["tower"], str(r["date"])) for r in files.cdr_rows(e).collect()) == [(0, "Mumbai", "None"), (0, "Pune-A", "2026-01-02"), (4, "X", "None")]


def at(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


EVENTS = [("a", 0, 1, True), ("a", 10, 2, False), ("a", 24, 3, False), ("a", 25, 4, True), ("a", 48, 5, False), ("b", 5, 6, True), ("b", 30, 7, True)]


def test_suppression_batch_and_stream(spark, tmp_path):
    from dossier.streaming.alerts import suppressed_stream, weekly_stream

    df = spark.createDataFrame([(k, at(h), i) for k, h, i, _ in EVENTS], "key string, ts timestamp, id long")
    want = {i for _, _, i, kept in EVENTS if kept}
    assert {r["id"] for r in alerts.suppressed(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def result(out, name):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {r["id"] for r in result(suppressed_stream(stream()), "emitted")} == want
    assert all(r["week"].weekday() == 0 for r in result(weekly_stream(stream(), late="1 second"), "weeks"))


def test_burst_stream(spark, tmp_path):
    """Days are told once a later event has moved the watermark past them; days of fewer events are not."""
    from dossier.streaming.alerts import burst_stream

    schema = "key string, ts timestamp, id long"
    for i, rows in enumerate(([("a", at(h), h) for h in (1, 2, 3)] + [("b", at(h), h) for h in (4, 5)] + [("a", at(30), 30)], [("z", at(240), 240)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    for i in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"part{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = burst_stream(rows, late="1 second").writeStream.format("memory").queryName("burst_days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("burst_days").collect()] == [("a", dt.date(2024, 1, 1), 3)]


def test_evidence_stream(spark, tmp_path):
    """Two micro-batches: rows that cannot be read are set aside, the registry grows, and a batch that runs again changes nothing."""
    from dossier.streaming.evidence import RegistryStore, evidence_stream, process_evidence, sightings

    schema = "evidence_id long, case_id int, text string"
    first = [(1, 1, "Call 9876543210 about MH-12-AB-1234. Rahul Sharma called Vikram Patil."), (2, 1, None), (None, 1, "x")]
    second = [(3, 1, "Rahul Sharma paid Rs.500 to Anita Rao."), (4, 2, "Rahul Sharma")]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        for f in (tmp_path / f"p{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
    store = RegistryStore(spark, str(tmp_path / "registry"))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    evidence_stream(rows, store, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    state = lambda: sorted((r["case_id"], r["normalized"], r["mention_count"], r["status"]) for r in store.version(1).collect())
    want = [(1, "9876543210", 1, "pending"), (1, "MH12AB1234", 1, "pending"), (1, "anita rao", 1, "pending"), (1, "rahul sharma", 2, "pending"), (1, "vikram patil", 1, "pending"), (2, "rahul sharma", 1, "pending")]
    assert state() == want
    store.apply(sightings(process_evidence(spark.createDataFrame(second, schema))["entities"]), 1)
    assert state() == want
    assert sorted(r["error"] for r in spark.read.parquet(str(tmp_path / "out" / "quarantine")).collect()) == ["no id", "no text"]
    assert {r["edge_type"] for r in spark.read.parquet(str(tmp_path / "out" / "relations")).collect()} == {"CALLED", "TRANSFERRED_MONEY_TO"}


def test_reindex(spark, tmp_path):
    from dossier.streaming.evidence import reindex

    rows = lambda *texts: spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "evidence_id long, case_id int, text string")
    read = lambda: sorted((r["case_id"], r["evidence_id"], r["chunk"]) for r in spark.read.parquet(str(tmp_path / "index")).collect())
    reindex(rows("A b.", "C d.", "E f."), str(tmp_path / "index"))
    assert read() == [(0, 0, "A b."), (0, 2, "E f."), (1, 1, "C d.")]
    for _ in range(2):
        reindex(rows("New.", "Other.", "E f."), str(tmp_path / "index"), case_id=0)
        assert read() == [(0, 0, "New."), (0, 2, "E f."), (1, 1, "C d.")]


def test_routing(spark):
    """A user sees an alert only with all known cases of its subject; one without a subject goes by its case."""
    made = spark.createDataFrame([("x1", 1, "cross_case", "medium", 0.9, "s"), ("x2", 2, "cross_case", "medium", 0.9, "s"), ("y", 1, "risk", "high", 0.5, None)], "alert_id string, case_id int, kind string, severity string, confidence double, subject string")
    named = spark.createDataFrame([("s", 1), ("s", 2), ("s", 99)], "subject string, case_id int")
    seen = spark.createDataFrame([(7, 1), (7, 2), (8, 1), (9, 1), (9, 2)], "user_id int, case_id int")
    rules = spark.createDataFrame([(7, "any", None, "low", 0.6, True), (8, "any", None, "low", 0.0, True), (9, "cross_case", 2, "low", 0.0, True), (9, "risk", None, "high", 0.0, False)], "user_id int, kind string, case_id int, min_severity string, min_confidence double, enabled boolean")
    assert {(r["user_id"], r["alert_id"]) for r in alerts.routed(made, rules, seen, named).collect()} == {(7, "x1"), (7, "x2"), (8, "y"), (9, "x2")}


def test_dates_in_questions(spark):
    rows = [("What happened Today?", "2026-03-12", "2026-03-12"), ("last Thursday or yesterday", "2026-03-05", "2026-03-11"), ("past 10 days", "2026-03-02", "2026-03-12"), ("in March 2024 and May 2025", "2024-03-01", "2025-05-31"), ("from monday", "2026-03-09", "2026-03-09"), ("nothing", None, None), (None, None, None), ("todays mayhem 2024", None, None), ("past 99999999999 days", None, None)]
    df = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(rows)], "i int, q string")
    got = [r["r"] for r in df.orderBy("i").select(X.temporal_range(F.col("q"), F.lit(dt.date(2026, 3, 12))).alias("r")).collect()]
    assert [(str(r["from"]), str(r["to"])) if r else (None, None) for r in got] == [(a, b) for _, a, b in rows]


def test_mention_links(spark):
    e = spark.createDataFrame([(1, 1, "Person", "Rahul Sharma", "rahul sharma", 0.9), (2, 2, "Person", "Rahul Sharma", "rahul sharma", 0.5), (3, 1, "Person", "Amit", "amit", 0.9), (4, 1, "Location", "विक्रम पाटिल", "विक्रम पाटिल", 0.8)], "entity_id long, case_id int, node_type string, value string, normalized string, confidence double")
    q = spark.createDataFrame([(1, "where is rahul sharma?"), (2, "Did 'Amit' call “sharma”?"), (3, "Amit was there"), (4, "क्या विक्रम पाटिल थे"), (5, None), (6, 'about "am"')], "question_id long, question string")
    got = sorted((r["question_id"], r["mention"], r["entity_id"], r["candidates"]) for r in X.link_mentions(q, e).collect())
    assert got == [(1, "Rahul Sharma", 1, 2), (1, "Rahul Sharma", 2, 2), (2, "Amit", 3, 1), (2, "sharma", 1, 2), (2, "sharma", 2, 2), (4, "विक्रम पाटिल", 4, 1), (6, "am", 3, 1)]


def test_vector_hits_in_blocks(spark, monkeypatch):
    """Against all pairs; equal vectors are ties, which go by id."""
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK", 20)
    rng = np.random.default_rng(3)
    x = [list(map(float, v)) for v in rng.normal(size=(70, 8)).round(1)]
    x += [x[0], x[0], [2 * c for c in x[1]], None, [0.0] * 8, [1.0] * 4]
    v = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = {}
    for r in retrieval.vector_hits(v, v.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    for i, own in enumerate(x):
        if i % 5 == 0 and own and any(own):
            near = [(round(1 / (2 - np.dot(own, y) / np.linalg.norm(own) / np.linalg.norm(y)) + 1e-9, 6), j) for j, y in enumerate(x) if y and any(y) and len(y) == len(own)]
            assert got[i] == sorted(near, key=lambda p: (-p[0], p[1]))[:4]


def test_relation_upsert(spark):
    cols = "relation_id long, case_id int, src string, dst string, edge_type string, evidence_id long, confidence double, status string, snippet string, valid_from date"
    day = dt.date(2024, 1, 1)
    old = registry.fold_relations(spark.createDataFrame([(5, 1, "a", "b", "OWNS", 1, 0.5, "confirmed", "s", None), (6, 1, "a", "c", "OWNS", 1, 0.5, "pending", "s", day)], cols))
    new = spark.createDataFrame([(1, 1, "a", "b", "OWNS", 2, 0.9, "pending", "t", day), (2, 1, "a", "c", "OWNS", 2, 0.9, "pending", "t", dt.date(2025, 1, 1)), (3, 1, "a", "d", "OWNS", 2, 0.9, "pending", "t", None), (4, 1, "a", "a", "OWNS", 2, 0.9, "pending", "t", None)], cols)
    got = {r["dst"]: (r["relation_id"], r["confidence"], r["status"], r["valid_from"]) for r in registry.upsert_relations(old, new).collect()}
    assert got == {"b": (5, 0.5, "confirmed", day), "c": (6, 0.5, "pending", day), "d": (3, 0.9, "pending", None)}


def test_names_across_scripts(spark):
    rows = [(1, 1, "राहुल शर्मा"), (2, 1, "rahul sharma"), (3, 1, "rahul s sharma"), (4, 1, "r sharma"), (5, 1, "रोहन शर्मा"), (6, 1, "rohan sharma"), (7, 2, "rahul sharma"), (8, 1, "शर्मा"), (9, 1, "राहुल शर्मा")]
    e = spark.createDataFrame([(i, c, "Person", n) for i, c, n in rows] + [(20, 1, "Location", "पुणे"), (21, 1, "Person", None)], "entity_id long, case_id int, node_type string, normalized string")
    latin = spark.createDataFrame([("राहुल शर्मा", "rahul sharma"), ("राहुल शर्मा", "zz"), ("रोहन शर्मा", "rohan sharma"), ("पुणे", "pune"), (None, "x"), ("y", None)], "normalized string, latin string")
    got = {(r["a_id"], r["b_id"]): (r["score"], r["reason"]) for r in resolve.across_scripts(e, latin).collect()}
    exact = {k: v for k, v in got.items() if not v[1].startswith("xlit-fuzzy")}
    assert exact == {
        (1, 2): (0.85, "xlit-exact-name"), (2, 9): (0.85, "xlit-exact-name"), (5, 6): (0.85, "xlit-exact-name"), (1, 3): (0.78, "xlit-name-subset"), (3, 9): (0.78, "xlit-name-subset"),
        (1, 4): (0.8, "xlit-initial-surname"), (4, 9): (0.8, "xlit-initial-surname"), (4, 5): (0.8, "xlit-initial-surname"),
    }
    assert all(v[0] <= 0.85 for v in got.values()) and (1, 9) not in got and all(7 not in k for k in got)
    both = {(r["a_id"], r["b_id"]): r["reason"] for r in resolve.suggestions(e, latin=latin).collect()}
    assert both[1, 2] == "xlit-exact-name" and both[1, 9] == "exact-name" and both[2, 4] == "initial-surname"
    assert any(7 in k for k in {(r["a_id"], r["b_id"]) for r in resolve.across_scripts(e, latin, across_cases=True).collect()})


def plain_communities(keys, weights):
    """Louvain: one node after another, level by level. weights: {(a, b): w} both ways."""
    of = {k: k for k in keys}
    links, twice = dict(weights), sum(weights.values())
    while True:
        ids = sorted({a for a, _ in links})
        k = {i: sum(w for (a, _), w in links.items() if a == i) for i in ids}
        c, total, moved, again = {i: i for i in ids}, dict(k), False, True
        while again:
            again = False
            for i in ids:
                near = {}
                for (a, b), w in links.items():
                    if a == i and b != i:
                        near[c[b]] = near.get(c[b], 0) + w
                total[c[i]] -= k[i]
                gain = lambda x: near.get(x, 0) - k[i] * total[x] / twice  # noqa: B023, E731
                best = max(sorted(near), key=gain, default=c[i])
                if gain(best) > gain(c[i]) + 1e-9:
                    c[i], moved, again = best, True, True
                total[c[i]] += k[i]
        of = {x: c.get(i, i) for x, i in of.items()}
        if not moved:
            return of
        new = {}
        for (a, b), w in links.items():
            new[c[a], c[b]] = new.get((c[a], c[b]), 0) + w
        links = new


def test_communities_settle_and_hang_together(spark):
    """Modularity is about a plain version's or above, no node gains by moving, and every community is connected."""
    import random

    rng = random.Random(2)
    keys = [f"n{i:03d}" for i in range(120)]
    pairs = {tuple(sorted((keys[i], keys[j]))) for i in range(120) for j in range(i) if rng.random() < (0.25 if i // 15 == j // 15 else 0.01)}
    e = spark.createDataFrame([(a, b, 0.5 + rng.random() / 2) for a, b in sorted(pairs)], "src string, dst string, confidence double")
    n = spark.createDataFrame([(k,) for k in keys] + [("zz",)], "key string")
    found = metrics.communities(n, e)
    got = {r["key"]: r["community"] for r in found.collect()}
    weights = {}
    for r in e.collect():
        weights[r["src"], r["dst"]] = weights[r["dst"], r["src"]] = r["confidence"]
    plain = plain_communities([*keys, "zz"], weights)
    frame = spark.createDataFrame(list(plain.items()), "key string, community string")
    assert got["zz"] == "zz" and metrics.modularity(e, found) >= metrics.modularity(e, frame) - 0.02
    for c in set(got.values()):
        own = {k for k in got if got[k] == c}
        reach = front = {c}
        while front:
            front = {b for a, b in weights if a in front and b in own} - reach
            reach = reach | front
        assert reach == own and min(own) == c


def test_vector_hits_of_several_blocks(spark, monkeypatch):
    """Each block of vectors meets each block of queries, in whichever task."""
    from dossier.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCK", 16)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        v = spark.createDataFrame([(i, [float(i % 7 + 1), float(i * i % 11), float(i % 13)]) for i in range(100)], "vec_id long, embedding array<float>")
        q = v.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id")
        best = {(r.query_id, r.vec_id, r.score) for r in retrieval.vector_hits(v, q, 1).collect()}
    finally:
        spark.conf.set(coalesce, before)
    assert {(i, s) for i, _, s in best} == {(i, 1.0) for i in range(0, 100, 2)}


def test_path_answers_of_nodes_that_share_a_key(spark):
    """A step is told once, however many rows bear its key."""
    from dossier.operators import retrieval

    paths = spark.createDataFrame([("a", "c", 2, "a > b > c")], "a string, b string, hops int, path string")
    names = spark.createDataFrame([("a", "A"), ("a", "A"), ("b", "B"), ("b", "B"), ("b", "B")], "key string, value string")
    assert [r["answer"] for r in retrieval.path_answers(paths, names).collect()] == ["Confirmed connection (2 hop(s)): A → B → c"]


def test_ratios_of_many_pairs_at_once():
    """As difflib's, for short and long common parts, ties, blanks and letters beyond one code unit."""
    import random

    import pandas as pd

    rng = random.Random(3)
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    names = [*[f"supplier#{rng.randrange(60_000):09d}" for _ in range(400)], *[made("ab", 12) for _ in range(400)], *[made("abc é𝒳#", 65) for _ in range(400)]]
    pairs = [(a, rng.choice(names) if rng.random() < 0.6 else a[: len(a) // 2] + rng.choice("ab#x") + a[len(a) // 2 + 1 :]) for a in names for _ in range(3)]
    got = resolve.short_ratios(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert list(got) == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_names_of_one_block_are_dealt_to_tasks(spark):
    """A block's pairs are not one task's work, and none is lost or made twice; cut plates meet longer ones."""
    names = [("Organization", f"supplier#{i:09d}", 1) for i in range(1500)] + [("Vehicle", p, 1) for p in ("mh0000012", "mh0000013", "mh00000123", "mh00000129")]
    df = spark.createDataFrame(names, "node_type string, normalized string, n long")
    pairs = resolve.name_pairs(df).withColumn("task", F.spark_partition_id())
    orgs = pairs.filter("node_type = 'Organization'")
    most, n, different = orgs.groupBy("task").count().agg(F.max("count"), F.sum("count"), F.count("*")).first()
    assert n == 1500 * 1499 // 2 == orgs.select("a", "b").distinct().count() and most < 0.7 * n and different > 2
    plates = {(r["a"], r["b"]) for r in pairs.filter("node_type = 'Vehicle'").collect()}
    assert plates == {("mh0000012", "mh00000123"), ("mh0000012", "mh00000129"), ("mh00000123", "mh0000013"), ("mh00000123", "mh00000129")}


def test_communities_settle_within_pieces(spark, monkeypatch):
    """One pass over the links of a level is enough where parts fit into pieces; parts that are cut get as good communities."""
    import random

    rng = random.Random(4)
    pairs = {(min(i, j), max(i, j)) for i in range(240) for j in range(240) if i != j and i // 80 == j // 80 and rng.random() < (0.3 if i // 10 == j // 10 else 0.01)}
    e = spark.createDataFrame([(a, b, 0.5 + rng.random() / 2) for a, b in sorted(pairs)], "src long, dst long, confidence double")
    n = spark.createDataFrame([(i,) for i in range(240)], "key long")
    written, keep = [], metrics.stored
    monkeypatch.setattr(metrics, "stored", lambda df, name: written.append(name) or keep(df, name))
    found = metrics.communities(n, e)
    assert written.count("options") == written.count("moved") > 1 and "connected" not in written
    best = metrics.modularity(e, found)
    monkeypatch.setattr(metrics, "PIECE", 300)
    cut = metrics.communities(n, e)
    assert cut.count() == 240 == found.count() and best > 0.5 and metrics.modularity(e, cut) > best - 0.05
