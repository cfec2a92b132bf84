"""The registry as a log of micro-batches, errors of stages, and alerts routed on a stream, against their batch forms."""

import datetime as dt
import os

import numpy as np
import pytest

from dossier.operators import alerts, registry
from dossier.operators import text as X
from dossier.streaming.evidence import RegistryStore, evidence_stream
from dossier.streaming.registry import Log

SIGHTING = "case_id int, node_type string, normalized string, value string, evidence_id long, confidence double, engine string, snippet string, seen long"
RELATION = "relation_id long, case_id int, src string, dst string, edge_type string, evidence_id long, confidence double, status string, snippet string, valid_from date"


def made(seed, batches):
    """Sightings and relations by batch; some evidence comes again in later batches."""
    rng = np.random.default_rng(seed)
    seen, links = [], []
    for _ in range(batches):
        ids = rng.integers(0, 40, 12)
        seen.append([(int(e) % 3, "Person", f"n{(e * 7 + k) % 9}", f"N{e}", int(e), float(round(rng.random(), 2)), f"g{k}", f"s{e}", int(e)) for e in ids for k in range(2)])
        day = lambda e: dt.date(2026, 1, 1 + int(e) % 28) if rng.random() < 0.5 else None
        links.append([(int(e), int(e) % 3, f"n{e % 4}", f"n{(e + k) % 5}", "CALLED", int(e), float(round(rng.random(), 2)), "pending", f"s{e}", day(e)) for e in ids for k in range(2)])
    return seen, links


@pytest.mark.parametrize("fanout", [2, 8])
def test_registry_log(spark, tmp_path, fanout):
    seen, links = made(1, 9)
    store = RegistryStore(spark, str(tmp_path / "r"), fanout)
    for n in range(9):
        store.apply(spark.createDataFrame(seen[n], SIGHTING), n)
        store.link(spark.createDataFrame(links[n], RELATION), n)
        if n == 5:
            for _ in range(2):  # a batch that runs again
                store.apply(spark.createDataFrame(seen[n], SIGHTING), n)
                store.link(spark.createDataFrame(links[n], RELATION), n)
    for n in (0, 4, 8):
        want = {}
        for rows in seen[: n + 1]:
            for c, t, name, value, e, conf, engine, snippet, _ in sorted(rows, key=lambda r: (r[8], r[3])):
                w = want.setdefault((c, t, name), {"value": value, "evidence": e, "ids": set(), "conf": 0.0})
                w["ids"].add(e)
                w["conf"] = max(w["conf"], conf)
        got = {(r["case_id"], r["node_type"], r["normalized"]): (r["value"], r["evidence_id"], r["mention_count"], r["confidence"], r["status"]) for r in store.version(n).collect()}
        assert got == {k: (w["value"], w["evidence"], len(w["ids"]), w["conf"], "pending") for k, w in want.items()}
        state = spark.createDataFrame([], RELATION)
        for rows in links[: n + 1]:
            state = registry.upsert_relations(state, spark.createDataFrame(rows, RELATION))
        cols = ["case_id", "src", "dst", "edge_type", "relation_id", "evidence_id", "status", "snippet"]
        assert sorted(map(tuple, store.links(n).select(*cols).collect())) == sorted(map(tuple, state.select(*cols).collect()))
        dates = lambda df: {(r["src"], r["dst"], r["case_id"]): r["valid_from"] is None for r in df.collect()}
        assert dates(store.links(n)) == dates(state)
    before = sorted(map(tuple, store.version(8).collect()))
    assert store.vacuum(8) > 0 and store.vacuum(8) == 0
    assert sorted(map(tuple, store.version(8).collect())) == before
    store.apply(spark.createDataFrame(seen[8], SIGHTING), 8)
    assert sorted(map(tuple, store.version(8).collect())) == before


def test_cost_of_a_batch_follows_the_batch(spark, tmp_path):
    """Rows written in all grow with batches times the logarithm of their number, not with their square; a reader opens few runs."""
    log = Log(spark, str(tmp_path / "log"), "k long, v long", lambda rows: rows.distinct(), 4)
    written = []
    log.merge = lambda rows: written.append(rows.distinct().count()) or rows.distinct()
    for n in range(17):
        log.append(spark.createDataFrame([(n * 10 + i, i) for i in range(10)], "k long, v long"), n)
    assert sum(written) == 170 + 160 + 160 and log.runs(17) == [(0, 16), (16, 17)] and log.runs(15) == [(0, 4), (4, 8), (8, 12), (12, 13), (13, 14), (14, 15)]
    assert log.rows(16).count() == 170 and log.rows(-1).count() == 0 and log.runs(0) == []


def test_a_failed_stage_is_recorded(spark, tmp_path, monkeypatch):
    schema = "evidence_id long, case_id int, text string"
    rows = [(1, 1, "Rahul Sharma called Vikram Patil."), (2, 1, "Anita Rao met Rahul Sharma.")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    os.mkdir(tmp_path / "in")
    for i in range(2):
        for f in (tmp_path / f"p{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
    whole, calls = X.extract_relations, []

    def broken(evidence, entities, longest=None):
        calls.append(1)
        return whole(evidence, entities, longest) if len(calls) > 1 else evidence.select("no_such_column")

    monkeypatch.setattr(X, "extract_relations", broken)
    store = RegistryStore(spark, str(tmp_path / "r"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    evidence_stream(stream, store, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    errors = spark.read.parquet(str(tmp_path / "out" / "errors")).collect()
    assert [(r["stage"], r["batch"]) for r in errors] == [("relations", 0)] and "no_such_column" in errors[0]["error"]
    assert sorted((r["normalized"], r["mention_count"]) for r in store.version(1).collect()) == [("anita rao", 1), ("rahul sharma", 2), ("vikram patil", 1)]
    assert [(r["src"], r["edge_type"], r["dst"]) for r in store.links(1).collect()] == [("Person:anita rao", "ASSOCIATED_WITH", "Person:rahul sharma")]
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == 2


def test_alerts_are_routed_alike_on_a_stream(spark, tmp_path):
    """Random alerts, rules and rights: a plain version, the batch form and the stream in several micro-batches agree."""
    rng = np.random.default_rng(6)
    kinds, levels = ["cross_case", "risk", "connection"], ["low", "medium", "high"]
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    made = [(f"a{i}", int(rng.integers(0, 6)), pick(kinds), pick(levels), float(np.round(rng.random(), 2)), pick([None, "s0", "s1", "s2", "s9"])) for i in range(60)]
    rules = [(int(u), pick([*kinds, "any"]), pick([None, None, 1, 2]), pick(levels), float(np.round(rng.random() / 2, 2)), bool(rng.random() < 0.8)) for u in rng.integers(0, 8, 20)]
    sees = [(int(u), int(c)) for u, c in zip(rng.integers(0, 8, 40), rng.integers(0, 5, 40), strict=True)]
    named = [("s0", 1), ("s0", 2), ("s1", 3), ("s1", 77), ("s2", 0), ("s2", 1), ("s2", 4)]
    known, rank = {c for _, c in sees}, {"low": 0, "medium": 1, "high": 2}
    want = {
        (u, i) for i, c, k, sev, conf, subject in made for u in range(8)
        if (u, c) in sees and any(r[0] == u and r[5] and r[1] in (k, "any") and r[2] in (None, c) and rank[sev] >= rank[r[3]] and conf >= r[4] for r in rules)
        and all((u, x) in sees for s, x in named if s == subject and x in known)
    }
    schema = "alert_id string, case_id int, kind string, severity string, confidence double, subject string"
    static = (spark.createDataFrame(rules, "user_id int, kind string, case_id int, min_severity string, min_confidence double, enabled boolean"), spark.createDataFrame(sees, "user_id int, case_id int"), spark.createDataFrame(named, "subject string, case_id int"))
    batch = alerts.routed(spark.createDataFrame(made + made[:5], schema), *static)
    assert {tuple(r) for r in batch.collect()} == want and batch.count() == len(want) > 10
    os.mkdir(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(made[i * 20 : i * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        for f in (tmp_path / f"p{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = alerts.routed(stream, *static).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out"))
    out.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
