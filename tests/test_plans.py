"""Every query with an SQL form against DuckDB on the smallest tables; the others run."""

import math
import re
from collections import Counter

import pytest
from conftest import SF, same

from dossier.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, sf, name):
    same(QUERIES[name](spark, sf), duck.sql(ORACLE_SQL[name]))


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).head(1)) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def whole_graph(duck):
    """(nodes, edges) of the confirmed graph as plain rows."""
    from dossier.plans.graphs import GRAPH
    from dossier.sources.domain import with_sql

    nodes = {k: (c, t, i) for k, c, t, i in duck.sql(with_sql(*GRAPH) + "select key, case_id, node_type, entity_id from nodes").fetchall()}
    return nodes, duck.sql(with_sql(*GRAPH) + "select src, dst from edges").fetchall()


def levels(near, start):
    """(hops, numbers of shortest paths) of all nodes reached from start, nearest first."""
    hops, paths, front = {start: 0}, {start: 1}, [start]
    for v in front:
        for w in near.get(v, ()):
            if w not in hops:
                hops[w], paths[w] = hops[v] + 1, 0
                front.append(w)
            if hops[w] == hops[v] + 1:
                paths[w] += paths[v]
    return hops, paths


def brute_betweenness(nodes, edges):
    """By pairs: the share of the shortest paths from s to t that lead through v."""
    near = {}
    for a, b in set(edges):
        near.setdefault(a, set()).add(b)
    found = {s: levels(near, s) for s in nodes}
    out = dict.fromkeys(nodes, 0.0)
    for s, (hops, paths) in found.items():
        for v in hops:
            for t, more in found[v][0].items():
                if v not in (s, t) and s != t and hops[t] == hops[v] + more:
                    out[v] += paths[v] * found[v][1][t] / paths[t]
    return out


def test_whole_graph(spark, duck, sf):
    """What has no SQL form, and betweenness, over all confirmed edges against brute force."""
    from dossier.plans.graphs import GRAPH
    from dossier.sources.domain import with_sql

    nodes, edges = whole_graph(duck)
    want = brute_betweenness(nodes, edges)
    assert {r["key"]: r["betweenness"] for r in QUERIES["betweenness"](spark, sf).collect()} == pytest.approx(want, abs=1e-5)
    degree, near = dict.fromkeys(nodes, 0), {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            degree[x] += 1
            near.setdefault(x, set()).add(y)
    community = {r["key"]: r["community"] for r in QUERIES["communities"](spark, sf).collect()}
    assert set(community) == set(nodes)
    spans = {k: len({community[x] for x in near.get(k, ())}) for k in nodes}
    got = {r["key"]: r for r in QUERIES["community_bridges"](spark, sf).collect()}
    assert set(got) == {k for k in nodes if spans[k] >= 2 or (want[k] > 0 and degree[k] >= 2)} and all((r["degree"], r["spans"]) == (degree[k], spans[k]) for k, r in got.items())
    sizes = Counter(community.values())
    assert {(r["key"], r["community"], r["size"]) for r in QUERIES["community_rosters"](spark, sf).collect()} == {(k, c, sizes[c]) for k, c in community.items()}
    named = {k: v for k, v in duck.sql(with_sql(*GRAPH) + "select key, value from nodes").fetchall()}
    told = QUERIES["path_answers"](spark, sf).collect()
    hops = {(r["a"], r["b"]): r["hops"] for r in QUERIES["shortest_paths"](spark, sf).collect() if r["hops"]}
    assert len(told) == len(hops) and {(r["a"], r["b"]) for r in told} == set(hops)
    for r in told:
        head, steps = r["answer"].split(": ", 1)
        steps = steps.split(" → ")
        assert head == f"Confirmed connection ({hops[r['a'], r['b']]} hop(s))" and len(steps) == hops[r["a"], r["b"]] + 1
        assert (steps[0], steps[-1]) == (named[r["a"]], named[r["b"]])


def test_betweenness_of_a_long_chain(spark):
    from dossier.operators import metrics

    n = 70
    keys = [f"k{i:02}" for i in range(n)]
    e = spark.createDataFrame(list(zip(keys, keys[1:])), "src string, dst string")
    start = spark.createDataFrame([(keys[0],)], "key string")
    got = {r["key"]: r["betweenness"] for r in metrics.betweenness(spark.createDataFrame([(k,) for k in keys], "key string"), e, sources=start).collect()}
    assert got == {k: float(max(0, n - 1 - i)) if i else 0.0 for i, k in enumerate(keys)}


def brute_score(kind, a, b):
    """(score, reason) of two names of a type, or none; names in blocks that meet."""
    import difflib
    import re

    if kind == "PhoneNumber":
        return (1.0, "same-phone") if a == b else None
    near = difflib.SequenceMatcher(None, a, b).ratio()
    if kind == "Vehicle":
        shorter = lambda x: {x} | {x[:i] + x[i + 1 :] for i in range(len(x))}
        return (1.0, "same-plate") if a == b else (round(near, 3), "fuzzy-plate") if near >= 0.9 and shorter(a) & shorter(b) else None
    if kind in ("Location", "Organization"):
        first = lambda x: re.sub("[^a-z]", "", x)[:2]
        return None if first(a) != first(b) or not first(a) else (0.90, "exact") if a == b else (round(near * 0.9, 3), "fuzzy") if near >= 0.85 else None
    ta, tb = ([t for t in re.split(r"[\s.\-]+", x) if t] for x in (a, b))
    if kind != "Person" or ta[-1] != tb[-1] or ta[0][0] != tb[0][0]:
        return None
    if a == b:
        return 0.95, "exact-name"
    if min(len(ta[0]), len(tb[0])) == 1 < max(len(ta[0]), len(tb[0])):
        return 0.80, "initial-surname"
    if len(ta) != len(tb) and (set(ta) <= set(tb) if len(ta) < len(tb) else set(tb) <= set(ta)):
        return 0.78, "name-subset"
    mixed = 0.5 * near + 0.5 * len(set(ta) & set(tb)) / len(set(ta) | set(tb))
    return (round(min(mixed, 0.94), 3), "fuzzy-name") if mixed >= 0.75 else None


def test_suggestions_of_all_types(spark, duck, sf):
    """Against all pairs of names of one type."""
    from itertools import combinations

    from dossier.sources.domain import ENTITIES_SQL, with_sql

    kinds, want = {}, {}
    for kind, name, n in duck.sql(with_sql(ENTITIES_SQL) + "select node_type, normalized, count(*) from entities group by 1, 2 order by 2").fetchall():
        kinds.setdefault(kind, []).append((name, n))
    for kind, own in kinds.items():
        for (a, m), (b, n) in [*combinations(own, 2), *[(x, x) for x in own if x[1] > 1]]:
            if (found := brute_score(kind, a, b)) and found[0] >= 0.75:
                want[kind, a, b] = (*found, m, n)
    got = {(r["node_type"], r["a"], r["b"]): (r["score"], r["reason"], r["a_n"], r["b_n"]) for r in QUERIES["entity_suggestions"](spark, sf).collect()}
    assert got.keys() == want.keys() and {k: x[1:] for k, x in got.items()} == {k: x[1:] for k, x in want.items()}
    assert all(abs(got[k][0] - want[k][0]) <= 0.0011 for k in got) and {k[0] for k in got} > {"Vehicle"}


def test_ranked_terms(spark, sf):
    """BM25 against a plain version over the same chunks."""
    from dossier.operators import retrieval
    from dossier.plans.texts import evidence

    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if len(w) > 2]
    chunks = {(r["evidence_id"], r["chunk_index"]): words(r["chunk"]) for r in retrieval.chunks(evidence(spark, sf)).collect()}
    asked = {r["item_id"]: set(words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    df = Counter(w for t in chunks.values() for w in set(t))
    mean = sum(map(len, chunks.values())) / len(chunks)
    want = {}
    for (e, i), text in chunks.items():
        tf = Counter(text)
        for q, terms in asked.items():
            some = [w for w in terms if tf[w]]
            if some:
                want[q, e, i] = sum(math.log(1 + (len(chunks) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(text) / mean)) for w in some)
    got = {(r["query_id"], r["evidence_id"], r["chunk_index"]): r["score"] for r in QUERIES["ranked_terms"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in got)


def test_every_document_and_question(spark, tmp_path):
    """A row for each, markers and paths among them."""
    d = [(1, "src0", "the IMEI and MSISDN"), (2, "src0", "First Information Report of the police station"), (3, "src0", "a witness statement; the deponent"), (4, "src1", "tower"), (5, "src2", None), (6, "src0", "IFSC, branch"), (7, "src3", "x"), (8, "src0", "roaming")]
    spark.createDataFrame(d, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["evidence_id"]: (r["label"], r["reason"]) for r in QUERIES["classified_documents"](spark, str(tmp_path)).collect()}
    content = "content-markers"
    assert got == {1: ("cdr", content), 2: ("fir", content), 3: ("witness_statement", content), 4: ("cdr", "spreadsheet-default"), 5: ("audio_transcript", "extension"), 6: ("bank_statement", content), 7: ("document", "pdf-default"), 8: ("other", "fallback")}
    q = [(1, 0, "How is Rahul  Sharma connected to Vikram?"), (1, 1, "A -> B"), (2, 0, "link between 'X' and Y?"), (2, 1, None), (3, 0, "status of the case"), (3, 1, "how are you"), (4, 0, "relation between us"), (4, 1, "A → ")]
    spark.createDataFrame(q, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["conv_id"], r["turn"]): (r["intent"], r["a"], r["b"]) for r in QUERIES["question_intents"](spark, str(tmp_path)).collect()}
    assert got == {
        (1, 0): ("path", "Rahul Sharma", "Vikram"), (1, 1): ("path", "A", "B"), (2, 0): ("path", "X", "Y"), (2, 1): ("generic", None, None),
        (3, 0): ("summary", None, None), (3, 1): ("generic", None, None), (4, 0): ("generic", None, None), (4, 1): ("generic", None, None),
    }


def test_sampled_betweenness(spark):
    """All sources are the exact measure; a share of them is near it."""
    from dossier.operators import metrics

    edges = [(f"k{i}", f"k{(i * 7 + j) % 60}") for i in range(60) for j in range(1, 4)]
    n = spark.createDataFrame([(f"k{i}",) for i in range(60)], "key string")
    e = spark.createDataFrame(edges, "src string, dst string")
    exact, all_of_it, half = (sum(r["betweenness"] for r in df.collect()) for df in (metrics.betweenness(n, e), metrics.sampled_betweenness(n, e, 1.0), metrics.sampled_betweenness(n, e, 0.5)))
    assert all_of_it == pytest.approx(exact) and half == pytest.approx(exact, rel=0.3)


def test_estimated_betweenness_keeps_its_margins(spark):
    """A graph of many like parts: a share of the sources is enough, and every node is within its margin."""
    from dossier.operators import metrics

    edges = [(f"g{g}-{i}", f"g{g}-{(i * 3 + j) % 8}") for g in range(300) for i in range(8) for j in (1, 2)]
    n = spark.createDataFrame([(f"g{g}-{i}",) for g in range(300) for i in range(8)], "key string")
    e = spark.createDataFrame([x for x in edges if x[0] != x[1]], "src string, dst string")
    exact = {r["key"]: r["betweenness"] for r in metrics.betweenness(n, e).collect()}
    for error, sampled in ((0.25, True), (0.0001, False)):
        got = metrics.estimated_betweenness(n, e, error=error).collect()
        assert len(got) == len(exact) and all(abs(r["betweenness"] - exact[r["key"]]) <= r["margin"] + 1e-6 for r in got)
        assert all((r["margin"] > 0) == sampled and r["margin"] <= error * 2400 * 7 for r in got)
    empty = metrics.estimated_betweenness(n.limit(0), e.limit(0))
    assert empty.collect() == [] and empty.columns == ["key", "betweenness", "margin"]


def test_pagerank_of_hubs(spark, monkeypatch):
    """Ranks are the same whichever way a source's links are dealt."""
    from dossier.operators import metrics

    edges = [("hub", f"k{i}", 0.2 + i % 5 / 10) for i in range(40)] + [(f"k{i}", f"k{i * 7 % 40}", 0.5) for i in range(40)] + [("k3", "hub", None)]
    n = spark.createDataFrame([("hub",), ("alone",)] + [(f"k{i}",) for i in range(40)], "key string")
    e = spark.createDataFrame(edges, "src string, dst string, confidence double")
    ranks = lambda: {r["key"]: r["pagerank"] for r in metrics.pagerank(n, e, rounds=6).collect()}
    usual = ranks()
    monkeypatch.setattr(metrics, "HUB", 10)
    assert ranks() == pytest.approx(usual) and usual["alone"] == pytest.approx(0.15)


def test_pagerank_rounds_go_over_nodes_that_lead_on(spark, monkeypatch):
    """Against plain sums; ends without links of their own, most nodes of a graph, have ranks in the last round alone."""
    from dossier.operators import metrics

    edges = [("a", "b", 0.5), ("b", "a", 1.0), ("b", "c", 0.25), ("c", "a", None)] + [(x, f"end{i}", 0.1 + i % 3) for i in range(60) for x in "ab"[: 1 + i % 2]]
    n = spark.createDataFrame([(k,) for k in sorted({k for e in edges for k in e[:2]}) + ["alone"]], "key string")
    written, keep = [], metrics.stored
    monkeypatch.setattr(metrics, "stored", lambda df, name: (out := keep(df, name), written.append(out.count()) if name == "ranks" else None)[0])
    for rounds in (0, 1, 6):
        written.clear()
        got = {r["key"]: r["pagerank"] for r in metrics.pagerank(n, spark.createDataFrame(edges, "src string, dst string, confidence double"), rounds=rounds).collect()}
        want = dict.fromkeys(got, 1.0)
        weight = lambda c: 0.5 if c is None else c
        total = {k: sum(weight(c) for s, _, c in edges if s == k) for k in want}
        for _ in range(rounds):
            want = {k: 0.15 + 0.85 * sum(want[s] * weight(c) / total[s] for s, d, c in edges if d == k) for k in want}
        assert len(got) == 64 and got == pytest.approx(want)
        assert all(m == 3 for m in written[:-1]) and written[-1:] == [64][: min(rounds, 1)]


def test_scores_read_entities_once(spark, sf, monkeypatch):
    """What the tables say of entities is put together once for the graph and for the cases that share a name."""
    from dossier.plans import graphs

    calls, plain = [], graphs.D.entities
    monkeypatch.setattr(graphs.D, "entities", lambda *args: (calls.append(args), plain(*args))[1])
    assert QUERIES["risk_scores"](spark, sf).count() and len(calls) == 1


def brute_path(edges, a, b, most):
    """The shortest path, then the most confident edge by edge, then the smallest keys: over all walks without a step back."""
    best = {}
    for s, d, kind, c in edges:
        for x, y in ((s, d), (d, s)):
            best.setdefault(x, {})[y] = max(best.get(x, {}).get(y, (-1.0, "")), (c, kind))
    front = [((), (a,), ())]
    for _ in range(most + 1):
        if hits := [p for p in front if p[1][-1] == b]:
            cost, path, kinds = min(hits)
            return len(path) - 1, " > ".join(path), ",".join(kinds)
        front = [(cost + (-c,), path + (y,), kinds + (kind,)) for cost, path, kinds in front for y, (c, kind) in best.get(path[-1], {}).items() if y not in path]
    return None


def test_paths_from_one_or_both_ends(spark):
    """Equal to all walks, with ties, parallel edges, unknown ends, repeated pairs and pairs of one node."""
    import random

    from dossier.operators import graph as G

    rng = random.Random(4)
    edges = [(f"k{rng.randrange(26):02}", f"k{rng.randrange(26):02}", rng.choice("PQ"), rng.randrange(1, 4) / 4) for _ in range(38)]
    edges = [x for x in edges if x[0] != x[1]]
    e = spark.createDataFrame(edges, "src string, dst string, edge_type string, confidence double")
    pairs = [(f"k{rng.randrange(26):02}", f"k{rng.randrange(26):02}") for _ in range(60)] + [("k01", "gone"), ("gone", "k01"), ("gone", "gone"), ("k02", "k02"), ("k02", "k02"), (None, "k01")]
    p = spark.createDataFrame(pairs, "a string, b string")
    for most, many in ((1, 100), (4, 0), (4, 100), (5, 3)):
        want = {(a, b): found for a, b in pairs if a is not None and (found := brute_path(edges, a, b, most))}
        got = [((r["a"], r["b"]), (r["hops"], r["path"], r["evidence"])) for r in G.shortest_paths(e, p, most, many).collect()]
        assert len(got) == len(dict(got)) and dict(got) == want


def test_places_in_hot_groups(spark):
    """Against sorting: a group of most rows, null groups and keys, descending order."""
    from pyspark.sql import functions as F

    from dossier.operators.ranking import ranked

    rows = [("hot" if i % 5 else None if i % 10 else f"g{i}", i % 97, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, id long").repartition(6)
    got = {r["id"]: r["rank"] for r in ranked(df, ["g"], [F.desc("x"), F.col("id")]).collect()}
    groups = {}
    for g, x, i in rows:
        groups.setdefault(g, []).append((-x, i))
    assert got == {i: n for own in groups.values() for n, (_, i) in enumerate(sorted(own), 1)}
    assert ranked(df.limit(0), ["g"], [F.col("id")]).collect() == []


def test_only_what_a_query_shows_is_computed(spark, sf, monkeypatch):
    """Overviews and top players need no betweenness; names that several entities bear need not meet all others."""
    from dossier.operators import metrics, resolve

    def refuse(*args, **kwargs):
        raise AssertionError("not needed")

    monkeypatch.setattr(metrics, "betweenness", refuse)
    monkeypatch.setattr(resolve, "candidates", refuse)
    for name in ("graph_overview", "top_players", "cross_case_matches"):
        assert QUERIES[name](spark, sf).columns


def test_distances_are_those_of_the_shortest_paths(spark):
    """More than 64 starts, a pair of equal ends, ends without a path, a repeated pair; the query keeps no paths."""
    from dossier.operators import graph as G

    e = spark.createDataFrame([(f"n{i:03}", f"n{(i * 7 + k) % 150:03}", "OWNS", 0.5) for i in range(150) for k in (1, 5)] + [("x", "y", "OWNS", 0.5)], "src string, dst string, edge_type string, confidence double")
    pairs = spark.createDataFrame([(f"n{i:03}", f"n{(i * j) % 150:03}") for i in range(150) for j in (1, 2, 31)] + [("n000", "x"), ("x", "y"), ("x", "y")], "a string, b string")
    for hops in (1, 2, 4):
        got = sorted(map(tuple, G.distances(e, pairs, hops).collect()))
        assert got == sorted(map(tuple, G.shortest_paths(e, pairs, hops).select("a", "b", "hops").collect()))
    assert len({r[0] for r in got}) > 64 and {r[2] for r in got} >= {0, 1, 2, 3}


def test_distances_of_pairs_and_of_starts_with_all_ends(spark):
    """Either way of searching, with self links, unknown and null ends, and ends of another case, against the paths."""
    import random

    from dossier.operators import graph as G

    rng = random.Random(7)
    e = spark.createDataFrame([(f"k{rng.randrange(40):02}", f"k{rng.randrange(40):02}", "P", 0.5) for _ in range(48)], "src string, dst string, edge_type string, confidence double")
    asked = [(f"k{rng.randrange(40):02}", f"k{rng.randrange(40):02}") for _ in range(90)] + [("gone", "k01"), ("gone", "gone"), ("k02", "k02"), ("k03", "k03"), ("k03", "k03"), (None, "k01"), ("k01", None)]
    pairs = spark.createDataFrame(asked, "a string, b string")
    for hops in (1, 4, 5):
        want = sorted(map(tuple, G.shortest_paths(e, pairs, hops).select("a", "b", "hops").collect()))
        for many in (0, 3) if hops == 5 else (3,):
            assert sorted(map(tuple, G.distances(e, pairs, hops, many).collect())) == want
    starts = spark.createDataFrame([(f"k{i:02}", i % 2) for i in range(40)] + [("gone", 0)], "a string, case_id int")
    ends = spark.createDataFrame([(f"k{i:02}", i % 2, i) for i in range(0, 40, 3)], "b string, case_id int, n int")
    both = starts.join(ends, "case_id").select("a", "b")
    got = G.reached(e, starts, ends, 4)
    assert sorted(got.columns) == ["a", "b", "hops", "n"]
    assert sorted(map(tuple, got.select("a", "b", "hops").collect())) == sorted(map(tuple, G.shortest_paths(e, both, 4).select("a", "b", "hops").collect()))


def kept_rows(monkeypatch):
    """Rows that graph reads write, by what they are."""
    from dossier.operators import graph as G

    rows, plain = {}, G.stored

    def counting(df, name):
        out = plain(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(G, "stored", counting)
    return rows


def test_pairs_of_few_ends_cost_no_front_over_the_graph(spark, monkeypatch):
    """A pair meets step by step; hubs are pairs of their own once, however many pairs come to them."""
    from dossier.operators import graph as G

    links = [(f"p{i:04}", f"h{i % 2}", "AT", 0.5) for i in range(4000)] + [("p0000", "h1", "AT", 0.5)]
    e = spark.createDataFrame(links, "src string, dst string, edge_type string, confidence double")
    pairs = spark.createDataFrame([(f"p{i:04}", f"p{i + 1 + i % 3:04}") for i in range(2, 200)], "a string, b string")
    kept = kept_rows(monkeypatch)
    got = {(r["a"], r["b"]): r["hops"] for r in G.distances(e, pairs).collect()}
    assert got == {(f"p{i:04}", f"p{i + 1 + i % 3:04}"): 2 if i % 3 == 1 else 4 for i in range(2, 200)}
    assert kept.get("front", 0) == 0 and kept["step"] < 4000


def test_shortest_paths_write_no_pairs(spark, sf, monkeypatch):
    """The query's pairs are the square of a case's nodes; fronts are kept for 64 starts in a row, pairs are not."""
    kept = kept_rows(monkeypatch)
    assert QUERIES["shortest_paths"](spark, sf).count() and "pairs" not in kept and kept["front"] > 0


def test_betweenness_by_parts(spark, monkeypatch):
    """Parts, ends of one and of several parts, loops and parallel edges against brute force: in tasks, in small bites, and level by level."""
    import random

    from dossier.operators import metrics

    def refuse(*args, **kwargs):
        raise AssertionError("not needed")

    rng = random.Random(5)
    edges = [(f"{g}{rng.randrange(20):02}", f"{g}{rng.randrange(20):02}") for g in "pq" for _ in range(45)]
    edges += [(f"{g}{rng.randrange(20):02}", f"end{rng.randrange(12)}") for g in "pq" for _ in range(25)] + [("lone", "end1"), ("lone", "only"), ("p00", "p00"), ("p01", "p02"), ("p01", "p02")]
    nodes = sorted({x for e in edges for x in e} | {"apart"})
    n, e = spark.createDataFrame([(k,) for k in nodes], "key string"), spark.createDataFrame(edges, "src string, dst string")
    want = brute_betweenness(nodes, [x for x in edges if x[0] != x[1]])
    got = lambda **of: {r["key"]: r["betweenness"] for r in metrics.betweenness(n, e, **of).collect()}
    with monkeypatch.context() as patched:
        patched.setattr(metrics, "_dependencies", refuse)
        assert got() == pytest.approx(want) and max(want.values()) > 1
        patched.setattr(metrics, "CELLS", 1)
        patched.setattr(metrics, "WORK", 100)
        assert got() == pytest.approx(want)
        drawn = spark.createDataFrame([("p01",), ("q03",), ("lone",), ("gone",)], "key string")
        some = got(sources=drawn)
    assert got(sources=drawn, max_depth=50) == pytest.approx(some)
    monkeypatch.setattr(metrics, "PART_LINKS", 1)
    assert got() == pytest.approx(want)


def test_lines_are_shuffled_once(spark, sf):
    """Orders meet customers before lines meet orders, so lines go by their order alone."""
    from dossier.sources import domain

    plan = domain.relations(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and "l_orderkey" in joins[0] and "c_custkey" in joins[1]


@pytest.fixture(scope="module")
def alike(tmp_path_factory):
    """Three copies of the smallest tables with shifted keys, in which customers keep their names: persons share a key."""
    import duckdb

    out, own = tmp_path_factory.mktemp("alike"), {"customer": ("c_custkey",), "orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey")}
    for name in ("customer", "orders", "lineitem", "nation", "region"):
        shifted = ", ".join(f"({k} + i * 1000000)::bigint as {k}" for k in own.get(name, ()))
        rows = f"(select t.* {f'replace ({shifted})' if shifted else ''} from '{SF}/{name}.parquet' t, range({3 if shifted else 1}) r(i))"
        duckdb.sql(f"copy {rows} to '{out}/{name}.parquet' (format parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["components", "view_clusters"])
def test_nodes_of_one_key_against_sql(spark, alike, name):
    import duckdb

    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "nation", "region"):
        c.execute(f"create view {t} as select * from '{alike}/{t}.parquet'")
    assert same(QUERIES[name](spark, alike), c.sql(ORACLE_SQL[name]))


def test_nodes_of_one_key_are_not_multiplied(spark, alike):
    """Metrics have one row a key, so that the case metrics have as many rows as the nodes."""
    from dossier.plans import graphs

    n, _, m = graphs.case_metrics(spark, alike)
    assert m.count() == n.count() > n.select("key").distinct().count()


def test_numbers_follow_the_keys(spark, alike):
    """Rows of one key have one number, numbers are in the order of keys, and edges have those of their ends."""
    from dossier.plans import graphs

    n, e = graphs.whole(spark, alike)
    no = {(r["key"], r["no"]) for r in n.select("key", "no").collect()}
    assert len(no) == n.select("key").distinct().count() < n.count()
    assert sorted(no) == sorted(no, key=lambda x: x[1])
    assert {(r["src"], r["src_no"]) for r in e.collect()} | {(r["dst"], r["dst_no"]) for r in e.collect()} <= no
