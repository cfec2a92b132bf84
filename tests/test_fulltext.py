"""Full-text search against a plain version; stems against the published rules' examples."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import fulltext as T
from dossier.operators import retrieval

#: Words and their stems as the stemmer's authors publish them.
STEMS = """consign consign, consigned consign, consignment consign, consistency consist, consistently consist, consolation consol, consolatory consolatori,
consolidate consolid, consoling consol, conspicuously conspicu, conspiracy conspiraci, conspirators conspir, constable constabl, constancy constanc, knackeries knackeri,
knavish knavish, kneaded knead, kneeling kneel, knightly knight, knitted knit, knives knive, knocker knocker, generate generat, general general, communism communism,
hopping hop, hoped hope, falling fall, happy happi, say say, cry cri, by by, dying die, relational relat, conditional condit, digitizer digit, operator oper,
feudalism feudal, decisiveness decis, hopefulness hope, sensibiliti sensibl, triplicate triplic, formative format, electrical electr, goodness good, revival reviv,
allowance allow, adjustable adjust, irritant irrit, replacement replac, adoption adopt, effective effect, bowdlerize bowdler, rate rate, cease ceas, controll control,
skies sky, ties tie, cries cri, gas gas, this this, kiwis kiwi, agreed agre, feed feed, luxuriated luxuri, proceed proceed, flying fli, a a, is is"""


def test_stems(spark):
    pairs = [tuple(p.split()) for p in STEMS.split(",")]
    df = spark.createDataFrame(pairs, "word string, want string").select("word", "want", T.stem(F.col("word")).alias("got"))
    assert [tuple(r) for r in df.filter("want <> got").collect()] == []


def frames(spark, texts, queries):
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, question string")


def found(spark, texts, queries, k=10):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in T.search(*frames(spark, texts, queries), k).collect())


def plain(stems, texts, queries, k=10):
    """stems: word to stem. The query's alternatives in turn over all texts."""
    split = lambda t: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]
    docs = {}
    for i, t in texts:
        if i is not None:
            docs[i] = max(docs.get(i) or "", t or "")
    at = {i: [(p, stems[w]) for p, w in enumerate(split(t)) if w not in T.STOP_WORDS] for i, t in docs.items()}
    mean = sum(map(len, at.values())) / max(len(at), 1)
    df = lambda s: sum(any(x == s for _, x in own) for own in at.values())
    out = []
    for q, question in set(queries):
        groups = [[]]
        for item in re.findall(r'-?"[^"]*"|[^\s"]+', (question or "").lower()):
            if item == "or":
                groups.append([])
                continue
            words = [(p, stems[w]) for p, w in enumerate(split(item)) if w not in T.STOP_WORDS]
            if words:
                groups[-1].append((item.startswith("-"), words))
        scores = []
        for i, own in at.items():
            places = set(own)
            has = lambda words: any(all((b + p, s) in places for p, s in words) for b in range(-20, max([p for p, _ in own], default=0) + 1))
            terms = set()
            for g in groups:
                if any(not bad for bad, _ in g) and all(has(w) != bad for bad, w in g):
                    terms |= {s for bad, w in g if not bad for _, s in w}
            if terms:
                score = 0.0
                for s in terms:
                    tf = sum(x == s for _, x in own)
                    score += math.log(1 + (len(at) - df(s) + 0.5) / (df(s) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean)) if tf else 0.0
                scores.append((-round(score + 1e-9, 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


WORDS = "calls called calling the of bank banks banking money transferred transfer witness police officer phones phone late night 12 cdr".split()


def test_search_against_a_plain_version(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    texts = [(i, text(int(rng.integers(0, 25)))) for i in range(80)] + [(90, None), (91, ""), (None, "calls"), (3, "calls, phones!"), (92, "Bank money " * 50)]
    queries = [(1, "call"), (2, "call bank"), (3, '"bank money"'), (4, "phone -night"), (5, "cdr or witness police"), (6, '"officer of the night" or -late 12'), (7, "the of"), (8, "-call"), (9, None), (10, ""), (11, '"transfer the money" call'), (12, "unknown bank"), (13, 'bank -"phone late"'), (13, 'bank -"phone late"'), (14, '"or" call'), (15, "bank-money"), (16, '"calls')]
    stems = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in [*WORDS, "call", "unknown", "or"]], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()}
    for k in (10, 2):
        want = plain(stems, texts, queries, k)
        assert found(spark, texts, queries, k) == want and {w[0] for w in want} >= {1, 2, 3, 4, 5, 13}


@pytest.mark.parametrize("texts, queries", [([], [(1, "call")]), ([(1, "call")], []), ([(1, None)], [(1, None), (None, "call")])])
def test_nothing(spark, texts, queries):
    assert found(spark, texts, queries) == []


def test_ranked_files_in_grouped_search(spark):
    e = spark.createDataFrame([], "entity_id long, case_id int, value string, confidence double, status string")
    f = spark.createDataFrame([(1, 1, "a.txt", "one call"), (2, 1, "b.txt", "calls calls"), (3, 1, "calling.txt", "x"), (4, 2, "c.txt", "calling")], "evidence_id long, case_id int, file_name string, text string")
    c = spark.createDataFrame([(1, "FIR-1", "t")], "case_id int, fir_no string, title string")
    q = spark.createDataFrame([(0, "calling")], "query_id long, question string")
    hits = T.search(f.select(F.col("evidence_id").alias("doc_id"), "text"), q).select(F.col("doc_id").alias("evidence_id"), "score")
    got = retrieval.grouped_search(e, f, c, c.select("case_id"), "calling", 5, hits).orderBy("rank").collect()
    assert [r["id"] for r in got] == [3, 2, 1] and got[1]["score"] > got[2]["score"] > 0


def trigram_set(text):
    return {f"  {w} "[i : i + 3] for w in re.split(r"[^a-z0-9ñ]+", text.lower()) if w for i in range(len(w) + 1)}


@pytest.mark.parametrize("least", [0.15, 0.5])
def test_fuzzy_hits_against_all_pairs(spark, least):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdñ"), rng.integers(1, 7)))
    values = [(i, " ".join(word() for _ in range(rng.integers(1, 4)))) for i in range(150)] + [(200, None), (201, ""), (202, "Supplier#12"), (203, "supplier#12"), (204, "##")]
    asked = [(i, word() + " " + word()) for i in range(30)] + [(40, "supplir"), (41, "#1"), (42, "a"), (43, " "), (44, None), (45, "##"), (46, "supplir")]
    found = retrieval.fuzzy_hits(spark.createDataFrame(values, "id long, value string"), spark.createDataFrame(asked, "query_id long, text string"), least)
    want = set()
    for q, t in asked:
        for i, v in values:
            if t and t.strip() and v is not None:
                a, b = trigram_set(t), trigram_set(v)
                s = len(a & b) / max(len(a | b), 1)
                if s > least or t.lower() in v.lower():
                    want.add((q, i, round(s, 9)))
    assert {(r["query_id"], r["id"], round(r["similarity"], 9)) for r in found.collect()} == want and found.count() == len(want) > 20


def test_ranked_terms_stay_with_their_chunk(spark):
    """Only the chunks' words are dealt, once: neither their counts nor what queries make of them is shuffled on. A repeated chunk counts as one."""
    from pyspark.sql import functions as F

    from dossier.operators import retrieval

    c = spark.createDataFrame([(1, 0, "red cat and red dog"), (1, 1, "blue dog"), (2, 0, "cat"), (2, 0, "cat"), (3, 0, None)], "evidence_id long, chunk_index int, chunk string")
    q = spark.createDataFrame([(7, "red dog"), (8, "cat cat"), (9, "none")], "query_id long, question string")
    found = retrieval.bm25(c, q)
    got = {(r["query_id"], r["evidence_id"], r["chunk_index"]): r["score"] for r in found.collect()}
    assert set(got) == {(7, 1, 0), (7, 1, 1), (8, 1, 0), (8, 2, 0)} and got[7, 1, 0] > got[7, 1, 1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and plan.count("hashpartitioning(evidence_id") >= 1


def test_fuzzy_hits_of_numbers_meet_few_values(spark, monkeypatch):
    """Names that differ in digits alone share frequent trigrams; few of their pairs are compared, and no hit is lost."""
    met, keep = [], retrieval.stored
    monkeypatch.setattr(retrieval, "stored", lambda df, name: (out := keep(df, name), met.append(out.count()) if name == "met" else None)[0])
    values = [(i, f"MH{i:07d}") for i in range(0, 12_000, 6)]
    asked = [(i, v.replace("00", "0")) for i, v in values[::20]]
    found = retrieval.fuzzy_hits(spark.createDataFrame(values, "id long, value string"), spark.createDataFrame(asked, "query_id long, text string"), 0.6)
    sets = {i: trigram_set(v) for i, v in values}
    want = set()
    for q, t in asked:
        a = trigram_set(t)
        want |= {(q, i) for i, v in values if len(a & sets[i]) / len(a | sets[i]) > 0.6 or t.lower() in v.lower()}
    assert {(r["query_id"], r["id"]) for r in found.collect()} == want and len(want) >= len(asked)
    assert met and met[0] < 20 * len(asked)


def test_fuzzy_hits_send_no_made_rows_to_the_driver(spark, monkeypatch):
    """Rows made of texts and values stand for far more than the files they come from, which is all that the planner knows."""
    plans, keep = {}, retrieval.stored
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieval, "stored", lambda df, name: (plans.update({name: plan(df)}), keep(df, name))[1])
    values = spark.createDataFrame([(i, f"Supplier#{i:05d}") for i in range(40)], "id long, value string")
    found = retrieval.fuzzy_hits(values, spark.createDataFrame([(1, "Supplier#0012"), (2, "er")], "query_id long, text string"), 0.6)
    assert found.filter("query_id = 2").count() == 40
    assert "Broadcast" not in plans["met"] + plans["close"] + plan(found)
