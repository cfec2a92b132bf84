"""Token scores to spans, composed forms, places of matches, and which spans keep their place, against plain versions."""

import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.functions.arrays import composed, matches, running_sums
from dossier.operators import spans as S
from dossier.operators import text as X

LABELS = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC", "B-ORG", "B-MISC", "Other", "per"]
TOKENS = "evidence_id long, sentence int, position int, start int, end int, scores array<double>"


def plain(rows):
    """Spans of (sentence key, tokens in order), token by token."""
    out = []
    for key, tokens in rows.items():
        now = None
        for start, end, scores in [*tokens, (0, 0, [])]:
            tag = "O"
            if end > start and scores:
                best = scores.index(max(scores))
                tag = LABELS[best] if best < len(LABELS) else "O"
            if tag.upper() in ("O", "OTHER"):
                if now:
                    out.append((*key, *now[:3], S.NODE_TYPES.get(now[2]), round(sum(now[3]) / len(now[3]) + 1e-9, 4)))
                now = None
                continue
            lead, _, kind = tag.partition("-")
            kind = (kind or lead).upper()
            p = 1 / sum(math.exp(s - max(scores)) for s in scores)
            if now and now[2] == kind and not lead.upper().startswith("B"):
                now = (now[0], end, kind, [*now[3], p])
            else:
                if now:
                    out.append((*key, *now[:3], S.NODE_TYPES.get(now[2]), round(sum(now[3]) / len(now[3]) + 1e-9, 4)))
                now = (start, end, kind, [p])
    return sorted(out, key=str)


def test_bio_spans_against_a_plain_version(spark):
    rng = np.random.default_rng(4)
    rows = {}
    for i in range(40):
        for j in range(2):
            at, tokens = 0, []
            for _ in range(int(rng.integers(0, 30))):
                width = int(rng.integers(0, 4))
                scores = [float(s) for s in np.round(rng.normal(0, 2, int(rng.choice([0, 9, 9, 9, 10]))), 1)]
                tokens.append((at, at + width, scores))
                at += width + 1
            rows[(i, j)] = tokens
    given = [(i, j, p, *t) for (i, j), tokens in rows.items() for p, t in enumerate(tokens)]
    found = S.decoded(spark.createDataFrame(given, TOKENS), LABELS)
    got = sorted([(r["evidence_id"], r["sentence"], r["start"], r["end"], r["raw_label"], r["node_type"], r["confidence"]) for r in found.collect()], key=str)
    assert got == plain(rows) and {g[4] for g in got} == {"PER", "LOC", "ORG", "MISC"}
    assert {(r["raw_label"], r["n"]) for r in S.skipped(found).collect()} == {("MISC", sum(g[4] == "MISC" for g in got))}
    assert S.decoded(spark.createDataFrame([], TOKENS), LABELS).collect() == []
    nothing = [(1, 0, 0, 0, 3, None), (1, 0, 1, 4, 6, [])]
    assert S.decoded(spark.createDataFrame(nothing, TOKENS), LABELS).collect() == []


def test_probabilities(spark):
    rows = [([5.0, 1.0, 0.1],), ([700.0, 710.0],), ([],)]
    got = [r["p"] for r in spark.createDataFrame(rows, "s array<double>").select(S.softmax(F.col("s")).alias("p")).collect()]
    assert abs(sum(got[0]) - 1) < 1e-9 and got[0][0] > 0.9 and abs(got[1][0] + got[1][1] - 1) < 1e-9 and not got[2]


def test_a_model_claims_between_patterns_and_capitals(spark):
    text = "राहुल शर्मा ने 9876543210 पर Vikram Patil Senior को फोन किया"
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    tag = {0: 1, 1: 2, 3: 1, 5: 1, 6: 2}  # the phone is no name: patterns come first; the model's shorter name keeps its place
    given = [(7, 0, p, a, b, [4.0 if k == tag.get(p, 0) else 0.0 for k in range(len(LABELS))]) for p, (a, b) in enumerate(words)]
    texts = spark.createDataFrame([(7, 1, text), (8, 1, "Said Anita Rao")], "evidence_id long, case_id int, text string")
    model = S.model_spans(S.decoded(spark.createDataFrame(given, TOKENS), LABELS), texts)
    got = {(r["evidence_id"], r["node_type"], r["value"], r["engine"]) for r in X.extract_entities(texts, model).collect()}
    assert got == {(7, "PhoneNumber", "9876543210", "regex"), (7, "Person", "राहुल शर्मा", "name-model"), (7, "Person", "Vikram Patil", "name-model"), (8, "Person", "Said Anita Rao", "regex-name")}


def test_composed_values(spark):
    full = "".join(chr(ord(c) + 0xFEE0) for c in "9876543210")
    wide = "".join(chr(ord(c) + 0xFEE0) if c != " " else " " for c in "Raj Kumar")
    rows = [("PhoneNumber", full, "9876543210"), ("Person", wide, "raj kumar"), ("Person", "Réné ﬁsher", "réné fisher"), ("Vehicle", "ＭＨ12", "MH12"), ("Person", None, None), ("Person", "Mr. X", "x")]
    df = spark.createDataFrame(rows, "kind string, value string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", X.normalized(F.col("kind"), composed(F.col("value"))).alias("got")).collect())
    model = [(1, [(2, 0, 10, "PhoneNumber", full, 0.9, "m")])]
    e = spark.createDataFrame([(1, 1, full + " and 9876543210")], "evidence_id long, case_id int, text string")
    got = X.extract_entities(e, spark.createDataFrame(model, f"evidence_id long, spans {X.SPAN}")).collect()
    assert [(r["normalized"], r["start"]) for r in got] == [("9876543210", 15)]


def test_matches_and_sums_of_any_length(spark):
    texts = ["a1b22c", "", "none", "1", "x" * 50 + "7" + "y" * 9, " ".join(str(i) for i in range(3000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", matches(F.col("t"), r"\d+").alias("m")).collect():
        assert [(m["start"], m["end"], m["value"]) for m in r["m"]] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", r["t"])]
    sums = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 127, 128, 129, 1000)], "n array<int>").select("n", running_sums(F.col("n")).alias("s")).collect()
    assert all(r["s"] == [sum(r["n"][:i]) for i in range(len(r["n"]))] for r in sums)


def test_claims_against_a_plain_version(spark):
    """Spans of layers that do not overlap themselves; many in one text."""
    rng = np.random.default_rng(8)
    given, want = [], set()
    for e in range(30):
        kept = []
        for layer in range(4):
            at = 0
            for _ in range(int(rng.integers(0, 12))):
                a = at + int(rng.integers(0, 9))
                b = a + int(rng.integers(1, 9))
                at = b
                given.append((e, layer, a, b))
                if all(b <= x or y <= a for x, y in kept):
                    want.add((e, layer, a, b))
            kept += [(a, b) for i, k, a, b in want if i == e and k == layer]
    got = X.unclaimed(spark.createDataFrame(given, "evidence_id long, of int, start int, end int"), 4)
    assert {tuple(r) for r in got.collect()} == want and len(want) < len(given)


def test_many_names_in_one_text(spark):
    """Work on one text grows with its matches, not with their square."""
    took = []
    for n in (2000, 16_000):
        e = spark.createDataFrame([(1, 1, ", ".join(f"Rahul {'abcdefgh'[i % 8]}".title() + "arma" + "xyzw"[i % 4] for i in range(n)))], "evidence_id long, case_id int, text string")
        for _ in range(2):
            began = time.time()
            assert X.extract_entities(e).count() == 8
            last = time.time() - began
        took.append(last)
    assert took[1] < 8 * took[0] + 3


def test_mentions_against_a_plain_version(spark):
    """Names that share their beginnings, short mentions, several words, forms that differ from the value."""
    rng = np.random.default_rng(12)
    names = [f"customer#{i:05d}" for i in range(60)] + ["Pune Railway Station", "Pune Central", "Mumbai Central", "Anita Rao", "anita  rao", "x y", "Ñandú Río", ""]
    ents = [(i, i % 3, "T", n, n.lower().replace("#", "") if i % 2 else n.lower(), float(np.round(rng.random(), 2))) for i, n in enumerate(names)] + [(900, 1, "T", "Pune Central", None, 0.5)]
    said = ['who is "customer#00012"?', 'the "cus" and "00" there', "'customer00031' or 'a'", '"Pu" and "e"', "was anita rao at pune central or x y?", "so mumbai centrals", '"nobody here"', None, "", '"CENTRAL"', "ñandú río", "'"]
    qs = list(enumerate(said))
    got = X.link_mentions(spark.createDataFrame(qs, "question_id long, question string"), spark.createDataFrame(ents, "entity_id long, case_id int, node_type string, value string, normalized string, confidence double"))
    want = []
    for i, t in qs:
        spans = [s.strip() for s in re.findall("[\"\u201c\u201d](.+?)[\"\u201c\u201d]", t or "") + re.findall("'([^']{2,})'", t or "") if s.strip()][:10]
        hits = {(m, e[0]) for m in spans for e in ents if m.lower() in e[3].lower() or m.lower() in (e[4] or "")}
        if not spans:
            hits = {(e[3], e[0]) for e in ents if " " in e[3].strip() and (e[3].lower() in (t or "").lower() or (e[4] is not None and e[4] in (t or "").lower()))}
        for m in {m for m, _ in hits}:
            best = sorted([e for e in ents if (m, e[0]) in hits], key=lambda e: (-e[5], e[0]))[:10]
            want += [(i, m, e[0], len(best)) for e in best]
    assert sorted((r["question_id"], r["mention"], r["entity_id"], r["candidates"]) for r in got.collect()) == sorted(want) and len(want) > 40


def test_shared_pieces_bring_no_names_together(spark):
    """A mention meets the names that have its rarest piece: candidates follow the names, not names times mentions."""
    names = spark.range(3000).select(F.format_string("customer#%09d", "id").alias("form"))
    pieces = names.select("form", F.explode(X.grams(F.col("form"))).alias("key"))
    counts = pieces.groupBy(F.col("key").alias("gram")).agg(F.count("*").alias("n"))
    asked = names.filter("form like '%7'").withColumnRenamed("form", "said")
    met = X.rarest(asked, "said", counts).join(pieces, "key").count()
    assert asked.count() == 300 and met < 300 * 3000 / 20
    assert X.rarest(spark.createDataFrame([("zzz customer",)], "said string"), "said", counts).count() == 0


def test_places_in_long_texts(spark):
    """Lengths of the gaps are worked out once and not for each run of sums; the largest probability is that of softmax."""
    took = []
    for n in (8000, 64_000):
        df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)] * 4, "t string").repartition(4)
        for _ in range(2):
            began = time.time()
            last = df.select(F.element_at(matches(F.col("t"), "[^ ]+"), -1).alias("m")).select("m.*").first()
            spent = time.time() - began
        assert (last["end"] - last["start"], last["value"]) == (len(f"w{n - 1}"), f"w{n - 1}")
        took.append(spent)
    assert took[1] < 4 * took[0] + 1
    rows = [(0, 1, [0.5, 2.0, 2.0]), (0, 1, [7.0]), (0, 1, []), (0, 1, None), (0, 1, [1.0, None])]
    got = S.tags(spark.createDataFrame(rows, "start int, end int, scores array<double>"), ["O", "B-PER", "I-PER"]).select("probability", F.array_max(S.softmax(F.col("scores"))).alias("p")).collect()
    assert [r["probability"] for r in got] == pytest.approx([r["p"] for r in got]) and got[1]["p"] == 1.0 and got[3]["p"] is None
