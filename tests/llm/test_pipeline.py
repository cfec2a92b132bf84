"""Each stage against a plain version on its own input."""

import corpus_pipeline as pipeline
from test_cases import brute_components, brute_contamination, brute_lines

from dossier.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert docs.columns == COLUMNS and [n for n, _ in pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "packing"]
    seen = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf), name)
        seen[name] = ([(r["doc_id"], r["text"]) for r in before.collect()], docs.collect())
        if name != "packing":
            assert docs.columns == COLUMNS
    given, out = seen["language"]
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, t in given if t and any(c.isalpha() for c in t))
    given, out = seen["line_dedup"]
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted((i, kept) for i, _, lost, kept in brute_lines(given) if not lost or kept.strip())
    given, out = seen["near_dedup"]
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, (_, c) in brute_components(given, 5, 80).items() if i == c)
    given, out = seen["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, *_, bad in brute_contamination(given, items) if not bad)
    given, out = seen["packing"]
    assert {r["doc_id"] for r in out} == {i for i, _ in given}


def test_stages_take_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
