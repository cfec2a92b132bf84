"""What a token classifier's scores say: softmax, and BIO tags put together to spans.

The model itself is none of this engine's work: its scores come as an array column of token rows (evidence_id, sentence,
position, start, end, scores). Spans are islands of tokens: a running sum over the starts within a sentence numbers them.

Cases: tokens without width or without scores, and ones past the labels, stand between spans; a tag without its type names
the type itself; labels that stand for no type of node keep their spans with a null type; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.arrays import let
from dossier.operators.text import SPAN

#: The types of nodes that labels stand for, and the tags between names.
NODE_TYPES = {
    "PER": "Person", "PERSON": "Person", "NEP": "Person",
    "LOC": "Location", "LOCATION": "Location", "GPE": "Location", "NEL": "Location",
    "ORG": "Organization", "ORGANIZATION": "Organization", "NEO": "Organization",
}
BETWEEN = ("O", "OTHER")
#: Before probabilities are rounded to four places, so that both sides of a half round alike.
TIE = 1e-9


def softmax(scores: Column) -> Column:
    """Probabilities of the scores; an empty array stays one."""
    powers = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(p, lambda x: x / total)))


def tags(tokens: DataFrame, labels: list[str]) -> DataFrame:
    """tokens with `begins`, `raw_label` (null between names) and `probability` of the likeliest tag, the first of equal ones."""
    names = F.array(*map(F.lit, labels))
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    wide = (F.col("end") > F.col("start")) & (F.size("scores") > 0)
    tag = F.when(wide, F.coalesce(F.get(names, best - 1), F.lit("O")))
    lead = F.upper(F.substring_index(F.col("_tag"), "-", 1))
    kind = F.upper(F.when(F.contains("_tag", F.lit("-")), F.substr("_tag", F.char_length(F.substring_index("_tag", "-", 1)) + 2)).otherwise(F.lit("")))
    named = F.col("_tag").isNotNull() & ~F.upper("_tag").isin(*BETWEEN)
    out = tokens.withColumn("_tag", tag).withColumn("_top", F.array_max("scores"))
    #: The largest of softmax(scores), without the others.
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    out = out.withColumn("probability", F.when(F.size("scores") > 0, 1.0 / total)).drop("_top")
    return out.withColumn("begins", named & lead.startswith("B")).withColumn("raw_label", F.when(named, F.when(kind == "", lead).otherwise(kind))).drop("_tag")


def decoded(tokens: DataFrame, labels: list[str], types: dict[str, str] = NODE_TYPES) -> DataFrame:
    """evidence_id, sentence, start, end, raw_label, node_type, confidence: a row a span, also those of labels without a type.

    A span starts at a beginning tag, after a token between names, and where the label changes; its confidence is the mean
    probability of its tokens.
    """
    order = W.partitionBy("evidence_id", "sentence").orderBy("position")
    t = tags(tokens, labels).withColumn("_before", F.lag("raw_label").over(order))
    starts = F.col("raw_label").isNotNull() & (F.col("begins") | ~F.col("_before").eqNullSafe(F.col("raw_label")))
    t = t.withColumn("_island", F.sum(starts.cast("int")).over(order)).filter("raw_label is not null")
    spans = t.groupBy("evidence_id", "sentence", "_island").agg(
        F.min_by("start", "position").alias("start"), F.max_by("end", "position").alias("end"), F.first("raw_label").alias("raw_label"), F.round(F.avg("probability") + TIE, 4).alias("confidence")
    )
    node_type = F.coalesce(*[F.when(F.col("raw_label") == k, F.lit(v)) for k, v in types.items()], F.lit(None).cast("string"))
    return spans.select("evidence_id", "sentence", "start", "end", "raw_label", node_type.alias("node_type"), "confidence")


def skipped(spans: DataFrame) -> DataFrame:
    """raw_label, n: labels outside the map, and how many spans each has."""
    return spans.filter("node_type is null").groupBy("raw_label").agg(F.count("*").alias("n"))


def model_spans(spans: DataFrame, texts: DataFrame, engine: str = "name-model", layer: int = 2) -> DataFrame:
    """(evidence_id, spans) as `extract_entities(model=)` takes them; texts: evidence_id, text, in which the spans have their places."""
    met = spans.filter("node_type is not null").join(texts.select("evidence_id", "text"), "evidence_id")
    value = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    one = F.struct(F.lit(layer).alias("layer"), "start", "end", "node_type", value.alias("value"), "confidence", F.lit(engine).alias("engine"))
    return met.groupBy("evidence_id").agg(F.sort_array(F.collect_list(one)).cast(SPAN).alias("spans"))  # spans of one text
