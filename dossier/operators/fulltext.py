"""Ranked full-text search: English stems, web-search syntax, phrases by place, the best k documents of each query.

A query is words and "quoted phrases", all of which a document must have; `or` begins an alternative and - excludes. Words
are compared by stem, stop words are passed over (though they keep their place in phrases). A hit's score is BM25 over the
stems that the fulfilled alternatives ask for. Stems are worked out once for each distinct word; texts are walked once, and
only words that some query asks for go on.

Cases: null and empty texts and queries have no hits, nor have queries of stop words or exclusions alone; rows that repeat
an id count as one text; a phrase of one word is that word; an unclosed quote is passed over; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.arrays import let
from dossier.operators.components import broadcast_up_to, stored

#: Words that say nothing, as English search configurations have them.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: Fixed values of the English stemmer's published rules: whole words, words it leaves after their plural, endings by step.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
LEFT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ator": "ate", "ation": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
SHORT = "(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
#: Asked stems and words up to which they are broadcast; BM25's two parameters.
TERMS, K1, B = 100_000, 1.2, 0.75


def _less(w: Column, n: int) -> Column:
    return F.left(w, F.char_length(w) - n)


def _endings(w: Column, at: Column, endings: dict[str, str], other: Column) -> Column:
    """The longest ending is replaced where it lies in the region from `at` on."""
    out = None
    for end in sorted(endings, key=len, reverse=True):
        made = F.when(F.char_length(w) - len(end) >= at, F.concat(_less(w, len(end)), F.lit(endings[end]))).otherwise(w)
        out = F.when(w.endswith(end), made) if out is None else out.when(w.endswith(end), made)
    return out.otherwise(other)


def _plural(w: Column) -> Column:
    short = F.when(F.char_length(w) > 4, _less(w, 2)).otherwise(_less(w, 1))
    return F.when(w.endswith("sses"), _less(w, 2)).when(w.rlike("(?:ied|ies)$"), short).when(w.rlike("[us]s$"), w).when(w.rlike("[aeiouy].+s$"), _less(w, 1)).otherwise(w)


def _past(w: Column, first: Column) -> Column:
    def cut(s: Column) -> Column:
        again = F.when(s.rlike("(?:at|bl|iz)$"), F.concat(s, F.lit("e"))).when(s.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _less(s, 1))
        again = again.when((F.char_length(s) <= first) & s.rlike(SHORT), F.concat(s, F.lit("e"))).otherwise(s)
        return F.when(s.rlike("[aeiouy]"), again).otherwise(w)

    inner = lambda n: F.when(F.char_length(w) - n >= first, _less(w, n - 2)).otherwise(w)
    return F.when(w.endswith("eedly"), inner(5)).when(w.endswith("eed"), inner(3)).when(w.rlike("(?:ingly|edly|ing|ed)$"), let(F.regexp_replace(w, "(?:ingly|edly|ing|ed)$", ""), cut)).otherwise(w)


def _second(w: Column, first: Column) -> Column:
    n = F.char_length(w)
    rest = F.when(w.endswith("ogi"), F.when((n - 3 >= first) & w.endswith("logi"), _less(w, 1)).otherwise(w))
    rest = rest.when(w.endswith("li"), F.when((n - 2 >= first) & w.rlike("[cdeghkmnrt]li$"), _less(w, 2)).otherwise(w)).otherwise(w)
    return _endings(w, first, SECOND, rest)


def _third(w: Column, first: Column, second: Column) -> Column:
    native = F.when(w.endswith("ative"), F.when((F.char_length(w) - 5 >= second) & (F.char_length(w) - 5 >= first), _less(w, 5)).otherwise(w)).otherwise(w)
    return _endings(w, first, THIRD, native)


def _fourth(w: Column, second: Column) -> Column:
    ion = F.when(w.endswith("ion"), F.when((F.char_length(w) - 3 >= second) & w.rlike("[st]ion$"), _less(w, 3)).otherwise(w)).otherwise(w)
    return _endings(w, second, dict.fromkeys(FOURTH, ""), ion)


def _fifth(w: Column, first: Column, second: Column) -> Column:
    n = F.char_length(w) - 1
    quiet = (n >= second) | ((n >= first) & ~_less(w, 1).rlike(SHORT))
    return F.when(w.endswith("e"), F.when(quiet, _less(w, 1)).otherwise(w)).when(w.endswith("ll"), F.when(n >= second, _less(w, 1)).otherwise(w)).otherwise(w)


def stem(word: Column) -> Column:
    """The English stem of a lower-case word."""

    def region(w: Column, at: Column) -> Column:
        found = F.char_length(F.regexp_extract(F.substr(w, at + 1), REGION, 0))
        return F.when(found > 0, at + found).otherwise(F.char_length(w))

    def steps(w: Column, first: Column, second: Column) -> Column:
        rest = lambda p: let(_past(p, first), lambda a: let(F.regexp_replace(a, "(?<=.[^aeiouy])[yY]$", "i"), lambda b: let(_second(b, first), lambda c: let(_third(c, first, second), lambda d: let(_fourth(d, second), lambda e: _fifth(e, first, second))))))
        return F.lower(let(_plural(w), lambda p: F.when(p.isin(*LEFT), p).otherwise(rest(p))))

    def regions(w: Column) -> Column:
        fixed = F.char_length(F.regexp_extract(w, "^(?:gener|commun|arsen)", 0))
        return let(F.when(fixed > 0, fixed).otherwise(region(w, F.lit(0))), lambda first: let(region(w, first), lambda second: steps(w, first, second)))

    marked = lambda w: let(F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y"), regions)
    whole = F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in WHOLE.items()])
    return F.when(F.char_length(word) <= 2, word).otherwise(F.coalesce(whole, marked(word)))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def asked(queries: DataFrame) -> DataFrame:
    """(query_id, alternative, item, excluded, offset, length, stem): the words of queries (query_id, question) with their place in a phrase."""
    parts = F.regexp_extract_all(F.lower(F.coalesce("question", F.lit(""))), F.lit(r'-?"[^"]*"|[^\s"]+'), F.lit(0))
    items = queries.select("query_id", F.posexplode(parts).alias("item", "said"))
    order = W.partitionBy("query_id").orderBy("item")
    items = items.withColumn("alternative", F.sum((F.col("said") == "or").cast("int")).over(order)).filter("said <> 'or'")
    each = items.select("query_id", "alternative", "item", F.col("said").startswith("-").alias("excluded"), F.posexplode(words(F.col("said"))).alias("offset", "word"))
    each = each.filter(~F.col("word").isin(*STOP_WORDS)).withColumn("stem", stem(F.col("word"))).drop("word")
    return each.withColumn("length", F.count("*").over(W.partitionBy("query_id", "item")))


def postings(texts: DataFrame, stems: DataFrame) -> DataFrame:
    """(stem, doc_id, positions) of the given stems in texts (doc_id, words)."""
    said = texts.select("doc_id", F.posexplode("words").alias("position", "word"))
    known = said.select("word").distinct().withColumn("stem", stem(F.col("word"))).filter(~F.col("word").isin(*STOP_WORDS))
    wanted = stored(known.join(broadcast_up_to(stems.select("stem").distinct(), TERMS), "stem"), "words")
    met = said.join(broadcast_up_to(wanted, TERMS), "word")
    return met.groupBy("stem", "doc_id").agg(F.collect_list("position").alias("positions"))


def search(texts: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank: the best k texts (doc_id, text) of each query (query_id, question)."""
    texts = texts.filter("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    texts = stored(texts.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("words")), "words")  # read four times
    atoms = stored(asked(queries.filter("query_id is not null").select("query_id", "question").distinct()), "asked")
    found = stored(postings(texts, atoms), "postings")
    met = broadcast_up_to(atoms, TERMS).join(found, "stem")
    item = ["query_id", "alternative", "item", "excluded", "doc_id"]
    one = met.filter("length = 1").select(*item)
    bases = F.transform("positions", lambda p: p - F.col("offset"))
    several = met.filter("length > 1").groupBy(*item, "length").agg(F.collect_list(bases).alias("b")).filter("size(b) = length")  # as many as the phrase has words
    several = several.filter(F.size(F.aggregate(F.slice("b", 2, F.size("b")), F.get("b", F.lit(0)), lambda a, x: F.array_intersect(a, x))) > 0)
    held = one.unionByName(several.select(*item)).groupBy("query_id", "alternative", "doc_id").agg(F.count_if(~F.col("excluded")).alias("has"), F.count_if("excluded").alias("bad"))
    need = atoms.filter("not excluded").groupBy("query_id", "alternative").agg(F.count_distinct("item").alias("need"))
    full = held.join(broadcast_up_to(need, TERMS), ["query_id", "alternative"]).filter("bad = 0 and has = need")
    terms = full.join(met.filter("not excluded"), ["query_id", "alternative", "doc_id"]).select("query_id", "doc_id", "stem", F.size("positions").alias("tf")).distinct()
    lengths = texts.select("doc_id", F.size(F.filter("words", lambda w: ~w.isin(*STOP_WORDS))).alias("n_words"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("n_words").alias("mean"))
    df = found.groupBy("stem").agg(F.count("*").alias("df"))
    rated = terms.join(df, "stem").join(lengths, "doc_id").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / F.col("mean")))
    scored = rated.groupBy("query_id", "doc_id").agg(F.round(F.sum(part) + 1e-9, 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
