"""Benchmark decontamination over a positional inverted index, in DataFrame expressions only.

The index holds (doc key, term, position) rows of the training texts, written once; test phrases are
found by intersecting, from their rarest terms, the offset-adjusted position lists of those terms
(a posting at position p of the phrase's word j speaks for a phrase start at p - j), then comparing
words. No list of a common term is read for a phrase that has a rarer one.

Cases: null or empty texts have no words; documents with a null id keep a row, words in windows of an
item with a null id are hit, though it cannot be named; repeated rows each get a row of equal result; items of fewer words
than a window are one window; empty tables give empty results or no hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import ascii_lower, broadcast_up_to, stored, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Lists intersected for each window: those of its so many rarest terms.
RAREST = 2
#: Rows up to which test terms and anchors are broadcast; beyond, the joins are shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def keyed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns kept, and `doc`, which is the same for equal documents alone."""
    return docs.select(*keep, F.xxhash64("doc_id", "text").alias("doc"))


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Positional postings (doc, term, pos) of keyed docs, written to the shared folder.

    terms: one column `term`, distinct; if given, only their postings are stored (all that phrases
    made of these terms ever read).
    """
    postings = docs.select("doc", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    if terms is not None:
        postings = postings.join(broadcast_up_to(terms, BROADCAST_ROWS), "term")
    return stored(postings.select("doc", "term", "pos"), "postings")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words, width): an item's words, and how many consecutive ones make a window."""
    named = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words"))
    return named.filter("size(words) > 0").distinct().withColumn("width", F.least(F.size("words"), F.lit(window)))


def anchors(items: DataFrame, index: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(term, item, words, width, j, needs): the word places whose lists are intersected, by rising frequency.

    Of each window the `rarest` least frequent places (ties: the leftmost) are anchors; `needs` has, for
    each window of the item, the places that must all be found. A window with a term that the index lacks
    cannot occur and has no anchors.
    """
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    places = items.select("item", "words", "width", F.posexplode("words").alias("j", "term"))
    freq = places.join(counts, "term", "left").groupBy("item", "words", "width").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("freq")
    )
    starts = F.sequence(F.lit(0), F.size("words") - F.col("width"))

    def chosen(s: Column) -> Column:
        inside = F.transform(F.slice("freq", s + 1, F.col("width")), lambda n, i: F.struct(n.alias("n"), (s + i).alias("j")))
        ranked = F.array_sort(inside)
        return F.when(ranked[0]["n"] > 0, F.array_sort(F.transform(F.slice(ranked, 1, rarest), lambda x: x["j"].cast("int"))))

    needs = freq.withColumn("needs", F.array_distinct(F.array_compact(F.transform(starts, chosen)))).drop("freq")
    return needs.withColumn("j", F.explode(F.array_distinct(F.flatten("needs")))).withColumn("term", F.col("words")[F.col("j")])


def candidates(items: DataFrame, index: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(doc, item, words, width, ats): where the item's first word would stand if one of its windows occurs."""
    chosen = stored(anchors(items, index, rarest).withColumn("phrase", F.xxhash64("item", "words")), "anchors")
    wanted = broadcast_up_to(chosen.select("term", "phrase", "j"), BROADCAST_ROWS)
    met = index.join(wanted, "term").select("doc", "phrase", "j", (F.col("pos") - F.col("j")).alias("at"))
    #: Only numbers are shuffled; the phrases' words join the few documents that are left, once for all places in one.
    lists = met.groupBy("doc", "phrase", "at").agg(F.collect_set("j").alias("found"))
    known = chosen.select("phrase", "item", "words", "width", "needs").distinct()
    needs = broadcast_up_to(known.select("phrase", "needs").distinct(), BROADCAST_ROWS // 10)
    some = lists.join(needs, "phrase").filter(F.exists("needs", lambda n: F.size(F.array_except(n, F.col("found"))) == 0))
    places = some.groupBy("doc", "phrase").agg(F.collect_set("at").alias("ats"))
    return places.join(broadcast_up_to(known.drop("needs"), BROADCAST_ROWS // 10), "phrase").select("doc", "item", "words", "width", "ats")


def _covered(text: Column, c: Column) -> Column:
    """Places in `text` (words) inside an occurrence of one of candidate c's windows, whichever of its places it is at."""
    equal = lambda at: F.transform(c["words"], lambda w, j: F.coalesce(F.get(text, at + j) == w, F.lit(False)))
    last = F.size(c["words"]) - c["width"]
    whole = lambda eq: F.transform(F.sequence(F.lit(0), last), lambda s: F.forall(F.slice(eq, s + 1, c["width"]), lambda x: x))
    inside = lambda ok, j: F.exists(F.slice(ok, F.greatest(j - c["width"] + 1, F.lit(0)) + 1, F.least(j, last) - F.greatest(j - c["width"] + 1, F.lit(0)) + 1), lambda x: x)
    words_in = lambda ok: F.filter(F.sequence(F.lit(0), F.size(c["words"]) - 1), lambda j: inside(ok, j))
    at_one = lambda at: F.transform(F.array(whole(equal(at))), lambda ok: F.when(F.exists(ok, lambda x: x), F.transform(words_in(ok), lambda j: at + j)).otherwise(F.array().cast("array<int>")))[0]
    return F.array_distinct(F.flatten(F.transform(c["ats"], at_one)))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """One row for each row of docs: the columns kept, n_words, n_hit, items (sorted), contaminated.

    n_hit: words inside any occurrence of `window` consecutive words of an item; contaminated: any
    hit, and hits make at least 1 / share of the words.
    """
    docs = keyed(docs, keep)
    items = stored(phrases(items, window), "items")
    terms = items.select(F.explode("words").alias("term")).distinct()
    index = build_index(docs, terms)
    by_doc = candidates(items, index).groupBy("doc").agg(F.collect_list(F.struct("item", "words", "width", "ats")).alias("found"))
    joined = docs.join(by_doc, "doc", "left")
    hits = F.transform(
        F.array(words(F.col("text"))),
        lambda text: F.struct(
            F.size(text).cast("long").alias("n_words"),
            F.transform(F.coalesce("found", F.array().cast(by_doc.schema["found"].dataType)), lambda c: F.struct(c["item"].alias("item"), _covered(text, c).alias("at"))).alias("hits"),
        ),
    )[0]
    read = joined.select(*keep, hits.alias("r")).select(*keep, "r.n_words", F.filter("r.hits", lambda h: F.size(h["at"]) > 0).alias("hits"))
    counted = read.select(
        *keep, "n_words",
        F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["at"])))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform("hits", lambda h: h["item"])))).alias("items"),
    )
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def near_matches(items: DataFrame, index: DataFrame, span: int) -> DataFrame:
    """(item, doc, start): all distinct words of an item within `span` consecutive places, in any order.

    start: the first place of its rarest word with such a neighbourhood. The other words' lists are met
    by blocks of `span` places, so a list is joined with neighbours only.
    """
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    terms = items.select("item", F.explode(F.array_distinct("words")).alias("term")).join(counts, "term", "left").fillna(0, ["n"])
    first = terms.groupBy("item").agg(F.min(F.struct("n", "term"))["term"].alias("rarest"), F.count("*").alias("n_terms"))
    seeds = index.join(first.withColumnRenamed("rarest", "term"), "term").select("doc", "item", "n_terms", F.col("pos").alias("seed"))
    blocks = seeds.withColumn("block", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("seed") / span) + d)))
    others = index.join(terms.select("item", "term"), "term").withColumn("block", F.floor(F.col("pos") / span))
    close = blocks.join(others, ["doc", "item", "block"]).filter(F.abs(F.col("pos") - F.col("seed")) < span)
    #: A window of `span` places around the seed starts at one of the found places or at the seed itself.
    around = close.groupBy("doc", "item", "seed", "n_terms").agg(F.collect_set(F.struct("pos", "term")).alias("near"))
    fits = F.exists(
        "near",
        lambda a: (a["pos"] <= F.col("seed")) & (F.col("seed") < a["pos"] + span)
        & (F.size(F.array_distinct(F.transform(F.filter("near", lambda x: (x["pos"] >= a["pos"]) & (x["pos"] < a["pos"] + span)), lambda x: x["term"]))) == F.col("n_terms")),
    )
    return around.filter(fits).groupBy("item", "doc").agg(F.min("seed").alias("start"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


SQL = f"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') bs from benchmark),
n as (select distinct item_id::varchar item, least(len(bs), {WINDOW}) k, unnest(list_transform(range(1, len(bs) - least(len(bs), {WINDOW}) + 2), lambda s: array_to_string(bs[s:s + least(len(bs), {WINDOW}) - 1], ' '))) g from b where len(bs) > 0),
ks as (select distinct k from n),
o as (select doc_id, k, unnest(range(1, len(ws) - k + 2)) s, ws from w, ks where len(ws) >= k),
m as (select o.doc_id, n.item, o.s, o.k from o join n on n.k = o.k and n.g = array_to_string(o.ws[o.s:o.s + o.k - 1], ' ')),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + k)) p from m) group by doc_id),
i as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from m where item is not null) group by doc_id)
select w.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from w left join h on w.doc_id = h.doc_id left join i on w.doc_id = i.doc_id"""
