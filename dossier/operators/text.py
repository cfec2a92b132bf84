"""Text to entities and relations, as Catalyst expressions over evidence (evidence_id, case_id, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.arrays import composed, matches
from dossier.operators.components import broadcast_up_to, stored

#: What phones, plates, amounts, names and sentence ends look like. \d and \b mean Unicode ((?U)).
PHONE = r"(?U)(?:\+?91[\s\-]?)?[6-9]\d{4}[\s\-]?\d{5}\b"
PLATE = r"(?U)\b[A-Z]{2}[\s\-]?\d{1,2}[\s\-]?[A-Z]{1,3}[\s\-]?\d{3,4}\b"
MONEY = r"(?iU)(?:Rs\.?|INR|₹)\s?[\d,]+(?:\.\d{1,2})?|\b[\d,]+\s?(?:rupees|lakh|lakhs|crore)\b"
NAME = r"(?U)\b([A-Z][a-z]{1,}(?:\s+[A-Z][a-z]{1,}){1,2})\b"
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9\"'])|।\s*"
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
DATE_TEXT = r"(?iU)\b(\d{1,2})\s+(January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\s+(\d{4})\b"
DATE_ISO = r"(?U)\b(\d{4})-(\d{2})-(\d{2})\b"
DATE_NUMBER = r"(?U)\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\b"
#: Words a name may not have (fixed values).
STOP_WORDS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "police", "station", "report", "first", "information", "call", "bank", "statement", "court", "fir", "cdr", "tower", "dump",
    "analysis", "mobile", "swift", "white", "black", "near", "dated",
)
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Verb signs by relation (fixed values); a sign counts wherever it stands, also inside a word.
CALL = ("call", "called", "calling", "spoke", "spoken", "contacted", "contact", "rang", "phone", "phoned")
MEET = ("met", "meet", "meeting", "seen with", "gathered", "visited")
PAY = ("paid", "pay", "transferred", "transfer", "sent money", "wired", "deposited")
OWN = ("owns", "owned", "owner of", "belongs to", "registered", "driving", "drove")
WORK = ("works", "worked", "working", "employed", "employee", "member of", "joined")
SPAN = "array<struct<layer:int,start:int,end:int,node_type:string,value:string,confidence:double,engine:string>>"
SNIPPET = 280


def normalized(node_type: Column, value: Column) -> Column:
    """The canonical form by type: a phone's last ten digits, a plate's letters and digits, a name without title and punctuation.

    value: in its composed form, where it may hold other than ASCII characters.
    """
    v = F.btrim(value)
    digits = F.regexp_replace(v, r"(?U)\D", "")
    local = F.when((F.char_length(digits) > 10) & digits.startswith("91"), F.substr(digits, F.lit(3))).otherwise(digits)
    phone = F.when(F.char_length(local) >= 10, F.right(local, F.lit(10))).otherwise(local)
    plate = F.regexp_replace(F.upper(v), "[^A-Z0-9]", "")
    untitled = F.regexp_replace(v, r"(?i)^(mr|mrs|ms|shri|smt|late)\.?\s+", "")
    name = F.lower(F.btrim(F.regexp_replace(F.regexp_replace(untitled, r"(?U)[^\w\s.\-']", ""), r"(?U)\s+", " ")))
    return F.when(node_type == "PhoneNumber", phone).when(node_type == "Vehicle", plate).otherwise(name)


def _layer(spans: Column, layer: int, node_type: str, confidence: float, engine: str, value=lambda v: v, keep=lambda v: F.lit(True)) -> Column:
    return F.transform(
        F.filter(spans, lambda s: keep(s["value"])),
        lambda s: F.struct(
            F.lit(layer).alias("layer"), s["start"].alias("start"), s["end"].alias("end"), F.lit(node_type).alias("node_type"),
            value(s["value"]).alias("value"), F.lit(confidence).alias("confidence"), F.lit(engine).alias("engine"),
        ),
    )


def claimed(spans: Column) -> Column:
    """Spans in order of (layer, start) keep their place unless an earlier kept one overlaps it: for the few spans of a model."""
    overlap = lambda acc, s: F.exists(acc, lambda c: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPAN), lambda acc, s: F.when(overlap(acc, s), acc).otherwise(F.array_append(acc, s)))


def unclaimed(spans: DataFrame, layers: int) -> DataFrame:
    """The spans (evidence_id, of, start, end, ...) that overlap no kept one of a lower layer `of`, layer after layer.

    No layer overlaps itself, so the nearest kept spans before and after tell; all layers share one sort.
    """
    order = W.partitionBy("evidence_id").orderBy("start", "of")
    out = spans.withColumn("_kept", F.col("of") == 0)
    for i in range(1, layers):
        before = F.max(F.when(F.col("_kept"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
        after = F.min(F.when(F.col("_kept"), F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
        free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
        out = out.withColumn("_free", free).withColumn("_kept", F.col("_kept") | ((F.col("of") == i) & F.col("_free"))).drop("_free")
    return out.filter("_kept").drop("_kept")


def extract_entities(evidence: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """evidence_id, case_id, node_type, value, normalized, confidence, start, end, engine: the best row of each (type, normalized).

    model: optional rows (evidence_id, spans of the SPAN type) of a name model, which claim text after the patterns and
    before the capitalised-words fallback.
    """
    text = F.coalesce("text", F.lit(""))
    plain_plate = lambda v: F.regexp_replace(v, r"(?U)[\s\-]", "")
    is_name = lambda v: ~F.lower(v).rlike(r"(?U)(^|\s)(" + "|".join(STOP_WORDS) + r")(\s|$)")
    rows = evidence if model is None else evidence.join(model, "evidence_id", "left")
    layers = [
        _layer(matches(text, PHONE), 0, "PhoneNumber", 0.95, "regex"),
        _layer(matches(text, PLATE), 1, "Vehicle", 0.90, "regex", plain_plate, lambda v: F.char_length(F.regexp_replace(F.upper(v), "[^A-Z0-9]", "")) >= 8),
        _layer(matches(text, NAME), 9, "Person", 0.50, "regex-name", keep=is_name),
    ]
    if model is not None:
        layers.insert(2, claimed(F.coalesce("spans", F.array().cast(SPAN))))
    every = rows.select("evidence_id", "case_id", F.explode(F.array(*[F.struct(F.lit(i).alias("of"), x.alias("spans")) for i, x in enumerate(layers)])).alias("l"))
    every = every.select("evidence_id", "case_id", "l.of", F.explode("l.spans").alias("s")).select("evidence_id", "case_id", "of", "s.*")
    found = unclaimed(every, len(layers)).drop("of")
    found = found.withColumn("normalized", normalized(F.col("node_type"), composed(F.col("value")))).filter("normalized <> ''")
    rank = F.row_number().over(W.partitionBy("evidence_id", "node_type", "normalized").orderBy(F.desc("confidence"), "layer", "start"))
    best = found.withColumn("r", rank).filter("r = 1").drop("r", "layer")
    return best if model is None else fold_aliases(best)


def fold_aliases(found: DataFrame) -> DataFrame:
    """found without persons of one word that is a word of a longer person of the same evidence (only a name model gives such)."""
    words = F.split(F.lower(F.btrim("value")), r"\s+")
    person = F.col("node_type") == "Person"
    parts = found.filter(person & (F.size(words) > 1)).select("evidence_id", F.explode(words).alias("_word"), F.lit("Person").alias("node_type")).distinct()
    return found.withColumn("_word", F.when(F.size(words) == 1, words[0])).join(parts, ["evidence_id", "node_type", "_word"], "left_anti").select(*found.columns)


def dates(text: Column) -> Column:
    """Sorted distinct dates: 12 March 2026, 2026-03-12, 12/03/2026 (day first; two-digit years are 20xx); impossible ones are dropped."""
    part = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))

    def made(p: str, order: tuple[int, int, int], month=lambda m: m.cast("int")) -> Column:
        zipped = F.arrays_zip(part(p, order[0]).alias("y"), part(p, order[1]).alias("m"), part(p, order[2]).alias("d"))
        year = lambda y: F.when(y.cast("int") < 100, y.cast("int") + 2000).otherwise(y.cast("int"))
        return F.transform(zipped, lambda x: F.try_make_timestamp(year(x["y"]), month(x["m"]), x["d"].cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date"))

    name = lambda m: F.coalesce(*[F.when(F.lower(m) == k, F.lit(n)) for k, n in MONTHS.items()])
    every = F.concat(made(DATE_TEXT, (3, 2, 1), name), made(DATE_ISO, (1, 2, 3)), made(DATE_NUMBER, (3, 2, 1)))
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def sentences(evidence: DataFrame, longest: int | None = None) -> DataFrame:
    """evidence_id, case_id, position, sentence."""
    out = evidence.select("evidence_id", "case_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), SENTENCE_END)).alias("position", "sentence"))
    out = out.withColumn("sentence", F.btrim("sentence", F.lit(" \t\n\r"))).filter("sentence <> ''")
    return out if longest is None else out.filter(F.char_length("sentence") <= longest)


def aliases(persons: DataFrame) -> DataFrame:
    """evidence_id, token, value, normalized: first or last names that one person of the document has alone; a last name wins."""
    t = F.split("normalized", r"\s+")
    each = persons.select("evidence_id", "value", "normalized", F.explode(F.array(F.struct(F.lit(0).alias("slot"), t[0].alias("token")), F.struct(F.lit(1).alias("slot"), F.element_at(t, -1).alias("token")))).alias("x")).select("evidence_id", "value", "normalized", "x.*")
    alone = each.groupBy("evidence_id", "slot", "token").agg(F.count("*").alias("n"), F.first("value").alias("value"), F.first("normalized").alias("normalized")).filter("n = 1")
    return alone.groupBy("evidence_id", "token").agg(F.max_by("value", "slot").alias("value"), F.max_by("normalized", "slot").alias("normalized"))


def mentions(evidence: DataFrame, entities: DataFrame, longest: int | None = None) -> DataFrame:
    """evidence_id, case_id, position, sentence, node_type, value, normalized, at: entities of a document in its sentences.

    A whole value (any case) has its place; one found only in normalised form, or by an alias, counts as place -1. An
    alias counts where no whole value covers it.
    """
    s = sentences(evidence, longest).withColumn("low", F.lower("sentence")).withColumn("_form", composed(F.col("sentence")))
    met = s.join(entities.select("evidence_id", "node_type", "value", "normalized"), "evidence_id").withColumn("at", F.expr("locate(lower(value), low) - 1"))
    whole = met.filter((F.col("at") >= 0) | F.contains(normalized(F.col("node_type"), F.col("_form")), F.col("normalized")))
    taken = whole.filter("at >= 0").groupBy("evidence_id", "position").agg(F.collect_list(F.struct("at", (F.col("at") + F.char_length("value")).alias("end"))).alias("taken"))
    named = aliases(entities.filter("node_type = 'Person'"))
    #: Only a token of word characters can stand alone; looking for it first spares long sentences the search for its places.
    held = s.join(named, "evidence_id").filter(F.col("token").rlike(r"(?U)^\w+$") & F.contains("low", F.col("token")))
    hits = held.join(whole.select("evidence_id", "position", "normalized"), ["evidence_id", "position", "normalized"], "left_anti")
    hits = hits.join(taken, ["evidence_id", "position"], "left").withColumn("places", matches(F.concat(F.lit(" "), F.col("low"), F.lit(" ")), F.concat(F.lit(r"(?U)(?<!\w)"), F.col("token"), F.lit(r"(?!\w)"))))
    free = F.exists("places", lambda p: ~F.coalesce(F.exists("taken", lambda t: (t["at"] < p["end"] - 1) & (p["start"] - 1 < t["end"])), F.lit(False)))
    hits = hits.filter(free).withColumn("node_type", F.lit("Person")).withColumn("at", F.lit(-1))
    cols = ["evidence_id", "case_id", "position", "sentence", "low", "node_type", "value", "normalized", "at"]
    return whole.select(*cols).unionByName(hits.select(*cols))


def extract_relations(evidence: DataFrame, entities: DataFrame, longest: int | None = None) -> DataFrame:
    """evidence_id, case_id, src, dst, src_type, dst_type, edge_type, confidence, snippet, engine, valid_from.

    A sentence's entities stand in order of place; verbs and pairs of types make the edge. The first sentence keeps an
    edge; two persons in a sentence that gave no edge are weakly associated. Directions follow the order in the text.
    """
    m = mentions(evidence, entities, longest)
    order = F.array_sort(F.collect_list(F.struct("at", "normalized", "node_type", "value")))
    s = m.groupBy("evidence_id", "case_id", "position", "sentence", "low").agg(order.alias("e"))
    of = lambda *types: F.filter("e", lambda x: x["node_type"].isin(*types))
    has = lambda verbs: reduce(lambda a, b: a | b, [F.contains("low", F.lit(v)) for v in verbs])
    kind = "array<struct<rule:int,edge_type:string,confidence:double,engine:string,a:struct<at:int,normalized:string,node_type:string,value:string>,b:struct<at:int,normalized:string,node_type:string,value:string>>>"

    def edge(rule: int, edge_type: str, confidence: Column, a: Column, b: Column, engine: str = "pattern") -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(edge_type).alias("edge_type"), confidence.cast("double").alias("confidence"), F.lit(engine).alias("engine"), a.alias("a"), b.alias("b"))

    def cross(rule: int, edge_type: str, confidence: float, left: Column, right: Column) -> Column:
        return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: edge(rule, edge_type, F.lit(confidence), a, b))))

    def pairs(rule: int, edge_type: str, confidence: float, group: Column, engine: str = "pattern") -> Column:
        return F.flatten(F.transform(group, lambda a, i: F.transform(F.slice(group, i + 2, F.size(group)), lambda b: edge(rule, edge_type, F.lit(confidence), a, b, engine))))

    persons, none = of("Person"), F.array().cast(kind)
    parties = of("Person", "Organization")
    both = (F.get(parties, F.lit(0))["node_type"] == "Person") & (F.get(parties, F.lit(1))["node_type"] == "Person")
    paid = F.when(F.size(parties) >= 2, F.array(edge(2, "TRANSFERRED_MONEY_TO", F.when(both, 0.60).otherwise(0.55), F.get(parties, F.lit(0)), F.get(parties, F.lit(1)))))
    made = F.concat(
        F.when(has(CALL), F.concat(pairs(0, "CALLED", 0.60, persons), cross(1, "CALLED", 0.55, persons, of("PhoneNumber")))).otherwise(none),
        F.coalesce(F.when(F.col("sentence").rlike(MONEY) & has(PAY), paid), none),
        F.when(has(MEET), pairs(3, "ASSOCIATED_WITH", 0.55, persons)).otherwise(none),
        F.when(has(OWN), cross(4, "OWNS", 0.60, persons, F.concat(of("PhoneNumber"), of("Vehicle")))).otherwise(none),
        F.when(has(WORK), cross(5, "EMPLOYED_BY", 0.55, persons, of("Organization"))).otherwise(none),
        cross(6, "PRESENT_AT", 0.50, persons, of("Location")),
    )
    made = F.filter(made, lambda x: x["a"]["normalized"] != x["b"]["normalized"])
    s = s.withColumn("made", made).withColumn("made", F.when(F.size("made") == 0, pairs(7, "ASSOCIATED_WITH", 0.45, persons, "cooccurrence")).otherwise(F.col("made")))
    rows = s.select("evidence_id", "case_id", "position", "sentence", F.posexplode("made").alias("pair", "m")).select(
        "evidence_id", "case_id", "position", "pair", F.left("sentence", F.lit(SNIPPET)).alias("snippet"), F.get(dates(F.col("sentence")), F.lit(0)).alias("valid_from"),
        F.col("m.a.normalized").alias("src"), F.col("m.b.normalized").alias("dst"), F.col("m.a.node_type").alias("src_type"), F.col("m.b.node_type").alias("dst_type"),
        F.col("m.edge_type").alias("edge_type"), F.col("m.confidence").alias("confidence"), F.col("m.engine").alias("engine"), F.col("m.rule").alias("rule"),
    )
    rank = F.row_number().over(W.partitionBy("evidence_id", "src", "dst", "edge_type").orderBy("position", "rule", "pair"))
    return rows.filter("src <> dst").withColumn("r", rank).filter("r = 1").drop("r", "rule", "pair", "position")


def route(lang: Column, probability: Column, text: Column) -> Column:
    """How a text is read: short or doubtful ones as English; trusted Indic ones as indic; other trusted languages with non-Latin letters not at all."""
    indic = ("hi", "bn", "ta", "te", "mr", "gu", "kn", "ml", "pa", "or", "as", "ur")
    trusted = (F.char_length(text) >= 40) & (probability >= 0.60)
    other = text.rlike(r"[\p{L}&&[^\u0000-ɏ]]")
    return F.when(trusted & lang.isin(*indic), "indic").when(trusted & (lang != "en") & other, "unsupported").otherwise("english")


#: Document classes (fixed values): marker groups of which two must be found, words in file names, extensions.
MARKERS = [
    ("cdr", 0.90, ["msisdn", "imei", "imsi", "calling", "called party", "call type", "tower", "roaming"]),
    ("bank_statement", 0.90, ["ifsc", "narration", "debit", "credit", "branch", "account no", "available balance"]),
    ("fir", 0.90, ["first information report", "police station", "complainant", "u/s", "accused person"]),
    ("witness_statement", 0.85, ["witness statement", "deponent", "solemnly affirm"]),
]
FILE_WORDS = [
    ("fir", 0.80, ["first information", "fir"]),
    ("cdr", 0.80, ["cdr", "call detail", "call-detail", "tower dump", "tower-dump", "dump"]),
    ("witness_statement", 0.80, ["witness"]),
    ("bank_statement", 0.75, ["bank", "passbook", "account statement", "cheque"]),
    ("audio_transcript", 0.75, ["transcript", "interview", "recording", "statement-record"]),
    ("document", 0.60, ["invoice", "bill"]),
]
EXTENSIONS = [
    ("photo", 0.90, "extension", "jpg|jpeg|png|tiff|tif|bmp|webp", "image/"),
    ("audio_transcript", 0.85, "extension", "mp3|wav|m4a|ogg|flac|amr", "audio/"),
    ("cdr", 0.55, "spreadsheet-default", "csv|xls|xlsx", None),
    ("document", 0.50, "pdf-default", "pdf", "application/pdf"),
    ("document", 0.50, "extension", "txt|doc|docx", None),
]


def classify(file_name: Column, mime: Column, sample: Column) -> Column:
    """struct<label, confidence, reason>: content markers, then words in the name, then extension or MIME type."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    name, kind, body = low(file_name), low(mime), low(sample)
    found = lambda label, c, reason: F.struct(F.lit(label).alias("label"), F.lit(c).alias("confidence"), F.lit(reason).alias("reason"))
    count = lambda words: reduce(lambda a, b: a + b, [F.contains(body, F.lit(w)).cast("int") for w in words])
    rules = [F.when(count(words) >= 2, found(label, c, "content-markers")) for label, c, words in MARKERS]
    rules += [F.when(reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in words]), found(label, c, "filename")) for label, c, words in FILE_WORDS]
    for label, c, reason, ext, start in EXTENSIONS:
        test = name.rlike(rf"[^./]\.({ext})$")
        rules.append(F.when(test | kind.startswith(start) if start else test, found(label, c, reason)))
    return F.coalesce(*rules, found("other", 0.30, "fallback"))


def intent(question: Column) -> Column:
    """struct<intent, a, b>: a path question with its two ends, a summary, or anything else."""
    q = F.btrim(F.coalesce(question, F.lit("")))
    paths = [
        r"(?i)how\s+(?:is|are)\s+(.+?)\s+(?:connected|linked|related|associated)\s+(?:to|with)\s+(.+?)\s*\??$",
        r"(?i)(?:connection|link|relation|relationship)\s+(?:between|of)\s+(.+?)\s+and\s+(.+?)\s*\??$",
        r"(.+?)\s*(?:->|→)\s*(.+?)\s*\??$",
    ]
    clean = lambda c: F.btrim(F.regexp_replace(F.btrim(F.btrim(c), F.lit("\"'")), r"\s+", " "))
    made = lambda kind, a, b: F.struct(F.lit(kind).alias("intent"), a.alias("a"), b.alias("b"))
    empty = F.lit(None).cast("string")
    rules = []
    for p in paths:
        a, b = clean(F.regexp_extract(q, p, 1)), clean(F.regexp_extract(q, p, 2))
        rules.append(F.when(q.rlike(p) & (a != "") & (b != "") & (F.char_length(a) < 120) & (F.char_length(b) < 120), made("path", a, b)))
    summary = r"(?i)\b(summar(y|ize|ise)|tldr)\b|\bkey\s+players?\b|\b(overview|brief(\s+me)?|status)\b"
    return F.coalesce(*rules, F.when(q.rlike(summary), made("summary", empty, empty)), made("generic", empty, empty))


def temporal_range(question: Column, today: Column) -> Column:
    """struct<from, to, phrases> over all relative dates and months of a question, as of a day; null without any.

    A weekday is its latest day up to today, the last one strictly before; past months have 30 days.
    """
    low = F.lower(F.coalesce(question, F.lit("")))
    has = lambda p: low.rlike(rf"(?U)\b(?:{p})\b")
    span = lambda a, b, phrase: F.struct(a.cast("date").alias("a"), b.cast("date").alias("b"), (F.lit(phrase) if isinstance(phrase, str) else phrase).alias("phrase"))
    day = F.weekday(today)
    month, year = F.trunc(today, "month"), F.trunc(today, "year")
    monday = F.date_sub(today, day)
    past = r"(?U)\bpast (\d+) (days?|weeks?|months?)\b"
    unit = F.regexp_extract(low, past, 2)
    n = F.regexp_extract(low, past, 1).try_cast("int") * F.when(unit.startswith("day"), 1).when(unit.startswith("week"), 7).otherwise(30)
    spans = [
        F.when(has("today"), span(today, today, "today")),
        F.when(has("yesterday|last night"), span(F.date_sub(today, 1), F.date_sub(today, 1), "yesterday")),
        F.when(has("tomorrow"), span(F.date_add(today, 1), F.date_add(today, 1), "tomorrow")),
        F.when(has("this week"), span(monday, today, "this week")),
        F.when(has("last week"), span(F.date_sub(monday, 7), F.date_sub(monday, 1), "last week")),
        F.when(low.rlike(past) & n.isNotNull(), span(F.date_sub(today, n), today, F.regexp_extract(low, past, 0))),
        F.when(has("this month"), span(month, today, "this month")),
        F.when(has("last month"), span(F.add_months(month, -1), F.date_sub(month, 1), "last month")),
        F.when(has("this year"), span(year, today, "this year")),
        F.when(has("last year"), span(F.add_months(year, -12), F.date_sub(year, 1), "last year")),
    ]
    for i, name in enumerate(WEEKDAYS):
        back = F.pmod(day - i, F.lit(7))
        before = F.date_sub(today, F.when(back == 0, 7).otherwise(back).cast("int"))
        latest = F.date_sub(today, back.cast("int"))
        spans.append(F.when(has(f"last {name}"), span(before, before, f"last {name}")).when(low.rlike(rf"(?U)(?<![a-z]){name}\b"), span(latest, latest, name)))
    names = [k for k in MONTHS if len(k) > 4 or k in ("may", "june", "july")]
    pinned = rf"(?U)\b({'|'.join(names)})\s+(\d{{4}})\b"
    pins = F.arrays_zip(F.regexp_extract_all(low, F.lit(pinned), F.lit(1)).alias("m"), F.regexp_extract_all(low, F.lit(pinned), F.lit(2)).alias("y"), F.regexp_extract_all(low, F.lit(pinned), F.lit(0)).alias("p"))
    number = lambda m: F.coalesce(*[F.when(m == k, F.lit(MONTHS[k])) for k in names])
    first = lambda x: F.try_make_timestamp(x["y"].cast("int"), number(x["m"]), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    made = F.filter(F.concat(F.array_compact(F.array(*spans)), F.transform(pins, lambda x: span(first(x), F.last_day(first(x)), x["p"]))), lambda s: s["a"] <= s["b"])
    phrases = F.concat_ws("; ", F.array_sort(F.array_distinct(F.transform(made, lambda s: s["phrase"]))))
    return F.when(F.size(made) > 0, F.struct(F.array_min(F.transform(made, lambda s: s["a"])).alias("from"), F.array_max(F.transform(made, lambda s: s["b"])).alias("to"), phrases.alias("phrases")))


#: Length of the pieces by which names are looked up; names up to which their pieces are broadcast to the texts.
GRAM, NAMES = 3, 50_000


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct pieces of n characters; a shorter text is one itself."""
    cut = F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.char_length(text) >= n, F.array_distinct(cut)).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def rarest(rows: DataFrame, text: str, counts: DataFrame, n: int = GRAM) -> DataFrame:
    """rows with `key`: of the grams of a text (at least n characters) the one with the smallest n of counts (gram, n).

    Rows with a gram that counts lacks are dropped: nothing counted can hold their text.
    """
    key = [c for c in rows.columns]
    each = rows.withColumn("_all", grams(F.col(text), n)).withColumn("gram", F.explode("_all")).withColumn("_size", F.size("_all")).drop("_all")
    met = each.join(counts, "gram").groupBy(*key, "_size").agg(F.min(F.struct("n", "gram")).alias("_best"), F.count("*").alias("_met"))
    return met.filter("_met = _size").select(*key, F.col("_best.gram").alias("key"))


def link_mentions(questions: DataFrame, entities: DataFrame, most: int = 10) -> DataFrame:
    """question_id, mention, entity_id, case_id, node_type, value, confidence, candidates: confirmed entities that questions name.

    questions: question_id, question; entities: confirmed ones. Quoted spans come first (the first `most`), each with the
    entities whose value or normalized form holds it; a question without any is searched for whole values of several
    words. A mention keeps its `most` most confident candidates; with more than one it is ambiguous.

    Both searches go by the rarest piece of three characters: of a mention, the piece that the fewest names have; of a name,
    the piece that the fewest other names have, looked for among a question's pieces. So a piece that all names share
    brings no two together, unless a mention is nothing else; shorter mentions are looked up by their one or two characters.
    """
    q = questions.select("question_id", F.coalesce("question", F.lit("")).alias("question"))
    spans = F.concat(F.regexp_extract_all("question", F.lit("[\"\u201c\u201d](.+?)[\"\u201c\u201d]"), F.lit(1)), F.regexp_extract_all("question", F.lit("'([^']{2,})'"), F.lit(1)))
    quoted = F.slice(F.filter(F.transform(spans, lambda s: F.btrim(s)), lambda s: s != ""), 1, most)
    q = q.withColumn("quoted", quoted)
    e = stored(entities.select("entity_id", "case_id", "node_type", "value", "confidence", F.lower("value").alias("low"), "normalized"), "named")
    forms = F.array_distinct(F.array_compact(F.array("low", "normalized")))
    names = stored(e.select(F.explode(forms).alias("form")).distinct(), "forms")  # a name that many entities bear is looked up once
    q = stored(q, "questions")
    asked = q.select("question_id", F.explode(F.array_distinct("quoted")).alias("mention")).withColumn("said", F.lower("mention"))
    said = asked.select("said").distinct()
    long, short = said.filter(F.char_length("said") >= GRAM), said.filter(F.char_length("said") < GRAM)
    pieces = names.select("form", F.explode(grams(F.col("form"))).alias("key"))
    counts = pieces.groupBy(F.col("key").alias("gram")).agg(F.count("*").alias("n"))
    met = rarest(long, "said", counts).join(pieces, "key")
    tiny = lambda text: F.array_distinct(F.concat(*[grams(text, n) for n in range(1, GRAM)]))
    brief = short.withColumn("key", F.col("said")).join(names.select("form", F.explode(tiny(F.col("form"))).alias("key")), "key")
    fits = met.select("said", "form").unionByName(brief.select("said", "form")).filter(F.contains("form", F.col("said")))
    bearers = e.select("*", F.explode(forms).alias("form"))
    hits = asked.join(fits, "said").join(bearers, "form")

    whole = e.filter(F.contains(F.btrim("value"), F.lit(" "))).select(F.explode(forms).alias("form")).distinct()
    own = whole.select("form", F.explode(grams(F.col("form"))).alias("key")).groupBy(F.col("key").alias("gram")).agg(F.count("*").alias("n"))
    keyed = rarest(whole, "form", own)
    open_texts = q.filter(F.size("quoted") == 0).select("question_id", F.lower("question").alias("text"))
    texts = open_texts.select(F.explode(grams(F.col("text"))).alias("key"), "text").distinct()
    found = texts.join(broadcast_up_to(keyed, NAMES), "key").filter(F.contains("text", F.col("form"))).select("text", "form").distinct()
    free = open_texts.join(found, "text").join(bearers.filter(F.contains(F.btrim("value"), F.lit(" "))), "form").withColumn("mention", F.col("value"))
    cols = ["question_id", "mention", "entity_id", "case_id", "node_type", "value", "confidence"]
    hits = hits.select(*cols).unionByName(free.select(*cols)).distinct()
    rank = F.row_number().over(W.partitionBy("question_id", "mention").orderBy(F.desc("confidence"), "entity_id"))
    kept = hits.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")
    return kept.join(kept.groupBy("question_id", "mention").agg(F.count("*").alias("candidates")), ["question_id", "mention"])
