"""Personal data: regular expressions propose spans, checksums confirm, context words score.

Everything is DataFrame expressions: one pass over the text, no shuffle, no Python. Spans are code
points, end exclusive. Cases: a null or empty text has no spans; a null doc_id stays null; repeated
rows each get their own result; an empty table gives an empty result; extra columns are ignored.
Long runs cost linear time: a match starts at a run's start or where the last match ended (\\G),
and repetitions are possessive, which neither changes the leftmost-greedy matches nor recurses. Many
matches do too: places are sums of the pieces between matches, and a span's neighbourhood is put
together from the pieces beside it, so no span is looked for in the text again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import table

#: Kinds in the order that breaks ties between spans of equal start; the last is this method's own.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Lengths of account numbers by country (fixed values of the public registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
PATTERNS["iban"] = "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
#: Start score of a confirmed span, and what a context word nearby adds.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
CONTEXT_BONUS, CONTEXT_CHARS = 0.2, 40
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta|pay",
    "phone": "phone|call|tel|mobile|fax|anruf|llam",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
SPAN = "array<struct<start:int,rank:int,end:int,value:string,score:double>>"
#: Pieces whose lengths are summed in one go, and matches beside a span that its neighbourhood may reach into
#: (a match and the gap before it have at least two characters).
SUMMED, BESIDE = 256, CONTEXT_CHARS // 2 + 1


def bound(value: Column, made) -> Column:
    """made(value), whose uses of the value don't compute it again."""
    return F.transform(F.array(value), made)[0]


def sums_before(lengths: Column) -> Column:
    """For each of the lengths (at least one) the sum of those before it; runs of SUMMED keep the appending cheap."""
    add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    scan = lambda runs, at: F.aggregate(runs, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), add, lambda acc: acc["out"])
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / SUMMED).cast("int")), lambda i: F.slice(lengths, i * SUMMED + 1, F.lit(SUMMED)))
    totals = lambda r: F.transform(r, lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n))
    return bound(runs, lambda r: F.flatten(F.zip_with(r, scan(totals(r), F.lit(0)), lambda x, at: scan(x, at))))


def proposals(text: Column, kind: str, keep) -> Column:
    """The leftmost non-overlapping matches of a kind that `keep` (value, character before, character after) confirms, with places and scores."""
    rank, nothing = KINDS.index(kind), F.lit("")
    gaps = F.split(text, PATTERNS[kind], -1)
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    pieces = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), F.coalesce(h, nothing).alias("hit")))
    lengths = lambda p: F.transform(p, lambda x: (F.char_length(x["gap"]) + F.char_length(x["hit"])).cast("int"))
    joined = lambda p: F.concat_ws("", F.transform(p, lambda x: F.concat(x["gap"], x["hit"])))

    def span(p: Column, before: Column, x: Column, i: Column) -> Column:
        start = (F.get(before, i) + F.char_length(x["gap"])).cast("int")
        first = F.greatest(i - BESIDE, F.lit(0))
        left = F.right(F.concat(joined(F.slice(p, first + 1, i - first)), x["gap"]), F.lit(CONTEXT_CHARS))
        right = F.left(joined(F.slice(p, i + 2, F.lit(BESIDE))), F.lit(CONTEXT_CHARS))
        follows = F.left(F.concat(F.get(p, i + 1)["gap"], F.get(p, i + 1)["hit"]), F.lit(1))
        near = F.lower(F.concat(left, F.lit("\n"), right))
        score = F.round(F.lit(SCORES[kind]) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), CONTEXT_BONUS).otherwise(0.0), 2)
        made = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.char_length(x["hit"])).cast("int").alias("end"), x["hit"].alias("value"), score.alias("score"))
        return F.when((x["hit"] != "") & keep(x["hit"], F.right(left, F.lit(1)), follows), made)

    return F.array_compact(bound(pieces, lambda p: bound(sums_before(lengths(p)), lambda before: F.transform(p, lambda x, i: span(p, before, x, i)))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The digits' sum from the right, every second one doubled (less 9 beyond 9), divides by ten."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(number, F.char_length(number) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(number) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """The account number moved before its country and check digits, letters as 10 to 35, is 1 modulo 97."""
    s = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substr(s, F.lit(5)), F.left(s, F.lit(4)))

    def add(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def confirmed(kind: str, value: Column) -> Column:
    n = F.char_length(digits(value))
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return mod97(value) if kind == "iban" else F.lit(True)


def find_pii(docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """docs with `spans`: array<struct<start, rank, end, value, score>> in order of start, then kind.

    A confirmed span's start score is raised if a context word of its kind stands within CONTEXT_CHARS of it; spans of a
    score under `least` are left out. The columns of docs stay but for one named `spans`, which is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    #: A kind's patterns run only over texts that hold a sign of it.
    signs = {"email": F.contains(whole, F.lit("@")), "phone": F.contains(whole, F.lit("+")), "iban": whole.rlike("[A-Z]{2}[0-9]{2}"), "ip": whole.rlike(r"[0-9]\.[0-9]"), "card": whole.rlike(r"[0-9][\x20-]?[0-9]")}
    alone = lambda before, after: ~F.concat(before, after).rlike("[A-Za-z0-9]")
    keeps = lambda k: lambda v, before, after: confirmed(k, v) & (alone(before, after) if k == "iban" else F.lit(True))
    found = [F.when(signs[k], proposals(whole, k, keeps(k))).otherwise(F.array().cast(SPAN)) for k in KINDS]
    spans = F.array_sort(reduce(F.concat, found))
    return docs.withColumn("spans", F.filter(spans, lambda s: s["score"] >= least) if least else spans)


def named(span: Column) -> Column:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), span["rank"] + 1)
    return F.concat_ws(":", kind, span["start"].cast("string"), span["end"].cast("string"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, named))
    return found.select(
        "doc_id",
        *map(n, BASE_KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        n("iban"),
        F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string"))).alias("scores"),
    )


def _duck_kind(kind: str, pattern: str, keep: str) -> str:
    """DuckDB's spans of a kind: the same walk over gaps and matches, by list functions."""
    near = f"lower(substr(t, cast(greatest(s - {CONTEXT_CHARS}, 0) as bigint) + 1, cast(s - greatest(s - {CONTEXT_CHARS}, 0) as bigint)) || chr(10) || substr(t, cast(e as bigint) + 1, {CONTEXT_CHARS}))"
    return f"""
  select doc_id, '{kind}' kind, {KINDS.index(kind)} rk, s, e,
    round({SCORES[kind]} + case when regexp_matches({near}, '\b(?:{CONTEXT[kind]})') then {CONTEXT_BONUS} else 0.0 end, 2)::double score
  from (select *, s + length(v) e from (
    select doc_id, t, unnest(hits) v, unnest(list_transform(range(1, len(hits) + 1),
      lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda g: length(g))), 0)))::bigint s
    from (select doc_id, t, regexp_extract_all(t, '{pattern}') hits, string_split_regex(t, '{pattern}') gaps from d)) x) y
  where {keep}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_DIGIT = f"cast(substr({_DIGITS}, length({_DIGITS}) - i, 1) as int)"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: case when i % 2 = 0 then {_DIGIT} when {_DIGIT} > 4 then {_DIGIT} * 2 - 9 else {_DIGIT} * 2 end)) % 10 = 0"
_PARTS = "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 and coalesce(try_cast(nullif(ltrim(p, '0'), '') as int), 0) <= 255))"
_IBAN = "replace(v, ' ', '')"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split(substr({_IBAN}, 5) || left({_IBAN}, 4), ''), lambda c: ascii(c))), lambda a, c: case when c < 58 then (a * 10 + c - 48) % 97 else (a * 100 + c - 55) % 97 end) = 1"
_ALONE = "not regexp_matches(case when s = 0 then '' else substr(t, s, 1) end || substr(t, cast(e as bigint) + 1, 1), '[A-Za-z0-9]')"

SQL = (
    "with d as (select doc_id, coalesce(text, '') t from documents), f as ("
    + " union all ".join([
        _duck_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _duck_kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", _PARTS),
        _duck_kind("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) between 12 and 19 and {_LUHN}"),
        _duck_kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15"),
        _duck_kind("iban", PATTERNS["iban"], f"{_MOD97} and {_ALONE}"),
    ])
    + """), g as (select doc_id, kind, rk, s, score, kind || ':' || s || ':' || e span from f)
select d.doc_id, count(*) filter (kind = 'email') n_email, count(*) filter (kind = 'ip') n_ip,
  count(*) filter (kind = 'card') n_card, count(*) filter (kind = 'phone') n_phone, count(*) filter (kind = 'iban') n_iban,
  sha256(coalesce(string_agg(span, ',' order by s, rk) filter (kind <> 'iban'), '')) base_sha256,
  coalesce(string_agg(span, ',' order by s, rk), '') spans, coalesce(string_agg(score::varchar, ',' order by s, rk), '') scores
from d left join g on d.doc_id = g.doc_id group by d.doc_id"""
)
