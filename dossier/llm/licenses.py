"""Licence scans by sentence rules, in DataFrame expressions.

Comment marks at the beginnings of lines are taken off. A text is cut into sentences at stops, blank lines and colons that
end a line, with other line ends as blanks (wrapped notices). Of what is no known sentence, the longest run of last lines
that is one counts (a notice right below other lines), and what stands before is cut at line ends; so each place gives the
longest known sentence that stands there. Sentences are normalised (A-Z lower-cased, runs of anything but
letters and digits one blank) and looked up among known licence sentences; an SPDX expression gives an identifier for each
licence it names. The identifiers found, in order, are matched against licence rules: an earlier rule takes its run of
identifiers first, so the full text of a licence wins over the notice inside it.

Cases: a null or empty text has no licence; a null doc_id stays null; repeated rows get equal rows;
identifiers that no rule takes are counted as unmatched; names in an SPDX expression that are not known are passed over; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.arrays import let
from dossier.llm.common import LOWER, UPPER, table

#: Known licence sentences by identifier (fixed values: the licences' own words, normalised).
SENTENCES = {
    "apache-ref": ["apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0", "licensed under the apache license version 2 0", "released under the apache license version 2 0", "spdx license identifier apache 2 0"],
    "apache-header": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "apache-terms": ["terms and conditions for use reproduction and distribution"],
    "apache-may-not": ["you may not use this file except in compliance with the license"],
    "apache-copy-at": ["you may obtain a copy of the license at"],
    "apache-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-ref": ["mit license", "the mit license", "the mit license mit", "released under the mit license", "licensed under the mit license", "this work is licensed under the mit license", "spdx license identifier mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-liable": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "gpl3-ref": ["gnu general public license version 3 29 june 2007", "spdx license identifier gpl 3 0", "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "spdx license identifier gpl 3 0 only"],
    "gpl3-later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "spdx license identifier gpl 3 0 or later"],
    "gpl2-ref": ["gnu general public license version 2 june 1991", "spdx license identifier gpl 2 0", "licensed under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0 only"],
    "gpl-no-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-see": ["see the gnu general public license for more details"],
    "gpl-copy": ["you should have received a copy of the gnu general public license along with this program"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-as-is": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd-liable": ["in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "bsd2-ref": ["licensed under the bsd 2 clause license", "bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "bsd-ref": ["licensed under the bsd 3 clause license", "bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "mpl-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "mpl-ref": ["mozilla public license version 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v", "licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "lgpl3-ref": ["gnu lesser general public license version 3 29 june 2007", "spdx license identifier lgpl 3 0", "licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3 0 only"],
    "lgpl3-later": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "spdx license identifier lgpl 3 0 or later"],
    "lgpl21-later": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "spdx license identifier lgpl 2 1 or later"],
    "lgpl21-ref": ["gnu lesser general public license version 2 1 february 1999", "spdx license identifier lgpl 2 1 only", "spdx license identifier lgpl 2 1"],
    "lgpl-see": ["see the gnu lesser general public license for more details"],
    "lgpl-copy": ["you should have received a copy of the gnu lesser general public license along with this library"],
    "agpl-see": ["see the gnu affero general public license for more details"],
    "agpl-copy": ["you should have received a copy of the gnu affero general public license along with this program"],
    "lgpl-no-warranty": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "agpl3-later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "spdx license identifier agpl 3 0 or later"],
    "agpl3-ref": ["gnu affero general public license version 3 19 november 2007", "spdx license identifier agpl 3 0", "licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3 0 only"],
    "gpl2-later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "spdx license identifier gpl 2 0 or later"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-as-is": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "isc-ref": ["isc license", "licensed under the isc license", "spdx license identifier isc"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "spdx license identifier unlicense"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "epl-ref": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", "licensed under the eclipse public license 2 0", "spdx license identifier epl 2 0"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"],
    "cc0": ["licensed under cc0 1 0", "to the extent possible under law the author has waived all copyright and related rights to this work"],
    "reserved": ["all rights reserved"],
}
#: Rules in order: (licence, class, the run of identifiers).
RULES = [
    ("Apache-2.0", "permissive", ["apache-header", "apache-copy-at", "apache-as-is", "apache-see"]),
    ("Apache-2.0", "permissive", ["apache-header", "apache-copy-at", "apache-as-is"]),
    ("Apache-2.0", "permissive", ["apache-ref", "apache-may-not", "apache-copy-at", "apache-as-is", "apache-see"]),
    ("Apache-2.0", "permissive", ["apache-ref", "apache-may-not", "apache-copy-at", "apache-as-is"]),
    ("Apache-2.0", "permissive", ["apache-ref", "apache-terms"]),
    ("Apache-2.0", "permissive", ["apache-header"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice", "mit-as-is", "mit-liable"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liable"]),
    ("BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable"]),
    ("BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl3-later", "gpl-no-warranty", "gpl-see", "gpl-copy"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3-later", "lgpl-no-warranty", "lgpl-see", "lgpl-copy"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21-later", "lgpl-no-warranty", "lgpl-see", "lgpl-copy"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl3-later", "gpl-no-warranty", "agpl-see", "agpl-copy"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-later", "gpl-no-warranty", "gpl-see", "gpl-copy"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl3-later", "gpl-no-warranty", "gpl-see"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl3-later", "gpl-no-warranty"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3-later", "lgpl-no-warranty", "lgpl-see"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3-later", "lgpl-no-warranty"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21-later", "lgpl-no-warranty", "lgpl-see"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21-later", "lgpl-no-warranty"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl3-later", "gpl-no-warranty", "agpl-see"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl3-later", "gpl-no-warranty"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-later", "gpl-no-warranty", "gpl-see"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-later", "gpl-no-warranty"]),
    ("MPL-2.0", "copyleft", ["mpl-ref", "mpl-copy"]),
    ("ISC", "permissive", ["isc-grant", "isc-as-is"]),
    ("Zlib", "permissive", ["zlib-as-is", "zlib-grant"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl3-later"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3-later"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21-later"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl3-later"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-later"]),
    ("Apache-2.0", "permissive", ["apache-ref"]),
    ("MIT", "permissive", ["mit-ref"]),
    ("BSD-3-Clause", "permissive", ["bsd-ref"]),
    ("BSD-2-Clause", "permissive", ["bsd2-ref"]),
    ("LGPL-2.1-only", "copyleft", ["lgpl21-ref"]),
    ("GPL-3.0-only", "copyleft", ["gpl3-ref"]),
    ("GPL-2.0-only", "copyleft", ["gpl2-ref"]),
    ("LGPL-3.0-only", "copyleft", ["lgpl3-ref"]),
    ("AGPL-3.0-only", "copyleft", ["agpl3-ref"]),
    ("MPL-2.0", "copyleft", ["mpl-ref"]),
    ("EPL-2.0", "copyleft", ["epl-ref"]),
    ("ISC", "permissive", ["isc-grant"]),
    ("ISC", "permissive", ["isc-ref"]),
    ("Unlicense", "permissive", ["unlicense"]),
    ("CC-BY-4.0", "permissive", ["cc-by"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", "noncommercial", ["cc-by-nc"]),
    ("CC0-1.0", "permissive", ["cc0"]),
    ("all-rights-reserved", "reserved", ["reserved"]),
]
KNOWN = {sentence: k for k, sentences in SENTENCES.items() for sentence in sentences}
#: Licences by their names in SPDX expressions.
EXPRESSION = "spdx license identifier "
NAMED = {sentence.removeprefix(EXPRESSION): k for sentence, k in KNOWN.items() if sentence.startswith(EXPRESSION)}
JOINED = " (?:and|or|with) "
#: Parts of single words: every known sentence has one, and no normalising takes a word apart, so a text without any
#: (whatever the case of letters) holds no known sentence and is not cut.
SIGNS = ["licen", "copyright", "permission", "warrant", "redistribut", "endorse", "reserved", "distributed", "unencumbered", "terms and conditions"]
MARKS = r"(?m)^[\x20\x09]*(?:/\*+|\*+/?|//+|#+|--+|;+|<!--|%+|dnl\x20|rem\x20)[\x20\x09]*"
LINES, SENTENCE_ENDS = r"[.!?][\x20\x09]+|[\n\r]+", r"[.!?][\x20\x09\n\r]+|:[\x20\x09\r]*\n|\n[\x20\x09\r]*\n"
#: Lines that a known sentence is wrapped to at most, where it does not begin its paragraph.
MOST_LINES = 12
CLASSES = ["noncommercial", "reserved", "copyleft", "permissive"]


def _number(s: Column, known: dict[str, str]) -> Column:
    by_id: dict[str, list[str]] = {}
    for sentence, k in known.items():
        by_id.setdefault(k, []).append(sentence)
    return F.coalesce(*[F.when(s.isin(own), F.lit(k)) for k, own in by_id.items()])


def _ids(text: Column) -> Column:
    """Identifiers of the known sentences of lower-cased text, in order."""
    plain = lambda s: F.btrim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    none = F.array().cast("array<string>")

    def of_line(s: Column) -> Column:
        names = F.split(F.substr(s, F.lit(len(EXPRESSION) + 1)), JOINED)
        return F.when(s.isin(list(KNOWN)), F.array(_number(s, KNOWN))).when(s.startswith(EXPRESSION), F.array_compact(F.transform(names, lambda n: _number(n, NAMED)))).otherwise(none)

    each_line = lambda p: F.flatten(F.transform(F.split(p, LINES), lambda q: let(plain(q), of_line)))

    def of_lines(lines: Column) -> Column:
        """The longest known run of whole lines up to the end, after the lines before it; else each line."""
        n = F.size(lines)
        starts = F.sequence(F.greatest(F.lit(1), n - MOST_LINES), n)
        run = lambda i: F.array_join(F.slice(lines, i + 1, n), "\n")
        known = F.filter(F.transform(starts, lambda i: F.struct(i.alias("i"), F.when(i < n, let(plain(run(i)), lambda s: F.when(s.isin(list(KNOWN)), _number(s, KNOWN)))).alias("id"))), lambda x: x["id"].isNotNull())
        before = lambda i: each_line(F.array_join(F.slice(lines, 1, i), "\n"))
        return let(F.get(known, F.lit(0)), lambda k: F.when(k.isNotNull(), F.concat(before(k["i"]), F.array(k["id"]))).otherwise(each_line(F.array_join(lines, "\n"))))

    whole = lambda p: let(plain(p), lambda s: F.when(s.isin(list(KNOWN)), F.array(_number(s, KNOWN))).otherwise(let(F.split(p, "\n"), of_lines)))
    return F.flatten(F.transform(F.split(F.regexp_replace(text, MARKS, ""), SENTENCE_ENDS), whole))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `sentences` (identifiers, array), `licenses` (distinct, sorted), `license_class`, `n_unmatched`."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    some = F.coalesce(F.col(text), F.lit("")).rlike("(?i)" + "|".join(SIGNS))
    docs = docs.withColumn("sentences", F.coalesce(F.when(some, let(lowered, _ids)), F.array().cast("array<string>")))
    #: Each identifier stands as " id ;" so that runs are substrings; a rule takes its runs out of what is left.
    left, taken = F.array_join(F.transform("sentences", lambda s: F.concat(F.lit(" "), s, F.lit(" ;"))), ""), []
    for licence, _, ids in RULES:
        run = "".join(f" {i} ;" for i in ids)
        taken.append(F.when(F.contains(left, F.lit(run)), F.lit(licence)))
        left = F.replace(left, F.lit(run), F.lit(" ;"))
    found = F.when(F.size("sentences") > 0, F.array_sort(F.array_distinct(F.array_compact(F.array(*taken))))).otherwise(F.array().cast("array<string>"))
    classes = {k: [name for name, c, _ in RULES if c == k] for k in CLASSES}
    docs = docs.withColumn("licenses", found).withColumn("n_unmatched", F.when(F.size("sentences") > 0, F.regexp_count(left, F.lit(r" [^ ;]+ ;"))).otherwise(0).cast("long"))
    hits = lambda k: F.arrays_overlap("licenses", F.array(*map(F.lit, classes[k])))
    return docs.withColumn("license_class", F.coalesce(*[F.when(hits(k), F.lit(k)) for k in CLASSES], F.when(F.col("n_unmatched") > 0, F.lit("unknown")), F.lit("none")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.concat_ws(",", "sentences").alias("sentences"), F.concat_ws(",", "licenses").alias("licenses"), "license_class", "n_unmatched")


def _sql() -> str:
    rows = lambda known: ", ".join(f"('{x}', '{k}')" for x, k in known.items())
    plain = lambda x: f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
    cut = lambda x, at: f"unnest(string_split_regex({x}, '{at}'))"
    steps, prev = [], "i0"
    for n, (licence, _, rule) in enumerate(RULES, 1):
        run = "".join(f" {i} ;" for i in rule)
        steps.append(f"i{n} as (select * exclude (l, got), replace(l, '{run}', ' ;') l, case when contains(l, '{run}') then list_append(got, '{licence}') else got end got from {prev})")
        prev = f"i{n}"
    classes = " ".join(f"when list_has_any(got, [{', '.join(repr(x) for x in dict.fromkeys(name for name, c, _ in RULES if c == k))}]) then '{k}'" for k in CLASSES)
    return f"""
with known(s, id) as (values {rows(KNOWN)}), named(s, id) as (values {rows(NAMED)}),
d as (select row_number() over () r, doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{MARKS}', '', 'g') t from documents),
p as (select r, {cut("t", SENTENCE_ENDS)} p, generate_subscripts(string_split_regex(t, '{SENTENCE_ENDS}'), 1) i from d),
w as (select p.*, id from (select *, {plain("p")} s from p) p left join known using (s)),
o as (select r, i, string_split(p, chr(10)) ls from w where id is null),
e as (select r, i, len(ls) n, unnest(range(greatest(1, len(ls) - {MOST_LINES}), len(ls))) k, ls from o),
y as (select r, i, min(k) k, arg_min(id, k) id from (select r, i, k, {plain("array_to_string(ls[k + 1:], chr(10))")} s from e) z join known using (s) group by r, i),
g as (select o.r, o.i, case when y.k is null then array_to_string(ls, chr(10)) else array_to_string(ls[:y.k], chr(10)) end p from o left join y on y.r = o.r and y.i = o.i),
l as (select r, i, {cut("p", LINES)} q, generate_subscripts(string_split_regex(p, '{LINES}'), 1) j from g),
m as (select l.*, id from (select *, {plain("q")} s from l) l left join known using (s)),
x as (select r, i, j, unnest(string_split_regex(substr(s, {len(EXPRESSION) + 1}), '{JOINED}')) s, generate_subscripts(string_split_regex(substr(s, {len(EXPRESSION) + 1}), '{JOINED}'), 1) h from m where id is null and starts_with(s, '{EXPRESSION}')),
f as (select r, i, 0 j, 0 h, id from w where id is not null union all select r, i, 1000000000, 0, id from y union all select r, i, j, 0, id from m where id is not null union all select r, i, j, h, named.id from x join named using (s)),
s as (select r, list(id order by i, j, h) ids from f group by r),
i0 as (select doc_id, coalesce(ids, []) ids, array_to_string(list_transform(coalesce(ids, []), lambda x: ' ' || x || ' ;'), '') l, []::varchar[] got from d left join s using (r)),
{", ".join(steps)}
select doc_id, len(ids)::bigint n_sentences, array_to_string(ids, ',') sentences, array_to_string(list_sort(list_distinct(got)), ',') licenses,
  case {classes} when len(regexp_extract_all(l, ' [^ ;]+ ;')) > 0 then 'unknown' else 'none' end license_class, len(regexp_extract_all(l, ' [^ ;]+ ;'))::bigint n_unmatched from {prev}"""


SQL = _sql()
