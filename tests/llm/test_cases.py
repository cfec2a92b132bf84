"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dossier.llm import decontaminate, embedding_dedup, language, licenses, line_dedup, ngram_join, packing, pii, quality, warc

#: Extra columns clash with names that the operators use inside.
DOCS = "doc_id long, text string, lang string, row string, key string, doc string, spans string, n_words string"
LONG = "word " * 30_000


def docs(spark, *texts, ids=None):
    rows = [(i, t, "en", "x", "y", "z", "s", "w") for i, t in zip(ids or range(1, len(texts) + 1), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def rows(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key], str(r)))


# op1


def items(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, doc string")


PASSAGE = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november"


def test_contamination(spark):
    d = docs(spark, None, "", PASSAGE.upper(), "x " + PASSAGE + " y", PASSAGE.replace("delta", "other"), "short item", "filler " * 700 + PASSAGE, LONG, PASSAGE.upper(), ids=[1, 2, 3, 4, 5, 6, 7, 8, 3])
    got = rows(decontaminate.contamination(d, items(spark, PASSAGE, "Short, ITEM!", None, "", PASSAGE)))
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got] == [
        (1, 0, 0, [], False), (2, 0, 0, [], False), (3, 14, 14, ["0", "4"], True), (3, 14, 14, ["0", "4"], True), (4, 16, 14, ["0", "4"], True),
        (5, 14, 0, [], False), (6, 2, 2, ["1"], True), (7, 714, 14, ["0", "4"], False), (8, 30_000, 0, [], False),
    ]


def brute_contamination(pairs, items, window=13, share=20):
    """doc_id, words, hit words, names of items with a window in it, contaminated."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low))
    windows = {}
    for name, text in items:
        w = words(text)
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(name)
    out, widths = [], {len(w) for w in windows}
    for i, text in pairs:
        w, hit, names = words(text), set(), set()
        for k in widths:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit.update(range(s, s + k))
                    names |= windows[tuple(w[s : s + k])]
        out.append((i, len(w), len(hit), sorted(str(n) for n in names if n is not None), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination_against_brute_force(spark):
    """Unnamed items hit words too; passages that repeat in a text, and ones that overlap themselves."""
    rng = np.random.default_rng(6)
    word = lambda n, kinds=40: " ".join(f"w{i}" for i in rng.integers(0, kinds, n))
    given = [(1, PASSAGE), (None, "some words of an item without any name at all but long enough to be one"), (3, "tick tock " * 20), (4, word(30, 3)), (5, word(3)), (6, "one"), (1, word(20))]
    texts = [PASSAGE + " " + given[1][1], given[1][1].upper(), "tick tock " * 300, "x tick tock " * 30 + "tick tock " * 7, (PASSAGE + " ") * 2000, word(400, 3), word(300), "One", PASSAGE[10:], None]
    frame = spark.createDataFrame([(i, t, "x") for i, t in given], "item_id long, text string, doc string")
    got = decontaminate.contamination(docs(spark, *texts), frame).collect()
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got], key=str)
    assert got == brute_contamination(list(enumerate(texts, 1)), given)


def test_contamination_of_nothing(spark):
    assert rows(decontaminate.contamination(docs(spark, "a b").limit(0), items(spark, PASSAGE))) == []
    assert [r["n_hit"] for r in rows(decontaminate.contamination(docs(spark, "a b", ids=[None]), items(spark, "a").limit(0)))] == [0]


def test_near_matches(spark):
    d = decontaminate.keyed(docs(spark, "red x green y blue", "red z z z z z z z z green blue", "blue green"))
    index = decontaminate.build_index(d)
    found = decontaminate.near_matches(decontaminate.phrases(items(spark, "Green red BLUE")), index, 5).join(d, "doc")
    assert [r["doc_id"] for r in rows(found)] == [1]


# op2


def brute_lines(pairs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(low)
    holders = {}
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LINES = [
    (1, "Common line here\nunique one is here\nshort"), (2, "  common LINE here\t\nshort\nÉcole à côté\n"), (3, None), (4, ""), (5, "twice in one doc\ntwice in one doc"),
    (6, "école à côté\nÉcole à côté"), (7, "Common line here"), (7, "Common line here"), (None, "Common line here\nx"), (8, "\n\n\n"), (9, "y" * 50_000 + "\ncommon line here\x0b"),
]


def read_lines(out):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()), key=str)


@pytest.mark.parametrize("most", [line_dedup.FILTER_BYTES, 0])
def test_lines(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", most)  # 0: the way without filters
    d = docs(spark, *[t for _, t in LINES], ids=[i for i, _ in LINES])
    assert read_lines(line_dedup.LineStore(spark).insert(d).deduplicated(d)) == brute_lines(LINES)
    assert read_lines(line_dedup.LineStore(spark).insert(d.limit(0)).deduplicated(d.limit(0))) == []


def test_lines_are_reversible(spark):
    named = [(i, t) for i, t in LINES if i is not None]
    first, second = [x for x in named if x[0] > 3], [x for x in named if x[0] <= 3]
    frame = lambda part: docs(spark, *[t for _, t in part], ids=[i for i, _ in part])
    store = line_dedup.LineStore(spark).insert(frame(first))
    state = lambda: sorted(store.refs.collect())
    before = state()
    store.insert(frame(second))
    assert read_lines(store.deduplicated(frame(named))) == brute_lines(named)
    store.delete(spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"))
    assert state() == before
    assert read_lines(store.deduplicated(frame(first))) == brute_lines(first)


def test_lines_with_clashing_columns(spark):
    """Columns that the result makes are replaced, working columns go, others stay."""
    df = spark.createDataFrame([(1, "the very same line", "a", "b", "c", "d"), (2, "the very same line\nmore", "a", "b", "c", "d")], "doc_id long, text string, _text string, _lost string, kept string, at string")
    out = line_dedup.LineStore(spark).insert(df).deduplicated(df)
    assert [(r["doc_id"], r["n_dropped"], r["kept"], r["at"]) for r in out.orderBy("doc_id").collect()] == [(1, 0, "the very same line", "d"), (2, 1, "more", "d")]
    assert sorted(out.columns) == ["at", "doc_id", "kept", "n_dropped", "n_lines", "text"]


def test_lines_of_a_store_opened_again(spark, tmp_path):
    """A store goes on where it was, also past a change that was cut off; a repeated insert changes nothing."""
    path = f"file://{tmp_path}/store"
    text = lambda *lines: "\n".join(lines)
    one = spark.createDataFrame([(1, text("a line of some length", "mine alone, number one")), (2, text("a line of some length", "short"))], "doc_id long, text string")
    two = spark.createDataFrame([(0, text("A LINE of some length ", "another one for zero")), (3, text("mine alone, number one"))], "doc_id long, text string")
    every = one.unionByName(two)
    result = lambda store: sorted(tuple(r) for r in store.deduplicated(every).select("doc_id", "n_dropped").collect())
    line_dedup.LineStore(spark, path, min_chars=8).insert(one)
    store = line_dedup.LineStore.open(spark, path)
    assert store.min_chars == 8 and result(store) == [(0, 1), (1, 0), (2, 1), (3, 0)]
    #: A change that wrote a table and then ended.
    store._write(more=line_dedup.holders_of(two, 8))
    store = line_dedup.LineStore.open(spark, path).insert(two).insert(one)
    both = [(0, 0), (1, 1), (2, 1), (3, 1)]
    assert result(store) == result(line_dedup.LineStore.open(spark, path)) == both
    line_dedup.LineStore.open(spark, path).delete(spark.createDataFrame([(0,), (3,)], "doc_id long"))
    again = line_dedup.LineStore.open(spark, path)
    assert sorted(tuple(r) for r in again.refs.select("n_docs", "keeper").collect()) == [(1, 1), (2, 1)]
    with pytest.raises(Exception):
        line_dedup.LineStore.open(spark, f"file://{tmp_path}/nothing")


def test_line_filters_grow_with_their_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
    texts = ["\n".join(f"a line of text, number {i}" for i in range(a, a + 20)) for a in (0, 10, 15, 40, 45, 5)]
    frame = lambda ids: docs(spark, *[texts[i] for i in ids], ids=ids)
    store = line_dedup.LineStore(spark).insert(frame([0, 1]))
    before = store.shards
    store.insert(frame([2, 3, 4, 5]))
    assert store.shards > before
    assert read_lines(store.deduplicated(frame([*range(6)]))) == brute_lines(list(enumerate(texts)))
    store.delete(spark.createDataFrame([(0,), (3,)], "doc_id long"))
    left = [1, 2, 4, 5]
    assert read_lines(store.deduplicated(frame(left))) == brute_lines([(i, texts[i]) for i in left])


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    f = line_dedup.CuckooFilter(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    assert f.contains(rng.integers(0, 2**63, 50_000).astype(np.uint64)).mean() < 0.01
    f.delete(keys[:25_000])
    assert f.contains(keys[25_000:]).all() and f.contains(keys[:25_000]).mean() < 0.01


# op3


def brute_components(pairs, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in pairs:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").translate(low)) if x]
        k = min(n, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(count, words, seed):
    """Chains of edits of one text, exact copies, and unrelated texts that share a common passage."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(vocabulary, words))
    out = []
    for i in range(count):
        t = base.copy()
        for at in rng.integers(0, words, int(rng.integers(0, 6))):
            t[at] = str(rng.choice(vocabulary))
        out.append(" ".join(t))
    shared = " ".join(rng.choice(vocabulary, 60))
    out += [shared + " " + " ".join(rng.choice(vocabulary, int(rng.integers(5, 200)))) for _ in range(count // 2)]
    out += [" ".join(rng.choice(vocabulary[:30], int(rng.integers(1, 6)))) for _ in range(count)]
    return out


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 192), (5, 80, 20)])
def test_jaccard(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = [*near_copies(120, 80, 3), None, "", "  \t\n ", "One two", "one TWO", "one two three", LONG, LONG + " word", "É a b c d", "é a b c d"]
    ids = [*np.random.default_rng(2).permutation(len(texts)).tolist()]
    d = docs(spark, *texts, ids=ids)
    want = brute_components(list(zip(ids, texts, strict=True)), n, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(d, n, percent).collect()}
    assert got == want


def test_jaccard_of_long_lists(spark, monkeypatch):
    """Lists that fall into parts: what neighbours leave apart is found by the second pass."""
    monkeypatch.setattr(ngram_join, "CHAIN", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "SPELT", 3)
    monkeypatch.setattr(ngram_join, "PART", 4)
    texts = near_copies(60, 60, 9) + near_copies(30, 25, 10)
    d = docs(spark, *texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(d).collect()}
    assert got == brute_components(list(enumerate(texts, 1)), 4, 85)


def test_jaccard_of_words_that_weak_hashes_mix_up(spark):
    """Thue-Morse words and their complements collide under polynomials modulo a power of two."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [" ".join([word] * k + ["x"] * k) for k in (1, 5)] + [" ".join([other] * k + ["x"] * k) for k in (1, 5)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs(spark, *texts)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_jaccard_of_ids_with_several_texts(spark):
    """Near copies of either text are linked with the id, and two such ids tie what they hold."""
    one, two, three = (" ".join(f"{p}{i}" for i in range(60)) for p in "uvw")
    d = docs(spark, one, two, one + " end", two + " end", three, three, one, ids=[5, 5, 7, 9, 11, 12, 12])
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(d).collect()}
    assert got == {(i, 5) for i in (5, 7, 9, 11, 12)}


def test_shingles_of_one_long_text(monkeypatch):
    text = ("Some words\tof a text\n" * 50 + "x" * 300 + " \x0b ") * 3
    whole = ngram_join.Shingler(4).of(text.encode())
    monkeypatch.setattr(ngram_join, "AT_ONCE", 64)
    assert (ngram_join.Shingler(4).of(text.encode()) == whole).all()
    w = text.lower().split()
    assert len(whole) == len({tuple(w[i : i + 4]) for i in range(len(w) - 3)})


def test_jaccard_repeats_and_nulls(spark):
    d = docs(spark, "a b c d e", "a b c d e", "a b c d e", None, ids=[3, 3, None, 5])
    got = rows(ngram_join.jaccard_components(d))
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got] == [(3, 2, 3), (3, 2, 3), (5, 0, 5), (None, 2, None)]
    assert rows(ngram_join.jaccard_components(d.limit(0))) == []


# op4


def brute_pii(t):
    def luhn(d):
        return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
    }
    out = [(m.start(), list(patterns).index(k), k, m.end()) for k, (p, ok) in patterns.items() for m in re.finditer(p, t or "") if ok(m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


PII = [
    None, "", "mail a.b+c@x-y.co.uk or é@b.c, a@b.c@d.e and x@y.", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.02.3.255 é 10.0.0.1.",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "call +49 (30) 123.456-7, +1-2 +123456789012345678 +12 3456789 ",
    "😀 a@b.c 😀 +49 30 1234567 😀", "1 2 " * 20_000, "a" * 5_000, "9" * 200_000, "1." * 5_000, "+1" * 5_000 + "+12345678901", "a@b" + ".c" * 5_000,
]


def test_pii(spark):
    d = docs(spark, *PII)
    got = [r["spans"] for r in rows(pii.find_pii(d))]
    base = [",".join(f"{pii.KINDS[s['rank']]}:{s['start']}:{s['end']}" for s in spans if s["rank"] < 4) for spans in got]
    assert base == [brute_pii(t) for t in PII]
    assert rows(pii.find_pii(d.limit(0))) == []


def test_pii_in_very_long_runs(spark):
    """Where the plain version takes quadratic time."""
    d = docs(spark, "a" * 500_000, "1." * 200_000, "+1" * 100_000 + "+12345678901", "a@b" + ".c" * 200_000)
    got = [[(pii.KINDS[s["rank"]], s["start"], s["end"]) for s in r["spans"] if s["rank"] < 4] for r in rows(pii.find_pii(d))]
    assert got[0] == [] and got[1] == [("ip", 8 * i, 8 * i + 7) for i in range(50_000)]
    assert got[2] == [("phone", 200_000, 200_012)] and got[3] == [("email", 0, 400_003)]


def test_ibans_of_all_lengths(spark):
    """Planted account numbers, in groups of four or not, before capital words or at an end; all are found, no others."""
    def made(country, n):
        body = "".join(str(i * 7 % 10) for i in range(n - 4))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{check:02}{body}"

    plain = [made(c, n) for n, names in pii.IBAN_LENGTHS.items() for c in names.split("|")]
    grouped = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in plain]
    texts = [f"{before}{x}{after}" for x in plain + grouped for before, after in (("to ", " BIC COBADEFF"), ("", ""), ("é", " USD 500."))]
    texts += [x[:-1] + str((int(x[-1]) + 1) % 10) for x in plain] + [x + "7" for x in plain]
    got = [[(s["start"], s["value"]) for s in r["spans"] if s["rank"] == 4] for r in rows(pii.find_pii(docs(spark, *texts)))]
    want = [[(len(before), x)] for x in plain + grouped for before in ("to ", "", "é")]
    assert got[: len(want)] == want and got[len(want) :] == [[]] * (2 * len(plain))


def test_many_matches(spark):
    texts = ["a%d@b.co, call +49 30 1234%03d or 10.0.0.%d; " % (i % 9, i % 999, i % 300) * 1 for i in range(3)]
    long = "".join("a%d@b.co, call +49 30 1234%03d or 10.0.0.%d; " % (i, i % 999, i % 300) for i in range(1500))
    got = [r["spans"] for r in rows(pii.find_pii(docs(spark, *texts, long)))]
    base = [",".join(f"{pii.KINDS[s['rank']]}:{s['start']}:{s['end']}" for s in spans if s["rank"] < 4) for spans in got]
    assert base == [brute_pii(t) for t in [*texts, long]]
    assert all(s["score"] == 0.7 for s in got[3] if s["rank"] == 3) and all(s["value"] == long[s["start"] : s["end"]] for s in got[3])
    assert [len(r["spans"]) for r in rows(pii.find_pii(docs(spark, texts[0]), least=0.75))] == [1]


def test_iban_and_context(spark):
    d = docs(spark, "bank account: GB82 WEST 1234 5698 7654 32.", "GB82WEST12345698765431", "XGB82WEST12345698765432", "DE89370400440532013000", "host 10.0.0.1", "10.0.0.1")
    got = [[(pii.KINDS[s["rank"]], s["start"], s["end"], s["score"]) for s in r["spans"] if s["rank"] in (1, 4)] for r in rows(pii.find_pii(d))]
    assert got == [[("iban", 14, 41, 1.0)], [], [], [("iban", 0, 22, 0.8)], [("ip", 5, 13, 0.7)], [("ip", 0, 8, 0.5)]]


# op5


def test_warc(spark):
    import hashlib

    big, magic = "x" * 120, warc.MAGIC
    fake = "a" * 50 + magic + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + magic + "é" * 60
    pages = [(1, big), (2, big), (3, None), (4, "short"), (5, "short"), (6, fake), (7, warc.END * 40), (None, big), (8, ""), (9, magic), (10, fake), (11, warc.END + magic * 30 + warc.END), (-5, "ñ" * 70), (2**60 + 1, "y" * 100), (12, big), (12, big)]
    for parts in (1, 3):
        df = spark.createDataFrame([(i, f"u\r\nX-{i}: 1", h, "x") for i, h in pages], "page_id long, url string, html string, digest string").repartition(parts)
        path = warc.shared_dir(spark, "warc")
        warc.write_warc(df, path)
        got = sorted(((r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["intact"]) for r in warc.read_warc(spark, path).collect()), key=str)
        first = {}
        for i, h in pages:
            if i is not None and len((h or "").encode()) >= 100:
                first[h] = min(i, first.get(h, i))
        want = []
        for i, h in pages:
            ref = first.get(h) if i is not None and first.get(h, i) != i else None
            want.append((i, "revisit" if ref is not None else "response", len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), ref, True))
        assert got == sorted(want, key=str)


def test_warc_of_nothing(spark):
    path = warc.shared_dir(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_split_archives_are_refused(spark):
    path = warc.shared_dir(spark, "plain")
    spark.createDataFrame([(warc.MAGIC + "WARC-Type: response\r\nContent-Length: 40\r\n\r\n" + "x" * 40,)] * 400, "value string").coalesce(1).write.option("lineSep", warc.END).text(path)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        with pytest.raises(Exception, match="was split"):
            warc.read_warc(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert warc.read_warc(spark, path).filter("payload_bytes = 40").count() == 400


def test_chain_rejects_unreachable():
    import pandas as pd

    at = np.array([0, 100, 150, 300, 900])
    content = np.array([100, 200, 750, np.nan, 100]) - len(warc.MAGIC) - len(warc.END)
    got = warc.chain(pd.DataFrame({"at": at, "content": content}))
    assert got["record"].tolist() == [True, True, False, True, False] and got["owner"].tolist() == [0, 100, 100, 300, 300]


# op6


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = [None, "", "a   b", "  x", "a \n\n b", "x \t y ", "\n\n\n", "<|endoftext|> hi", "it's we'll", "a  b", "a\x00b c  d", "é 😀 ñ", "word " * 5000, "a b", "a b"]
    ids = [*range(13), 20, 20]
    got = packing.packed(docs(spark, *texts, ids=ids), packing.default_tokenizer()).toPandas()
    want = Counter()
    for i, text in zip(ids, texts, strict=True):
        own = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((i, s, min(2048, len(own) - s), zlib.crc32(own[s : s + 2048]), len(own)) for s in range(0, len(own), 2048))
    assert Counter(got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)) == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048
    assert packing.packed(docs(spark, "a").limit(0), packing.default_tokenizer()).count() == 0


def test_packing_reads_added_tokens(spark):
    """Against the tokenizer as its file is loaded, which takes <|endoftext|> in a text for its id."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "a  <|endoftext|>\n\n<|endoftext|> it's", "<|endoftext|", "plain text", "", None, "<|endoftext|> " * 3000]
    got = packing.packed(docs(spark, *texts), packing.default_tokenizer()).toPandas()
    want = Counter()
    for i, text in enumerate(texts):
        own = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((s, min(2048, len(own) - s), zlib.crc32(own[s : s + 2048]), len(own)) for s in range(0, len(own), 2048))
    assert 50256 in t.encode(texts[0], add_special_tokens=False).ids
    import corpus_pipeline

    staged = corpus_pipeline.packing_stage(spark, docs(spark, *texts), "").toPandas()
    assert sorted(staged["ids_crc32"]) == sorted(got["ids_crc32"])
    assert Counter(got[["start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)) == want


def test_packing_of_long_runs():
    """Texts that overflow the faster encoder's stack, and ones that are encoded in segments."""
    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer())
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + " b", "x y  z \t" * 100_000, ("é" * 500 + "  <|endoftext|> ") * 900, "a b " * 200_000 + " " * 20_000 + "c"]
    ids, at = encoder.ids(texts)
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == t.encode(text, add_special_tokens=False).ids


def test_ranks_are_gapless(spark):
    """Pieces of each length are numbered 0, 1, ... whatever the tasks they were cut by, full windows as well."""
    d = docs(spark, *["a b"] * 50, *["word " * 5000] * 20, *["c"] * 30).repartition(7)
    pieces = packing.stored(packing.tokenised_pieces(d, packing.default_tokenizer()), "pieces")
    got = packing.ranked(pieces).toPandas()
    assert got["part"].nunique() > 1
    for _, own in got.groupby("length"):
        assert sorted(own["rank"]) == list(range(len(own)))


def test_minimum_slack_packs_closely():
    rng = np.random.default_rng(4)
    histogram = np.bincount(rng.integers(1, 2048, 5000), minlength=2049)
    patterns = packing.minimum_slack(histogram)
    used = Counter()
    for lengths, times in patterns:
        assert sum(n * k for n, k in lengths) <= 2048
        for n, k in lengths:
            used[n] += k * times
    assert used == {n: c for n, c in enumerate(histogram) if c}
    assert sum(t for _, t in patterns) * 2048 < 1.01 * (histogram * np.arange(2049)).sum()


def test_fullest_is_the_best_sum():
    from itertools import product

    rng = np.random.default_rng(5)
    for _ in range(50):
        counts = np.zeros(41, int)
        for n in rng.integers(1, 41, 4):
            counts[n] += rng.integers(1, 3)
        sums = {sum(n * k for n, k in zip(np.flatnonzero(counts), ks, strict=True)) for ks in product(*[range(counts[n] + 1) for n in np.flatnonzero(counts)])}
        got = packing.fullest(counts, 40)
        assert sum(n * k for n, k in got) == max(s for s in sums if s <= 40) and all(k <= counts[n] for n, k in got)


# op7


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. More."


def test_licenses(spark):
    d = docs(spark, None, "", MIT, "Text.\nReleased under the MIT License.\nmore", "licensed under the\nApache License, Version 2.0.", "Licensed under CC BY-NC 4.0.\nAll rights reserved.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "no license at all", LONG)
    got = [(r["licenses"], r["license_class"], r["n_unmatched"]) for r in rows(licenses.scan_licenses(d))]
    assert got == [([], "none", 0), ([], "none", 0), (["MIT"], "permissive", 0), (["MIT"], "permissive", 0), (["Apache-2.0"], "permissive", 0), (["CC-BY-NC-4.0", "all-rights-reserved"], "noncommercial", 0), ([], "unknown", 1), ([], "none", 0), ([], "none", 0)]
    assert rows(licenses.scan_licenses(d.limit(0))) == []


def test_licenses_in_odd_dress(spark):
    """White space, frames and rules around and inside known sentences; every known sentence has a sign of one."""
    d = docs(spark, "x. All rights  reserved. y", "All\t rights\treserved", "all rights\nreserved. More.", "*" * 3000 + " Licensed under the MIT License. x", "/* " + "=" * 5000 + " */ All Rights -- Reserved", "Source Code Form. This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy", "SPDX-License-Identifier: LGPL-3.0-or-later")
    got = [r["licenses"] for r in rows(licenses.scan_licenses(d))]
    assert got == [["all-rights-reserved"], ["all-rights-reserved"], ["all-rights-reserved"], ["MIT"], ["all-rights-reserved"], ["MPL-2.0"], ["LGPL-3.0-or-later"]]
    known = [s for v in licenses.SENTENCES.values() for s in v]
    assert len(known) == len(set(known)) and all(any(sign in s for sign in licenses.SIGNS) for s in known)
    assert {i for _, _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES)


# op8


def test_language_of_one_long_text(spark, sf, monkeypatch):
    """A text read in pieces, its words at work in blocks, gives what it gives as a whole."""
    model = language.learned(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = ["the house and the garden " * 40 + "la maison et le jardin " * 30 + "x" * 500, "naïve façade, été", "", "1 2 3", "ünd der garten " * 25]
    whole, words = language.infer(model, texts), [model.words(t.encode()) for t in texts]
    monkeypatch.setattr(language, "BYTES_AT_ONCE", 37)
    monkeypatch.setattr(language, "WORDS_AT_ONCE", 50)
    assert all(np.allclose(model.words(t.encode()), w, rtol=1e-4) for t, w in zip(texts, words, strict=True))
    for a, b in zip(language.infer(model, texts), whole, strict=True):
        assert [k for k, _ in a] == [k for k, _ in b] and np.allclose([v for _, v in a], [v for _, v in b], atol=1e-3)


def test_language_of_four_in_one(spark, sf):
    """A text of equal parts in all four languages keeps each of them, about a quarter each."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    parts = {}
    for r in d.filter("lang is not null and char_length(text) > 400").orderBy("doc_id").collect():
        parts.setdefault(r["lang"], []).append(r["text"])
    assert len(parts) == 4
    text = "\n".join(" ".join(" ".join(own).split()[:2000]) for own in parts.values())
    share = {k: len(" ".join(" ".join(own).split()[:2000]).split()) for k, own in parts.items()}
    (row,) = rows(language.with_language(docs(spark, text), language.learned(d)))
    got = {k: float(v) for k, v in (x.split(":") for x in row["languages"].split(","))}
    assert set(got) == set(parts) and all(abs(got[k] - n / sum(share.values())) < 0.1 for k, n in share.items())
    assert abs(row["score"] - max(got.values())) < 0.01


def test_language(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.op8_language(spark, sf).toPandas().merge(d.select("doc_id", "lang").toPandas(), on="doc_id")
    assert [h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"], strict=True)].count(False) == 0
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.95
    model = language.learned(d)
    odd = docs(spark, None, "", "123 456 !!", "the", LONG, "é", ids=[1, 2, 3, 4, None, 5])
    found = rows(language.with_language(odd, model))
    assert [r["lang_pred"] for r in found[:3]] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in found)
    assert rows(language.with_language(odd.limit(0), model)) == []
    assert {r["lang_pred"] for r in rows(language.with_language(odd, language.fit(d.limit(0))))} == {"und"}


def test_language_mixture(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r["lang"]: r["text"] for r in d.filter("n_chars between 1500 and 3000").collect()}
    model = language.learned(d)
    en, fr = one["en"], one["fr"]
    (found,) = language.infer(model, [en[:1500] + " " + fr[:1500]])
    assert {k for k, v in found if v > 0.25} == {"en", "fr"}


# op9


def brute_links(x, cosine=0.95):
    good = [i for i, v in enumerate(x) if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    n, root = [0] * len(x), list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in good:
        for j in good:
            if i < j and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return [(i, n[i], find(i), find(i) == i) for i in range(len(x))]


@pytest.mark.parametrize("hot", [embedding_dedup.HOT, 10])
def test_embeddings(spark, monkeypatch, hot):
    monkeypatch.setattr(embedding_dedup, "HOT", hot)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 30)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(20, 16))
    x = [list(map(float, centre[i % 20] + rng.normal(size=16) * 0.08)) for i in range(200)]
    x += [x[0], x[0], [c * 3 for c in x[1]], [0.0] * 16, None, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, x[2][:8], [1e-200] * 16, [1e200] * 16, []]
    df = spark.createDataFrame([(i, v, 0, "k") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, rep string")
    got = rows(embedding_dedup.near_duplicates(df), "vec_id")
    want = brute_links(x)
    found, all_links = sum(r["n_links"] for r in got), sum(w[1] for w in want)
    assert found >= 0.98 * all_links and all(r["n_links"] <= w[1] for r, w in zip(got, want, strict=True))
    assert sum((r["component_id"], r["kept"]) == w[2:] for r, w in zip(got, want, strict=True)) >= len(x) - 2
    assert rows(embedding_dedup.near_duplicates(df.limit(0)), "vec_id") == []


@pytest.mark.parametrize("n", [1000, 50_000, 5_000_000])
def test_filters_catch_pairs_at_the_limit(n):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    caught = np.zeros(len(x), bool)
    for k in range(embedding_dedup.how_many(n)):
        code = embedding_dedup.Code.for_size(64, n, k, embedding_dedup.FILTERS / embedding_dedup.CODES)
        mine, other = (set(zip(*map(np.ndarray.tolist, code.decode(v)), strict=True)) for v in (x, y))
        caught[[i for i, _ in mine & other]] = True
    assert caught.mean() >= 0.97


# op10


def test_quality(spark, sf):
    texts = ["Plain prose of a text. It goes on, and on."] * 3
    net = quality.train([*texts, *["*** $$$ ### !!! %%%"] * 3], [1, 1, 1, 0, 0, 0])
    d = docs(spark, None, "", texts[0], "*** $$$ ###", LONG, ids=[1, 2, 3, 4, None])
    got = rows(quality.score(d, net))
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert got[2]["score"] > got[3]["score"] and got[0]["score"] == got[1]["score"]
    assert [r["score"] for r in rows(quality.score(d, None))] == [0.5] * 5
    assert rows(quality.score(d.limit(0), net)) == []
    assert quality.fit(d, spark.createDataFrame([], "doc_id long, label int")) is None


def test_quality_of_held_out_documents(spark):
    """Labels that the fit never saw are ranked well, and mostly predicted."""
    sf = "/root/testdata/sf0.01"
    got = quality.op10_quality(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("quality is not null").toPandas()
    good, bad = (got.loc[got["quality"] == k, "score"].to_numpy() for k in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    assert ((good[:, None] > bad[None]) + 0.5 * (good[:, None] == bad[None])).mean() >= 0.95
    assert (got["predicted"] == got["quality"]).mean() >= 0.9


def test_quality_reads_whole_texts():
    net = quality.Network.fresh(np.random.default_rng(1))
    long = "plain words here " * 3000
    whole = quality.scores(net, [long, long + "*** $$$"])
    assert whole[0] != whole[1]
    assert np.allclose(quality.scores(net, [long], size=7), whole[0])


def test_quality_gradient():
    rng = np.random.default_rng(3)
    net = quality.Network.fresh(rng)
    d = [quality.chunks(b"some words and more words " * k) for k in (3, 20, 40)]
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)
    grads = quality.step(net, d, y, w)

    def loss():
        n = np.array(list(map(len, d)))
        top, _ = quality.pooled(net, np.concatenate(d))
        p = quality.sigmoid(quality.features(top, np.cumsum(n) - n, n) @ net.out + net.base)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for p, g in ((net.out, grads[3]), (net.bias, grads[2])):
        at = int(np.abs(g).argmax())
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.1)
