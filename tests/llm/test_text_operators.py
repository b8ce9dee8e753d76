"""Operators that judge each text by itself, against plain Python."""

import hashlib
import random
import re
import time
from collections import Counter

import public_tokenizers
import pytest
from kveil.llm import bpe, licenses, pii, quality, urls
from pyspark.sql import functions as F
from samples import docs, empty, rows, texts  # noqa: F401
from tokenizers import Tokenizer


def words(text):
    return (text or "").encode().split()


def measures(text):
    w, n = words(text), len(words(text))
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(n - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return n, sum(len(x.decode()) for x in w), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(docs):
    out = quality.quality_rules(docs.withColumnRenamed("quality", "other"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "other", "id", "digest", "quality"]
    for r in out.collect():
        q, want = r.quality, measures(r.text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert q.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (q.base_failed and q.kept)


def repeat_counts(spark, told):
    df = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")
    out = df.select("doc_id", quality.repeat_words(quality.words_of(F.col("text"))).alias("n"))
    return {r.doc_id: r.n for r in out.collect()}


# two words whose windows with "x y" share 40 bits of their hash
CLASHING = "w515394 x y w4719496 x y w515394 x y w4719496 x y"


@pytest.mark.parametrize("hashes, place_bits", [(None, 24), (3, 24), (1, 24), (None, 3), (2, 5)])
def test_repeat_words_do_not_hang_on_hashes_or_on_length(spark, monkeypatch, hashes, place_bits):
    """Forced clashes of the windows' hashes, and texts with more words than their places have bits for."""
    r = random.Random(place_bits)
    told = [CLASHING, CLASHING.replace("x y", "x y z"), "a b c " * 4, "a b", "", None, "a a a", "a a a a"]
    told += [" ".join(r.choice("abcd") for _ in range(r.randint(1, 60))) for _ in range(60)]
    plain = quality.window_hash
    if hashes:
        monkeypatch.setattr(quality, "window_hash", lambda *w: F.pmod(plain(*w), F.lit(hashes)))
    monkeypatch.setattr(quality, "PLACE_BITS", place_bits)
    assert repeat_counts(spark, told) == {i: measures(t)[4] for i, t in enumerate(told)}
    if not hashes:
        assert repeat_counts(spark, [CLASHING]) == {0: 12}


def test_repeat_words_of_a_very_long_text(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(140_000))
    assert repeat_counts(spark, [long]) == {0: 140_000}


def test_quality_stage_leaves_columns_of_any_name_alone(spark):
    r = random.Random(1)
    usual = "the the the of of and to in a is that for it".split() + [f"{a}{b}en" for a in "stmkl" for b in "aeiou"]
    fine = " ".join(r.choice(usual) + r.choice(["", "", ".", a]) for a in "xyzuvw" * 30)
    names = "doc_id long, text string, lang string, quality string, __q_x string, __q_words string, row string, `a.b` string"
    df = spark.createDataFrame([(1, fine, "en", *"abcde"), (2, "short", "en", *"abcde"), (1, fine, "en", *"abcde")], names)
    kept = quality.keep_clean(spark, df, "")
    assert kept.schema == df.schema
    assert [tuple(r) for r in kept.collect()] == [(1, fine, "en", *"abcde")] * 2
    assert quality.keep_clean(spark, df.limit(0), "").count() == 0
    assert quality.quality_rules(df).columns == [c for c in df.columns if c != "quality"] + ["quality"]


def test_divergence_needs_length_and_a_known_language(spark):
    clean = "the river and the stone of a quiet garden is that lamp to the north in winter for it was paper. " * 12
    clean = " ".join(f"{w}{i % 7 if i % 5 == 0 else ''}" for i, w in enumerate(clean.split()))
    odd = " ".join(f"XQZ{i}$$$" for i in range(150))
    rows = [(i, clean, "en") for i in range(40)] + [(90, odd, "en"), (91, odd, "xx"), (92, odd, None), (93, odd[:300], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.quality for r in quality.quality_rules(df).collect()}
    assert not got[90].kept and not got[90].base_failed and got[90].class_distance > 0.25
    assert got[91].kept and got[92].kept and got[91].class_distance is None
    assert got[93].class_distance is None
    assert got[0].class_distance < 0.25 and got[0].word_distance < 0.29


def test_junk_that_is_a_third_of_the_rows_does_not_become_the_reference(spark, tmp_path):
    r = random.Random(1)
    usual = "the the the of of and to in a is that for it".split() + [f"{a}{b}en" for a in "stmkl" for b in "aeiou"]
    clean = [" ".join(r.choice(usual) + r.choice(["", "", ".", f"{a}"]) for a in "xyzuvw" * 30) for _ in range(40)]
    junk = [" ".join(f"XQ{i}Z{k}$$##" for i in range(400)) for k in range(4)] * 5
    rows = [(i, t, "en") for i, t in enumerate([*clean, *junk])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert not any(r.base_failed for r in quality.quality_rules(df, {}).select("quality.base_failed").collect())
    assert {r.doc_id for r in quality.keep_clean(spark, df, "").collect()} == set(range(len(clean)))
    path = str(tmp_path)
    df.write.parquet(f"{path}/documents.parquet")
    assert {r.doc_id for r in quality.op2_quality_rules(spark, path).filter("kept").collect()} == set(range(len(clean)))


def test_verdicts_by_the_tables_own_references_count_every_row(spark, tmp_path):
    """A text that the fixed references reject is usual in a table of such texts, and a clean one is then odd."""
    r = random.Random(2)
    usual = "the the the of of and to in a is that for it".split() + [f"{a}{b}en" for a in "stmkl" for b in "aeiou"]
    clean = " ".join(r.choice(usual) + r.choice(["", "", "."]) for _ in range(180))
    codes = [" ".join(f"XQ{i}Z{k}$$##" for i in range(400)) for k in range(30)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*codes, clean])], "doc_id long, text string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.kept, r.kept_by_table) for r in quality.op2_quality_rules(spark, str(tmp_path)).collect()}
    assert got == {**{i: (False, True) for i in range(30)}, 30: (True, False)}


def test_quality_of_an_empty_table(empty):
    assert quality.quality_rules(empty).count() == 0


def luhn(s):
    d = [int(c) for c in re.sub("[^0-9]", "", s)]
    odd = [2 * x - 9 if x > 4 else 2 * x for x in d[-2::-2]]
    return 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(odd)) % 10 == 0


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_spans(text):
    return [
        (k, m.start(), m.end())
        for k, p, valid in PLAIN
        for m in re.finditer(p, text or "")
        if valid(m.group())
    ]


TRICKY = [
    "a@b.c+d@e.f a@b.c.@d.e @x.y a@b ..@..", "1.2.3.4.5.6.7.8 01.002.0003.4 1.2.3.999", "4111-1111 1111-1111x4111111111111112",
    "+1 2 3 (4) 5.6-7 8 9+12345678901234567", "é😀 a@b.co 😀 10.0.0.1\n\n4111111111111111\n+49 30 1234567", "1" * 5000, "a" * 5000 + "@",
    "a@b" + ".c" * 5000, "1." * 5000, "12 " * 5000,
]


def test_base_spans_equal_plain_expressions(spark, texts):
    rows = list(enumerate([*texts, *TRICKY]))
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        got = [(pii.KINDS[s.kind].name, s.start, s.end) for s in r.personal if s.kind < len(pii.BASE)]
        assert got == base_spans(r.text)


def test_added_kinds_checksums_context_and_masking(spark):
    text = "iban DE89370400440532013000 bad DE88370400440532013000 ssn 123-45-6789\norder 123-45-6789\ncall 555-123-4567 at a@b.co"
    df = spark.createDataFrame([(1, text, 5), (2, None, None), (3, "", 0)], "doc_id long, text string, n_chars int")
    found = {r.doc_id: r.personal for r in pii.find_personal_data(df).collect()}
    kinds = [(pii.KINDS[s.kind].name, text[s.start : s.end]) for s in found[1]]
    assert kinds == [
        ("email", "a@b.co"),
        ("iban", "DE89370400440532013000"),
        ("ssn", "123-45-6789"),
        ("local_phone", "555-123-4567"),
    ]
    assert found[2] == [] and found[3] == []
    masked = {r.doc_id: r for r in pii.mask_documents(spark, df, "").collect()}
    assert masked[1].text == (
        "iban <IBAN> bad DE88370400440532013000 ssn <SSN>\norder 123-45-6789\ncall <LOCAL_PHONE> at <EMAIL>"
    )
    assert masked[1].n_chars == len(masked[1].text)
    assert masked[2].text is None and masked[3].text == ""
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_license_notices(docs, empty):
    got = {}
    for r in licenses.license_scan(docs).collect():
        got.setdefault(r.id, [x.license for x in r.licenses])
    both = sorted(v for v in got.values() if v)
    assert both == [["Apache-2.0-notice"], ["MIT-notice", "MIT-notice"]]
    assert licenses.license_scan(empty).count() == 0


def test_alignment_is_a_common_subsequence_and_finds_a_changed_notice():
    a = licenses.words_of("so it says: licensed, as it were, under the apache license version 2.0 and so on")
    b = licenses.words_of(licenses.TEMPLATES["Apache-2.0-notice"])
    pairs = licenses.align(a, b)
    assert [a[i] for i, _ in pairs] == b and [j for _, j in pairs] == list(range(len(b)))
    assert licenses.align([], b) == [] and licenses.align(b, b) == [(i, i) for i in range(len(b))]
    assert licenses.increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]
    changed = licenses.TEMPLATES["MIT"].replace("merge, publish,", "join")
    hits = licenses.Scanner(licenses.TEMPLATES).scan("Copyright me. " * 3 + changed)
    assert [h[0] for h in hits] == ["MIT"] and 0.9 < hits[0][1] < 1


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_telling_words_before_a_notice_do_not_hide_it(name):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    notice = licenses.TEMPLATES[name]
    size = len(licenses.words_of(notice))
    marks = {w for w in licenses.words_of(notice) if w in licenses.TELLING}
    strays = ["License: ", "## License\n\n", "Foo is a software package. ", *(f"{w} " for w in sorted(marks))]
    for before in ["", *strays, *(a + b for a in strays for b in strays)]:
        at = len(licenses.words_of(before))
        for after in ("", " and so on with the other words of a text"):
            assert (name, 1.0, at, at + size) in scanner.scan(before + notice + after), before
    assert [h[0] for h in scanner.scan(f"so it is. {notice} {notice} so it was")] == [name, name]


@pytest.mark.parametrize(
    "text, want",
    [
        *((f"Released under the {x} License.", []) for x in ("BSD", "Apache", "ISC", "GPL")),
        *((f"Licensed under CC {x}.", []) for x in ("BY-ND 4.0", "BY-NC-SA 4.0", "BY-NC-ND 4.0", "BY NC 4.0", "BY 3.0")),
        *((f"Licensed under the Apache License, Version {x}.", []) for x in ("1.1", "3.0")),
        *((f"This work is licensed under the GNU General Public License, version {x}.", []) for x in ("2", "2.0")),
        *((f"This work is licensed under the GNU {x} General Public License, version 3.", []) for x in ("Lesser", "Affero")),
        (licenses.TEMPLATES["GPL-3.0"].replace("version 3", "version 2"), []),
        (licenses.TEMPLATES["GPL-3.0"].replace("General", "Lesser General"), []),
        ("This work is licensed under the GNU General Public License, version 3.0.", ["GPL-3.0-notice"]),
        ("This work is licensed under the GNU Free Documentation License, version 3.", []),
        ("This work is licensed under the Mozilla Public License, version 3.", []),
        ("This work is licensed under the GNU Public License, version 3.", ["GPL-3.0-notice"]),
        ("This work is licensed under the General Public License, version 3.", ["GPL-3.0-notice"]),
        ("Released under the MIT.", ["MIT-notice"]),
        ("It is licensed under the GNU General Public License, version 3.", ["GPL-3.0-notice"]),
        ("Licensed under Apache License, Version 2.", ["Apache-2.0-notice"]),
        ("Released under the BSD License. Released under the MIT License.", ["MIT-notice"]),
        ("Licensed under CC BY-ND 4.0. Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0.", ["CC-BY-SA-4.0", "CC-BY-4.0"]),
    ],
)
def test_other_licenses_are_not_reported_as_their_siblings(text, want):
    assert [h[0] for h in licenses.Scanner(licenses.TEMPLATES).scan(text)] == want
    assert [h[0] for h in licenses.Scanner(licenses.TEMPLATES).scan(f"so it is. {text} so it was")] == want


def test_bpe_equals_the_library(docs, texts, empty):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def want(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        return ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    known = dict(enumerate(texts))
    for r in bpe.code_digests(docs).collect():
        if r.id is not None:
            ids, a, b = want(known[r.id])
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), a, b)
    for r in bpe.encode(docs).collect():
        if r.id is not None:
            assert r.ids == want(known[r.id])[0]
    assert bpe.code_digests(empty).count() == 0


def judged(url, rules):
    parts = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = parts[1].translate({i: i + 32 for i in range(65, 91)}) if parts else ""
    path = parts[2] if parts else ""
    fits = [
        (len(h) + len(p), len(h), h + p, a)
        for h, p, a in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits) if fits else (0, 0, None, urls.DEFAULT_VERDICT)
    return host, path, best[2], best[3]


URLS = [
    None, "", "no scheme", "http://net", "http://net/", "HTTP://A.NET/x", "http://example.net/en/a?b#c", "http://www.example.net/en",
    "http://fakeexample.net/en/1", "http://a.example.com/de/x", "http://example.com/deu/", "http://x.org/fr/", "http://x.org/fr",
    "://org/fr/1", "a://b://c/d", "http://x.y.z.w.net/a/b/c/", "http:///en/", "http://org?/fr/", "http://ex.org/deep/er/path", "http://é.net/",
]


@pytest.mark.parametrize("more", [[], [("org", "/deep/er", "block"), ("ex.org", "", "allow"), ("com", "/de", "allow")]])
def test_url_rules(spark, more):
    rules = [*urls.RULES, *more]
    pages = spark.createDataFrame(
        [(i, u, "old", "h") for i, u in enumerate(URLS)] + [(0, URLS[6], "old", "h"), (None, URLS[6], "old", "h")],
        "page_id long, url string, rule string, short string",
    )
    got = urls.url_rules(pages, spark.createDataFrame(rules, urls.RULE_SCHEMA)).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url, rules)
    assert urls.url_rules(pages.limit(0), spark.createDataFrame(rules, urls.RULE_SCHEMA)).count() == 0
    nothing = urls.url_rules(pages, spark.createDataFrame([], urls.RULE_SCHEMA)).collect()
    assert {(r.rule, r.verdict) for r in nothing} == {(None, "allow")}


SHORT = {name: licenses.TEMPLATES[name] for name in ("MIT-notice", "CC-BY-4.0", "all-rights-reserved", "Apache-2.0-notice")}


def every_window(scanner, text):
    """What alignment of every template at every place gives: (the finds that do not overlap, all of them)."""
    told, hits = licenses.words_of(text), set()
    for name, template in scanner.templates.items():
        for i in range(len(told)):
            for j in range(i + 1, min(len(told), i + 3 * len(template)) + 1):
                pairs = licenses.align(told[i:j], template)
                if len(pairs) / len(template) >= scanner.least and scanner.names_it(told[i:j], pairs, name):
                    start, end = i + pairs[0][0], i + pairs[-1][0] + 1
                    hits.add((-len(pairs), -len(pairs) / len(template), end - start, start, end, name))
    taken, out = set(), []
    for _, coverage, _, start, end, name in sorted(hits):
        if taken.isdisjoint(range(start, end)):
            taken |= set(range(start, end))
            out.append((name, -coverage, start, end))
    return sorted(out, key=lambda x: (x[2], x[0])), {(h[5], h[3], h[4]) for h in hits}


def test_license_finds_against_every_window():
    """Every find is an alignment of some window, and few texts of damaged notices are cut into others than by all windows."""
    scanner, r, other = licenses.Scanner(SHORT), random.Random(5), 0
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 4)):
            w = r.choice(list(SHORT.values())).split()
            if r.random() < 0.4:
                del w[r.randrange(len(w))]
            if r.random() < 0.3:
                w.insert(r.randrange(len(w) + 1), r.choice(["foo", "license", "mit", "licensed", "rights"]))
            parts += w + [r.choice("xyz") for _ in range(r.randint(0, 3))]
        want, all_finds = every_window(scanner, " ".join(parts))
        got = scanner.scan(" ".join(parts))
        assert {(n, s, e) for n, _, s, e in got} <= all_finds
        other += got != want
    assert other <= 7


@pytest.mark.parametrize("piece, times, found", [("All rights reserved. ", 24_000, 24_000), ("license ", 65_000, 0)])
def test_half_a_megabyte_of_notices(piece, times, found):
    """The work grows with the text: four times the text, about four times the seconds."""
    scanner, seconds = licenses.Scanner(licenses.TEMPLATES), []
    for n in (times // 4, times):
        start = time.process_time()
        assert len(scanner.scan(piece * n)) == found * n // times
        seconds.append(time.process_time() - start)
    assert seconds[1] < 9 * seconds[0] + 0.5


def test_url_rules_leave_columns_of_any_name_alone(spark):
    """Names the operator uses itself, a URL that most pages share, and pages without one."""
    rows = [(i, "http://a.net/x" if i % 3 else None, "mine", "row", "k") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, __url string, row string, short string")
    rules = spark.createDataFrame(list(urls.RULES), urls.RULE_SCHEMA)
    got = urls.url_rules(pages, rules)
    assert got.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    assert [tuple(r[:5]) for r in got.orderBy("page_id").collect()] == rows
    assert {(r.url, r.rule, r.verdict) for r in got.collect()} == {("http://a.net/x", "net/", "block"), (None, None, "allow")}


def test_spans_of_long_lines_with_many_matches(spark):
    """Counts and places in lines where every other word matches; added kinds beside and inside base ones."""
    mails, ibans = "a@b.c " * 3000, "iban DE89370400440532013000 x 1.2.3.4 " * 700
    inside = "call 555-123-4567 call +1 555-123-4567 mail iban-DE89370400440532013000@x.com iban DE89370400440532013000 "
    rows = [(1, mails), (2, ibans), (3, inside * 300), (4, "1" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(pii.KINDS[s.kind].name, s.start, s.end) for s in r.personal] for r in pii.find_personal_data(df).collect()}
    assert got[1] == [("email", 6 * i, 6 * i + 5) for i in range(3000)]
    each = len("iban DE89370400440532013000 x 1.2.3.4 ")
    assert got[2] == [("ip", each * i + 30, each * i + 37) for i in range(700)] + [
        ("iban", each * i + 5, each * i + 27) for i in range(700)
    ]
    counts = Counter(k for k, *_ in got[3])
    assert counts == {"phone": 300, "email": 300, "local_phone": 300, "iban": 300} and got[4] == []
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(df).collect()}
    assert masked[1] == "<EMAIL> " * 3000 and masked[2] == "iban <IBAN> x <IP> " * 700
    assert masked[3] == "call <LOCAL_PHONE> call <PHONE> mail <EMAIL> iban <IBAN> " * 300 and masked[4] == "1" * 100_000
