"""Problems 1, 2, 3 and 8: clean-up of pages and documents."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant.llm import lookalikes, scan_noise, site_lines, spam_pages

BLOCKS = "array<struct<start_offset int, end_offset int, bbox array<double>, source_type string, is_heading boolean, font_size double, confidence double>>"
PAGES = f"id string, document_id string, page_number int, content string, blocks {BLOCKS}, source_type string, line_no int, defect string"


def blocks(text, confidence=0.9, heading=()):
    return [(0, len(x), [0.0] * 4, "ocr", k in heading, 10.0, confidence) for k, x in enumerate(text.split("\n"))]


# --- look-alikes -------------------------------------------------------------------------------------------------


def test_every_look_alike_becomes_the_frequent_form():
    nfd = unicodedata.normalize("NFD", "é")
    text = "ｃａｆé " + nfd + " " + chr(0x430) + "bc" + chr(0x200B) + "d" + chr(0xA0) + "e" + chr(0xFB01) + "x " + chr(0x1D41A)
    table = lookalikes.representatives({**lookalikes.count_units([text] + ["plain abcdefix é fi"] * 50)})
    assert lookalikes.Rewriter(table)(text) == "café é abcd efix a"


@pytest.mark.parametrize("text", ["σήμα", "датчик", "Δt of α", "m² CO₂", "“quoted” – dash…", "", "plain"])
def test_proper_other_text_stays(text):
    table = lookalikes.representatives(dict(lookalikes.count_units([text, "ordinary words"])))
    assert lookalikes.Rewriter(table)(text) == text


def test_classes_are_transitive_and_the_invisible_vanish():
    wide_and_mark = "ｕ" + chr(0x308)
    table = lookalikes.representatives({wide_and_mark: 1, "ü": 9, "ｕ": 1, "u": 9, chr(0x200D): 5})
    assert table[wide_and_mark] == "ü" and table["ｕ"] == "u" and table[chr(0x200D)] == ""


def unified(texts, corpus):
    rewrite = lookalikes.Rewriter(lookalikes.representatives(dict(lookalikes.count_units(corpus + texts))))
    return [rewrite(t) for t in texts]


RUSSIAN, GREEK, TURKISH, ENGLISH = "Датчик стоит у реки, а насос работает хорошо", "Ο αισθητήρας και η αντλία λειτουργούν πολύ καλά", "Ilık ırmak kıyısında bir sensör ve ısı kaynağı", "The sensor and the pump stand at the river"


@pytest.mark.parametrize("corpus", [RUSSIAN, GREEK, TURKISH, ENGLISH])
def test_no_letter_of_a_words_own_script_is_changed(corpus):
    texts = ["data is here", RUSSIAN, GREEK, TURKISH, "ｄａｔａ", "Δt 5 Å"]
    assert unified(texts, [corpus] * 200) == ["data is here", RUSSIAN, GREEK, TURKISH, "data", "Δt 5 Å"]


@pytest.mark.parametrize("corpus", [RUSSIAN, GREEK, ENGLISH])
def test_words_of_two_scripts_come_to_one(corpus):
    given = ["s" + chr(0x435) + "ns" + chr(0x43E) + "r", "д" + "a" + "тчик", "αντλί" + "α" + "v", chr(0x212A) + "elvin"]
    want = ["sensor", "датчик", "αντλί" + "αν", "Kelvin"]
    assert unified(given, [corpus] * 50 + [RUSSIAN, GREEK, ENGLISH, "Kelvin Kelvin"]) == want


def test_unify_handles_nulls_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a" + chr(0x200B) + "b", "x"), (3, "a" + chr(0x200B) + "b", "x")]
    df = spark.createDataFrame(rows, "id int, text string, unit string")
    got = sorted((r["id"], r["unified"]) for r in lookalikes.unify(df, "text").collect() if r["unified"] is not None)
    assert got == [(2, ""), (3, "ab"), (3, "ab")]
    assert lookalikes.unify(df.limit(0), "text").count() == 0


# --- site lines --------------------------------------------------------------------------------------------------


def brute_site_lines(pages, documents):
    source = {d[0]: d[1] for d in documents if d[1] is not None}
    of, lines = {}, {}
    for page, doc, content in pages:
        if doc in source and content and content.strip():
            of.setdefault(source[doc], set()).add(doc)
            for k, line in enumerate(content.split("\n")):
                form = site_lines.same_form(line)
                if len(form) >= 20:
                    lines.setdefault((source[doc], form), []).append((page, k, doc))
    return {(p, k) for (s, _), at in lines.items() for p, k, _ in at if len(docs := {d for *_, d in at}) >= 3 and len(docs) >= 0.15 * len(of[s])}


def test_site_lines_equal_the_plain_count(spark):
    rng = random.Random(2)
    fixed = ["Share this note with your  group", "SHARE this note with your group", "© Publishing. All rights reserved", "short line"]
    pages, documents = [], []
    for d in range(40):
        documents += [(f"d{d}", rng.choice(["a", "b", None]))] * rng.choice([1, 2])
        for p in range(3):
            lines = [f"Unique text {rng.random()} of page {p} in {d}" for _ in range(3)] + [rng.choice(fixed) for _ in range(2)]
            pages.append((f"d{d}-{p}", f"d{d}", "\n".join(rng.sample(lines, 5)) if rng.random() > 0.1 else rng.choice([None, "", "  "])))
    pages += pages[:5] + [("x-1", "unknown", fixed[0])]
    df = spark.createDataFrame([(*p, "s", 1) for p in pages], "id string, document_id string, content string, source string, leaf int")
    docs = spark.createDataFrame(documents, "id string, source string")
    found = site_lines.site_lines(df, docs)
    assert {(r["page_id"], r["line_no"]) for r in found.collect()} == brute_site_lines(pages, documents)
    one = next(p for p in pages if p[2] and "Publishing" in p[2])
    cleaned = {r["id"]: r["content"] for r in site_lines.cleaned(df, found).collect()}
    assert "Publishing" not in cleaned[one[0]] and "Unique text" in cleaned[one[0]]
    assert site_lines.site_lines(df.limit(0), docs).count() == 0


def test_a_hot_leaf_is_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(site_lines, "HOT", 2)
    test_site_lines_equal_the_plain_count(spark)


# --- scanned pages -----------------------------------------------------------------------------------------------


def scanned_library(spark):
    digital = "The proposed sensor describes a wireless classifier. When the long-term camera fails, the second quarter follows."
    rows = [(f"n-{k}", f"n{k}", 1, digital, None, "text", 1, "x") for k in range(30)]
    top, end = "Sealed sensors and wireless camera", "- {} -"
    for k in (1, 2, 3):
        text = "\n".join([top, "The propcsed sensor des-", "cribes a wire~less classifier. When the long-", "term camera fails, the se(ond quarter follows.", end.format(k)])
        rows += [(f"s-{k}", "s", k, text, blocks(text, 0.7), "ocr", 1, "x")] * k
    rows += [("s-8", "s", 8, None, None, "ocr", 1, "x"), ("s-9", "s", 9, "  ", [], "ocr", 1, "x"), ("t-1", None, None, "word", None, "ocr", 1, "x"), ("z", "z", 1, None, None, None, 1, "x")]
    return spark.createDataFrame(rows, PAGES)


def test_defects_of_scanned_lines(spark):
    got = {(r["page_id"], r["line_no"], r["defect"]) for r in scan_noise.defects(scanned_library(spark)).collect()}
    want = {(f"s-{k}", *x) for k in (1, 2, 3) for x in ((0, "header"), (1, "hyphen"), (1, "char"), (2, "char"), (3, "char"), (4, "number"))}
    assert got == want


def test_without_vectors_no_word_is_linked(spark, monkeypatch):
    taken = lambda: {(r["page_id"], r["line_no"]) for r in scan_noise.defects(scanned_library(spark)).filter("defect = 'char'").collect()}
    assert taken()
    monkeypatch.setattr(scan_noise, "vectors", lambda *_: {})
    assert not taken()


def test_a_rare_word_in_other_company_is_left(spark):
    rng = random.Random(3)
    towns, parts, does = "Tamor Selin Vorag Belun".split(), "valve reef coil lathe piston".split(), "turns drives cools heats".split()
    travel = lambda: f"we went from {rng.choice(towns)} to {rng.choice(towns)} by night train and slept"
    works = lambda w=None: f"each {rng.choice(parts)} {rng.choice(does)} one {w or rng.choice([*parts, 'castor'])} while oil runs"
    rows = [(f"n-{k}", f"n{k}", 1, " ".join((travel, works)[k % 2]() for _ in range(16)), None, "text", 1, "x") for k in range(200)]
    around = lambda say, x: " ".join([say(), say(), x, say(), say()])
    texts = {"o-1": around(works, works("castcr")), "o-2": around(travel, "we went from Castcr to Selin by night train and slept")}
    rows += [(i, "o", 1, t, blocks(t, 0.7), "ocr", 1, "x") for i, t in texts.items()]
    rows += [(f"q-{k}", f"q{k}", 1, t := around((travel, works)[k % 2], (travel, works)[k % 2]()), blocks(t, 0.95), "ocr", 1, "x") for k in range(40)]
    assert {r["page_id"] for r in scan_noise.defects(spark.createDataFrame(rows, PAGES)).filter("defect = 'char'").collect()} == {"o-1"}


def test_each_different_token_is_looked_at_once(monkeypatch):
    asked, form = [], scan_noise.form
    monkeypatch.setattr(scan_noise, "form", lambda token: asked.append(token) or form(token))
    reader = scan_noise.Reader({"sensor": 3})
    broken, odd = reader.read(scan_noise.tokens_of_lines("sensor 12 sensor\ngone\n" + "sensor 12 " * 50 + "sens0r", {1}))
    assert not broken and [x[:3] for x in odd] == [(2, 100, "sens0r")] and asked.count("sensor") == 1 and asked.count("12") == 1


def test_scans_alone_are_repaired(spark):
    text = "The sensor describes a wireless camera. When the camera fails, the second sensor follows it at once."
    worse = text.replace("wireless", "wire~less").replace("second", "sec0nd")
    rows = [(f"s-{k}", f"s{k}", 1, t := worse if k == 7 else text, blocks(t, 0.7), "ocr", 1, "x") for k in range(40)]
    assert [tuple(r) for r in scan_noise.defects(spark.createDataFrame(rows, PAGES)).collect()] == [("s-7", 0, "char")]


def test_repaired_pages_are_paragraphs(spark):
    got = {r["page_id"]: r["text"] for r in scan_noise.repaired(scanned_library(spark)).collect()}
    assert got["s-2"] == "The proposed sensor describes a wireless classifier. When the long-term camera fails, the second quarter follows."
    assert set(got) == {"s-1", "s-2", "s-3", "t-1"}


def test_no_scanned_pages_give_no_defects(spark):
    assert scan_noise.defects(scanned_library(spark).filter("source_type = 'text'")).count() == 0
    assert scan_noise.defects(scanned_library(spark).limit(0)).count() == 0


@pytest.mark.parametrize("lexicon", [1, 8])
def test_words_beyond_the_lexicon_are_known(spark, monkeypatch, lexicon):
    text = "The camena describes a self-\ntest of the sensor and a long-\nlived wireless classi-\nfier follows."
    rows = [("n-x", "nx", 1, "Of self-test and camena. A well-known self-employed long-term sensor", None, "text", 1, "x"), ("u-1", "u", 1, text, blocks(text, 0.7), "ocr", 1, "x")]
    pages = scanned_library(spark).unionAll(spark.createDataFrame(rows, PAGES))
    taken = lambda df: sorted(map(tuple, df.collect()))
    found, whole = taken(scan_noise.defects(pages)), taken(scan_noise.repaired(pages))
    assert not any(page == "u-1" and line == 0 for page, line, _ in found)
    monkeypatch.setattr(scan_noise, "LEXICON", lexicon)
    assert taken(scan_noise.defects(pages)) == found and taken(scan_noise.repaired(pages)) == whole


def test_misread_copies_of_all_repeated_headers_are_found(spark):
    chapters = "Sealed sensors of wireless cameras|Broken valves and their causes|Coastal reefs under observation|Classifiers for market reports|Lathes with numerical control|Turbines in mountain rivers".split("|")
    body = "describes the wireless classifier and the long-term camera of the sensor in the second quarter.\nIt follows the sensor, and the camera fails."
    texts = [f"{top}\n{body}" for k, top in enumerate(chapters) for _ in range(8 - k)] + [f"Turbinas im mountain rivets\n{body}"]
    rows = [(f"b-{k}", "b", k, text, blocks(text, 0.95), "ocr", 1, "x") for k, text in enumerate(texts)]
    got = {(r["page_id"], r["line_no"]) for r in scan_noise.defects(scanned_library(spark).unionAll(spark.createDataFrame(rows, PAGES))).collect() if r["defect"] == "header" and r["page_id"].startswith("b-")}
    assert got == {(r[0], 0) for r in rows}


def test_misread_copies_have_a_piece_of_their_header():
    rng = random.Random(4)
    for _ in range(4000):
        header = copy = "".join(rng.choice("abc") for _ in range(rng.randrange(6, 60)))
        for _ in range(rng.randrange(scan_noise.most_edits(len(header)) + 1)):
            at = rng.randrange(len(copy))
            copy = copy[:at] + rng.choice(["", "x", "x" + copy[at]]) + copy[at + 1 :]
        assert scan_noise.copy_pieces(copy, [len(header)]) & set(scan_noise.header_pieces(header))


def test_edit_costs_follow_glyphs():
    assert scan_noise.edit_cost("tra*cks", "tracks") == 1 and scan_noise.edit_cost("lirnits", "limits") == 1
    assert scan_noise.edit_cost("propcsed", "proposed") == 2 and scan_noise.edit_cost("same", "same") == 0
    assert scan_noise.edit_cost("abcdefgh", "zyxwvuts") > 4


@pytest.mark.parametrize("line,is_number", [("- 3 -", True), ("Page 2 of 9", True), ("~ l0 ~", True), ("iv", True), ("[12]", True), ("Seite 4", True), ("mild", False), ("2019 was", False)])
def test_page_numbers(line, is_number):
    assert bool(scan_noise.NUMBER.match(line)) == is_number


# --- spam --------------------------------------------------------------------------------------------------------


def documents(spark):
    rng = random.Random(5)
    nouns, names = "sensor camera table broker valve reef coil lathe".split(), "Tamor Selin Vorag Belun".split()
    say = lambda: f"When the {rng.choice(nouns)} fails, the {rng.choice(nouns)} of {rng.choice(names)} follows the {rng.choice(nouns)} in the second quarter."
    rows = [(k, " ".join(say() for _ in range(12)), rng.choice(["en", None, "de"]), "x") for k in range(200)]
    keywords = ". ".join(f"{rng.choice(['buy', 'cheap', 'best'])} valve {rng.choice(['online', 'pdf', 'review'])}" for _ in range(80))
    links = "\n".join(f"[Local {rng.choice(nouns)}](https://a{k}.example/{rng.choice(nouns)}-and-{rng.choice(nouns)})" for k in range(60))
    paths = "\n".join(" » ".join(f"Local {rng.choice(nouns)}" for _ in range(4)) for _ in range(40))
    table = "\n".join(f"{rng.choice(names)};{rng.randrange(999)} kg;{rng.randrange(99)} mm" for _ in range(40))
    prose_with_links = " ".join(say() + f" See https://b.example/{rng.choice(nouns)} ." for _ in range(12))
    rows += [(1000, keywords, "en", "x"), (1001, links, None, "x"), (1002, paths, "zz", "x"), (1003, table, "en", "x"), (1004, prose_with_links, "en", "x"), (1005, say(), "en", "x"), (1006, None, None, "x"), (1007, "", "en", "x"), (1000, keywords, "en", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, chars string")


def test_spam_is_found_and_tables_are_not(spark):
    shares = {r["doc_id"]: r["spam_share"] for r in spam_pages.spam_share(documents(spark)).collect()}
    assert {k for k, v in shares.items() if v > spam_pages.SHARE} == {1000, 1001, 1002}
    assert 1006 not in shares and 1007 not in shares


def test_the_distance_decides(spark):
    rng = random.Random(9)
    usual = dict(zip(spam_pages.FEATURES, (0.4, 0.2, 0.9, 0.1, 0.1, 0.1, 0.1, 0.05, 0.1), strict=True))
    rows = [(0, "en", 100, *(rng.gauss(m, 0.05) for m in usual.values())) for _ in range(2000)]
    for i, more in ((1, -0.15), (2, -0.6)):  # as few function words as now and then among the others, and far fewer
        rows.append((i, "en", 100, *(m + more * (f == "function") for f, m in usual.items())))
    df = spark.createDataFrame(rows, "id long, lang string, chars long, " + ", ".join(f"{f} double" for f in spam_pages.FEATURES))
    towards = {r["id"]: r["towards"] for r in spam_pages.scored(df).filter("id > 0").collect()}
    assert 1 < towards[1] < spam_pages.CUTOFF < towards[2]


def test_spam_of_nothing(spark):
    assert spam_pages.spam_share(documents(spark).limit(0)).count() == 0
    assert spam_pages.spam_share(documents(spark).filter(F.col("doc_id") == 1000)).count() == 1


def test_many_spam_texts_of_no_known_language_are_found(spark):
    rng = random.Random(6)
    path = lambda: " » ".join(f"Local {rng.choice('sensor camera table broker valve reef coil lathe'.split())}" for _ in range(4))
    rows = [(2000 + k, "\n".join(path() for _ in range(40)), None, "x") for k in range(30)]
    assert sum(len(list(spam_pages.windows(t, lang))) for _, t, lang, _ in rows) >= 300
    shares = {r["doc_id"]: r["spam_share"] for r in spam_pages.spam_share(documents(spark).unionAll(spark.createDataFrame(rows, "doc_id long, text string, lang string, chars string"))).collect()}
    assert {k for k, v in shares.items() if v > spam_pages.SHARE} == {1000, 1001, 1002, *(r[0] for r in rows)}


def test_function_words_of_no_known_language_are_those_of_all():
    (window,) = spam_pages.windows("valve of reef und coil lathe", "zz")
    assert window[0] == "und" and window[2] == 2 / 6


def test_medians_are_exact(spark):
    rows = spark.range(30001).selectExpr("cast(round(pow(id / 30000, 3), 4) as double) as x")
    assert rows.agg(spam_pages.middle(F.col("x"))).first()[0] == 0.125
