import math
import random

from pyspark.sql import functions as F

from foliant.operators import calculation, chunking, grounding, library, ranking, selection
from foliant.plans import catalogue, modes, routing

CHUNK = "id string, document_id string, page_number int, content string, section string, start_offset int, end_offset int"


def test_spans_end_at_sentences_and_cover_the_text():
    text = "A" * 320 + ". " + "B" * 700
    assert list(chunking.spans_of(text))[0] == (0, 321)
    assert list(chunking.spans_of("")) == []
    words = "word " * 400
    spans = list(chunking.spans_of(words, 200, 50))
    assert spans[0][0] == 0 and spans[-1][1] == len(words)
    assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))


def test_page_chunks_take_the_last_heading_and_the_boxes(spark):
    block = lambda a, b, x, h, s="text": (a, b, [x, x, x + 1.0, x + 2.0], s, h, 10.0, None)
    text = "Intro.\nHeading\nBody of it"
    rows = [("d-1", "d", 1, text, [block(0, 6, 1.0, False), block(7, 14, 2.0, True), block(15, 25, 3.0, False, "ocr")], 1), ("d-2", "d", 2, None, None, 2), ("d-3", "d", 3, "", [], 3)]
    schema = "id string, document_id string, page_number int, content string, blocks array<struct<start_offset int, end_offset int, bbox array<double>, source_type string, is_heading boolean, font_size double, confidence double>>, extra int"
    got = chunking.page_chunks(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and got[0]["section"] == "Heading" and got[0]["bbox"] == [1.0, 1.0, 4.0, 5.0] and got[0]["source_type"] == "ocr"


def test_bm25_puts_the_phrase_first(spark):
    rows = [("a-1-0", "a", 1, "Protocol for the quick MQTT broker"), ("a-1-1", "a", 1, "The MQTT protocol in use"), ("a-2-0", "a", 2, "Nothing of it"), ("b-1-0", "b", 1, None)]
    chunks = spark.createDataFrame(rows, "id string, document_id string, page_number int, content string")
    questions = spark.createDataFrame([(1, "mqtt protocol"), (2, "the"), (3, None)], "question_id long, question string")
    got = ranking.bm25(chunks, questions).orderBy("question_id", "rank").collect()
    assert [(r["question_id"], r["chunk_id"]) for r in got] == [(1, "a-1-1"), (1, "a-1-0")]


def test_a_scope_narrows_hits_but_not_statistics(spark):
    rows = [("a-1-0", "a", "MQTT broker one"), ("a-1-1", "a", "the MQTT broker of MQTT"), ("b-1-0", "b", "MQTT broker two"), ("c-1-0", None, "MQTT broker")]
    chunks = spark.createDataFrame(rows, "id string, document_id string, content string")
    asked = spark.createDataFrame([(1, "mqtt", ["b"]), (2, "mqtt", None), (3, "mqtt", []), (4, "mqtt", ["a", "x"]), (5, "mqtt", ["x"])], "question_id long, question string, scope array<string>")
    for rank in (ranking.bm25, ranking.lexical):
        got = rank(chunks, asked, 2).collect()
        found = {q: {r["chunk_id"] for r in got if r["question_id"] == q} for q in range(1, 6)}
        assert found[1] == {"b-1-0"} and found[2] == found[3] and len(found[2]) == 2 and found[4] == {"a-1-0", "a-1-1"} and not found[5]
    scores = {(r["question_id"], r["chunk_id"]): r["score"] for r in ranking.bm25(chunks, asked, 4).collect()}
    assert scores[1, "b-1-0"] == scores[2, "b-1-0"]


def test_scoped_questions_meet_their_own_documents_alone(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"term{k}" for k in range(12)]
    rows = [(f"c{k:03}", rng.choice("abcde"), " ".join(rng.choice(words) for _ in range(15))) for k in range(80)]
    chunks = spark.createDataFrame(rows, "id string, document_id string, content string")
    asked = [(k, " ".join(rng.choice(words) for _ in range(3)), rng.sample("abcde", k % 4)) for k in range(30)]
    questions = spark.createDataFrame(asked, "question_id long, question string, scope array<string>")
    of, scope = {r[0]: r[1] for r in rows}, {q: s for q, _, s in asked}
    monkeypatch.setattr(ranking, "PRODUCTS", 50)
    for rank, sign in ((ranking.bm25, 1), (ranking.lexical, -1)):
        free = rank(chunks, questions.drop("scope"), 100).collect()
        want = set()
        for q in scope:
            inside = [(r["score"], r["chunk_id"]) for r in free if r["question_id"] == q and (not scope[q] or of[r["chunk_id"]] in scope[q])]
            inside.sort(key=lambda x: (-x[0], sign * int(x[1][1:])))
            want |= {(q, c, s, k + 1) for k, (s, c) in enumerate(inside[:4])}
        scoped = rank(chunks, questions, 4)
        assert {tuple(r) for r in scoped.select("question_id", "chunk_id", "score", "rank").collect()} == want
        # no chunk is compared with questions of other documents
        assert "FlatMapCoGroupsInArrow" in scoped._jdf.queryExecution().toString()


def test_ties_follow_the_contracts(spark):
    chunks = spark.createDataFrame([("a", "x", "one pump"), ("b", "x", "one pump")], "id string, document_id string, content string")
    asked = spark.createDataFrame([(1, "pump")], "question_id long, question string")
    assert [r["chunk_id"] for r in ranking.lexical(chunks, asked).orderBy("rank").collect()] == ["b", "a"]
    assert [r["chunk_id"] for r in ranking.bm25(chunks, asked).orderBy("rank").collect()] == ["a", "b"]


def test_many_questions_go_in_passes_and_groups(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"term{k}" for k in range(30)]
    chunks = spark.createDataFrame([(f"c{k:03}", " ".join(rng.choice(words) for _ in range(15))) for k in range(60)] + [("empty", ""), ("null", None)], "id string, content string")
    asked = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(4))) for k in range(40)], "question_id long, question string")
    taken = lambda: [sorted(map(tuple, rank(chunks, asked, 3).collect())) for rank in (ranking.bm25, ranking.lexical)]
    whole = taken()
    monkeypatch.setattr(ranking, "BLOCK", 12)
    monkeypatch.setattr(ranking, "GROUP", 5)
    monkeypatch.setattr(ranking, "ROWS", 7)
    assert taken() == whole
    assert ranking.bm25(chunks.limit(0), asked).count() == 0 and ranking.lexical(chunks, asked.limit(0)).count() == 0


def brute_lexical(question, content):
    stop = set("a an and are about the of for in is it to was what which with this that".split())
    import re

    split = lambda t: [w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 2 and w not in stop]
    q, c = split(question), split(content)
    score = sum(min(c.count(t), 2) for t in q)
    return score + sum(2 * n for n in (2, 3) for i in range(len(q) - n + 1) if " ".join(q[i : i + n]) in content.lower())


def test_lexical_equals_the_plain_rule(spark):
    rng = random.Random(3)
    vocabulary = "sensor sensors broker table data flow control the of unit".split()
    rows = [(f"c{k}", " ".join(rng.choice(vocabulary) for _ in range(12))) for k in range(40)]
    questions = [(k, " ".join(rng.choice(vocabulary) for _ in range(5))) for k in range(8)]
    got = {(r["question_id"], r["chunk_id"]): r["score"] for r in ranking.lexical(spark.createDataFrame(rows, "id string, content string"), spark.createDataFrame(questions, "question_id long, question string"), 100).collect()}
    want = {(q, c): float(s) for q, question in questions for c, content in rows if (s := brute_lexical(question, content))}
    assert got == want


def test_cosine_is_exact_with_ties_by_id(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ranking.cosine(df, df.filter("vec_id = 1"), 2).orderBy("rank").collect()
    assert [(r["vec_id"], r["similarity"]) for r in got] == [(1, 1.0), (2, 1.0)]


def test_fusion_keeps_the_union(spark):
    lists = [spark.createDataFrame([(1, c, k + 1) for k, c in enumerate(x)], "question_id long, chunk_id string, rank int") for x in ("abc", "acd")]
    got = {r["chunk_id"]: r["score"] for r in ranking.fused(*lists).collect()}
    assert set(got) == set("abcd") and max(got, key=got.get) == "a" and math.isclose(got["b"], 1 / 62, abs_tol=1e-9)


def greedy(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        share = lambda k: max(0, min(k[5], r[5]) - max(k[4], r[4])) / min(k[5] - k[4], r[5] - r[4])
        if not any(k[2:4] == r[2:4] and share(k) >= 0.6 for k in kept):
            kept.append(r)
    return {r[1] for r in kept}


def test_overlaps_drop_greedily(spark):
    rng = random.Random(1)
    rows = [(1, f"c{k:03}", rng.choice("ab"), rng.randrange(3), a := rng.randrange(500), a + rng.randrange(50, 300), rng.random(), "t") for k in range(120)]
    df = spark.createDataFrame(rows, "question_id long, chunk_id string, document_id string, page_number int, start_offset int, end_offset int, score double, content string")
    assert {r["chunk_id"] for r in selection.without_overlaps(df).collect()} == greedy(rows)


def test_diversity_goes_round_the_pages(spark):
    rows = [(1, f"p1-{k}", "d", 1, 1.0 - k / 10) for k in range(5)] + [(1, "p2", "d", 2, 0.2), (1, "p3", "d", 3, 0.1)]
    df = spark.createDataFrame(rows, "question_id long, chunk_id string, document_id string, page_number int, score double")
    assert [r["page_number"] for r in selection.diverse(df, 3).orderBy("position").collect()] == [1, 2, 3]
    assert [r["chunk_id"] for r in selection.diverse(df.limit(2), 5).orderBy("position").collect()] == ["p1-0", "p1-1"]


def test_overview_and_even_spacing(spark):
    df = spark.createDataFrame([(f"d-{p}-{k}", "d", p) for p in range(1, 10) for k in range(3)], "chunk_id string, document_id string, page_number int")
    assert {r["page_number"] for r in selection.overview(df, 9).collect()} == set(range(1, 10))
    spaced = selection.evenly_spaced(df, 4, "document_id", "page_number", ["chunk_id"]).collect()
    assert len(spaced) == 4 and len({r["page_number"] for r in spaced}) == 4


def test_page_lookup_adds_neighbours_of_a_single_chunk(spark):
    chunks = spark.createDataFrame([("d-1-0", "d", 1), ("d-2-0", "d", 2), ("d-3-0", "d", 3), ("d-3-1", "d", 3)], "id string, document_id string, page_number int")
    asked = spark.createDataFrame([("x", "d", 2), ("y", "d", 3), ("z", "d", 9)], "asked_id string, document_id string, page_number int")
    got = sorted((r["asked_id"], r["chunk_id"], r["score"]) for r in library.page_lookup(chunks, asked).collect())
    assert got == [("x", "d-1-0", 0.5), ("x", "d-2-0", 1.0), ("x", "d-3-0", 0.5), ("x", "d-3-1", 0.5), ("y", "d-3-0", 1.0), ("y", "d-3-1", 1.0)]


def test_routing_rules_in_order(spark):
    asked = {
        1: "What is on page 12 of the report?",
        2: "Where does the document discuss ZigBee?",
        3: "List the range for each protocol",
        4: "What is the percentage increase in revenue?",
        5: "difference between ZigBee and Bluetooth",
        6: "What does the Sensors section say?",
        7: "Give me a brief overview",
        8: "Who wrote it?",
        9: "Where is MQTT explained in this document?",
        10: "Compare them in a table",
    }
    df = spark.createDataFrame(list(asked.items()), "question_id long, question string")
    sections = spark.createDataFrame([("Sensors",), ("Sen",), (None,)], "section string")
    got = {r["question_id"]: r for r in routing.route(df, sections).collect()}
    assert [got[k]["mode"] for k in sorted(got)] == ["page", "location", "extraction", "calculation", "fact", "section", "overview", "fact", "location", "fact"]
    assert got[1]["page"] == 12 and got[2]["topic"] == "ZigBee" and got[6]["section"] == "Sensors" and got[9]["topic"] == "MQTT" and got[10]["format"] == "table"


def test_amounts_leave_years_and_places_out(spark):
    text = "In 2022 revenue was $80,000 and 12.5% more than 40 kg, chapter 3, Q1, 55kgs"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(calculation.amounts(F.col("t"))).alias("a")).select("a.*").collect()
    assert [(r["value"], r["unit"]) for r in got if not r["is_year"] and not r["is_place"]] == [(80000.0, "usd"), (12.5, "%"), (40.0, "kg"), (55.0, None)]
    assert [text[r["at"]] for r in got] == ["2", "$", "1", "4", "3", "5"]


def test_labelled_amounts_and_results(spark):
    df = spark.createDataFrame([(1, ["revenue", "cost"], "c", "Revenue was 80000. Cost was 50000 days."), (2, ["x"], "c", None), (3, [], "c", "x 1")], "question_id long, labels array<string>, chunk_id string, content string")
    assert sorted((r["label"], r["value"], r["unit"]) for r in calculation.labelled_amounts(df).collect()) == [("cost", 50000.0, "days"), ("revenue", 80000.0, None)]
    ops = spark.createDataFrame([("percentage_increase", 80.0, 95.0), ("ratio", 1.0, 0.0), ("difference", 5.0, 3.0)], "o string, a double, b double")
    assert [r["x"] for r in ops.select(calculation.computed(F.col("o"), F.col("a"), F.col("b")).alias("x")).collect()] == [18.75, None, 2.0]


def test_calculations_to_the_end(spark):
    asked = {
        1: "difference between 80000 and 50000",
        2: "average of 10, 20 and 30",
        3: "What is the percentage increase in revenue from 2022 to 2023?",
        4: "difference between revenue and cost",
        5: "ratio of 10 kg to 5 m, between 10 kg and 5 m",
        6: "ratio of rain and sun",
        7: "total weight",
        8: "ratio between 4 and 0",
        9: "What is the total length?",
    }
    passages = [
        (3, "a", 1, "Revenue was 100 usd in 2022. It rose to 120 usd by 2023, revenue of 125 usd planned."),
        (4, "a", 1, "Revenue was 80000 then 90000."), (4, "b", 2, "The cost was 50000."),
        (7, "a", 1, "Weights of 1 kg, 2 kg, 3 kg, 4 kg, 5 kg, 6 kg, 7 kg, 8 kg, 9 kg, 10 kg, 11 kg, each a weight: 1 weight 2, weight 3 kg. weight 4 5 6 7 8 9 10 11 12 13 14"),
        (9, "a", 1, "The length is 2 m. A length of 3 m."),
    ]
    got = {r["question_id"]: r for r in calculation.results(spark.createDataFrame(list(asked.items()), "question_id long, question string"), spark.createDataFrame(passages, "question_id long, chunk_id string, position int, content string")).collect()}
    assert {k: (r["status"], r["result"]) for k, r in got.items()} == {
        1: ("ok", 30000.0), 2: ("ok", 20.0), 3: ("ok", 4.166667), 4: ("ok", 30000.0), 5: ("units", None), 6: ("missing", None), 7: ("too_many", None), 8: ("undefined", None), 9: ("ok", 5.0),
    }


def test_support_of_values(spark):
    rows = [("Speed is 1,250 kbps", "up to 1250 kbps"), ("1250", "1251"), ("yes", "whatever"), ("wireless sensor network", "a network of wireless sensors"), ("wireless sensor network", "cables")]
    df = spark.createDataFrame(rows, "v string, p string")
    assert [r["x"] for r in df.select(grounding.supported(F.col("v"), F.col("p")).alias("x")).collect()] == [True, False, True, True, False]


def test_places_of_excerpts():
    text = "The quick brown fox jumps over the lazy dog near the river."
    assert grounding.place("brown fox", text) == ("exact", 10, 19)
    assert grounding.place("the quick brown fox jumps over the lazy cat", text)[0] == "approximate"
    assert grounding.place("BROWN \n fox", text) == ("exact", 10, 19)
    assert grounding.place("something else entirely here", text)[0] == "none" and grounding.place(None, text)[0] == "none"


def test_citations_are_exact_approximate_or_unavailable(spark):
    block = lambda a, b, x: (a, b, [x, x, x + 1.0, x + 1.0], "text", False, 10.0, None)
    text = "First line of the page.\nSecond line of it, which is longer."
    pages = spark.createDataFrame([("d", 1, text, [block(0, 23, 1.0), block(24, len(text), 5.0)])], "document_id string, page_number int, content string, blocks array<struct<start_offset int, end_offset int, bbox array<double>, source_type string, is_heading boolean, font_size double, confidence double>>")
    cited = [("a", "d", 1, "x", [9.0, 9.0, 9.5, 9.5]), ("b", "d", 1, "second LINE of it", None), ("c", "d", 1, "nothing like this here at all", []), ("e", "d", 7, "First line", None)]
    got = {r["i"]: (r["box_source"], r["box"]) for r in grounding.cited_boxes(spark.createDataFrame(cited, "i string, document_id string, page_number int, content string, bbox array<double>"), pages).collect()}
    assert got == {"a": ("exact", [9.0, 9.0, 9.5, 9.5]), "b": ("approximate", [5.0, 5.0, 6.0, 6.0]), "c": ("unavailable", None), "e": ("unavailable", None)}


def test_contents_collapse_running_headings(spark):
    block = lambda a, b, size, h=True: (a, b, [0.0] * 4, "text", h, size, None)
    rows = [("d-1", "d", 1, "Big\nSmall", [block(0, 3, 20.0), block(4, 9, 12.0)]), ("d-2", "d", 2, "Small\niv", [block(0, 5, 12.0), block(6, 8, 12.0)])]
    df = spark.createDataFrame(rows, "id string, document_id string, page_number int, content string, blocks array<struct<start_offset int, end_offset int, bbox array<double>, source_type string, is_heading boolean, font_size double, confidence double>>")
    assert [(r["title"], r["page_number"], r["level"]) for r in library.contents(df).orderBy("position").collect()] == [("Big", 1, 1), ("Small", 1, 2)]


def test_decorative_images_are_on_most_pages(spark):
    rows = [("d", 7, p) for p in (1, 2, 3, 3)] + [("d", 8, 1), ("d", 8, 2), ("d", None, 1), ("e", 7, 1), ("e", 7, 2), ("f", 7, 1)]
    images = spark.createDataFrame(rows, "document_id string, xref int, page_number int")
    documents = spark.createDataFrame([("d", 4), ("e", 3), ("f", None)], "id string, page_count int")
    assert [tuple(r) for r in library.decorative(images, documents).collect()] == [("d", 7, 3)]


def test_running_score_counts_items_once(spark):
    rows = [("s", 1, "a", 1.0), ("s", 2, "b", 0.0), ("s", 3, "a", 1.0), ("s", 4, "c", 0.5)]
    got = library.running_score(spark.createDataFrame(rows, "session string, seq long, item string, points double")).orderBy("seq").collect()
    assert [(r["answered"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0), (3, 1.5)]


def test_location_finds_only_what_is_said(spark):
    rows = [("r-1-0", "r", 1, "ZigBee is a wireless protocol.", None, 0, 30), ("r-2-0", "r", 2, "Temperature sensors report.", None, 0, 27), ("m-1-0", "m", 1, "Market prices rose.", None, 0, 19)]
    chunks = spark.createDataFrame(rows, CHUNK)
    questions = spark.createDataFrame([(1, "ZigBee"), (2, "temperature sensors"), (3, "quantum sensors")], "question_id long, question string")
    got = sorted((r["question_id"], r["chunk_id"]) for r in modes.location(chunks, questions).collect())
    assert got == [(1, "r-1-0"), (2, "r-2-0")]


def test_each_question_is_answered_in_its_mode(spark):
    rows = [(f"{d}-{p}-{k}", d, p, f"ZigBee sensors of {d} page {p} part {k} report a rate of {p}{k} kbps.", "Sensors" if p == 2 else None, 100 * k, 100 * k + 60) for d in "ab" for p in (1, 2, 3) for k in range(1 if p == 3 else 2)]
    chunks = spark.createDataFrame(rows, CHUNK)
    asked = {
        1: ("Who sells ZigBee sensors?", ["a"]), 2: ("Who sells ZigBee sensors?", ["a", "b"]), 3: ("What is on page 3?", ["b"]), 4: ("What is on page 9?", None),
        5: ("Where is ZigBee explained?", None), 6: ("What does the Sensors section say?", ["a"]), 7: ("Give me a brief overview", None), 8: ("Give me a brief overview", ["b"]),
        9: ("What does the appendix section say about ZigBee?", ["b"]), 10: ("What is on page 2?", ["a"]),
    }
    df = spark.createDataFrame([(k, *v) for k, v in asked.items()], "question_id long, question string, scope array<string>")
    got = {}
    for r in modes.answers(chunks, df).orderBy("question_id", "position").collect():
        got.setdefault((r["question_id"], r["mode"]), []).append(r["chunk_id"])
    assert {x[0] for x in got[1, "fact"]} == {"a"} and {x[0] for x in got[2, "multi_document"]} == {"a", "b"}
    assert got[3, "page"] == ["b-3-0", "b-2-0", "b-2-1"] and not any(k == 4 for k, _ in got) and got[10, "page"] == ["a-2-0", "a-2-1"]
    assert {x[0] for x in got[5, "location"]} == {"a", "b"} and got[6, "section"] == ["a-2-0", "a-2-1"]
    assert len(got[7, "overview"]) == 10 and got[8, "overview"] == ["b-1-0", "b-2-0", "b-3-0", "b-1-1", "b-2-1"]
    assert {x[0] for x in got[9, "section"]} == {"b"}


def test_questions_about_one_document_do_not_share_turns(spark):
    rows = [(f"{d}-{p}-{k}", d, p, f"ZigBee sensors page {p} part {k}", f"Of {d} pages", 100 * k, 100 * k + 60) for d in "ab" for p in (1, 2, 3) for k in range(3)]
    chunks = spark.createDataFrame(rows, CHUNK)
    asked = [(k, "Give me a brief overview", ["a"]) for k in range(6)] + [(k, "What is on page 2?", ["b", "b"] if k % 2 else None) for k in range(6, 10)] + [(k, "What does the pages section say?", ["b"] if k % 2 else []) for k in range(10, 14)]
    got = {}
    df = spark.createDataFrame(asked, "question_id long, question string, scope array<string>")
    found = modes.answers(chunks, df)
    for r in found.orderBy("question_id", "position").collect():
        got.setdefault(r["question_id"], []).append(r["chunk_id"])
    turns = [f"a-{p}-{k}" for k in range(3) for p in (1, 2, 3)]
    assert all(got[k] == turns for k in range(6))
    assert got[6] == got[8] == ["a-2-0", "b-2-0", "a-2-1", "b-2-1", "a-2-2", "b-2-2"]
    assert got[10] == got[12] == [f"a-{p}-{k}" for p in (1, 2, 3) for k in range(3)][:8] and got[11] == got[13] == [f"b-{p}-{k}" for p in (1, 2, 3) for k in range(3)][:8]


def test_headings_are_sought_by_rare_words_and_only_where_a_section_may_be_meant(spark):
    headings = ["The pump", "The pump of the plant", "The pump of the plants in use", "The valve of the plant", "Of", "(§) Pump of the", "He pump of the plant now"]
    known = spark.createDataFrame([(h,) for h in headings] + [(f"The part {k} of the plant",) for k in range(200)], "section string")
    asked = {1: "What does the section The pump of the planting say?", 2: "the PUMP section", 3: "the pump of the plant", 4: "What is in section the part 7 of the plant?", 5: "chapter bathe pump of the plant now", 6: None}
    df = spark.createDataFrame(list(asked.items()), "question_id long, question string")

    import re

    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    every = [r["section"] for r in known.collect()]
    want = {}
    for k, q in asked.items():
        if q and (held := [h for h in every if h.lower() in q.lower() and split(h)[0] in split(q)]):
            want[k] = min(held, key=lambda h: (-len(h), h))
    found = routing.named_sections(df, known)
    assert {r["question_id"]: r["heading"] for r in found.collect()} == want
    got = {r["question_id"]: r["section"] for r in routing.route(df, known).collect()}
    assert got[1] == "The pump of the plant" and got[3] is None and got[4] == "The part 7 of the plant"
    # headings of four words do not meet questions by a first word that many share
    assert "slice(words" in found._jdf.queryExecution().toString()


def test_passages_of_calculations_are_ranked_once(spark):
    plan = catalogue.calc_results(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "FlatMapCoGroups" not in plan
