"""Problems 4 to 7: pairs, near-duplicates, windows, leaks."""

import datetime
import itertools
import random

import pandas as pd
import pytest

from foliant.llm import answer_defects, leakage, near_duplicates, packing
from foliant.llm.words import words

# --- answers -----------------------------------------------------------------------------------------------------

Q = "Which sensors are listed for Tamor in section 4?"
GOOD = "According to Tamor, the sensor reached 40 km. The valve of the camera follows it in the second quarter."


def conversation(spark, turns):
    start = datetime.datetime(2026, 1, 1)
    rows = [(f"m{k:03}", f"c{k // 2}" if c is None else c, role, text, start + datetime.timedelta(minutes=at), "x") for k, (c, role, text, at) in enumerate(turns)]
    return spark.createDataFrame(rows, "id string, conversation_id string, role string, content string, created_at timestamp, question string")


ANSWERS = [
    (GOOD, None), ("40 km", None), ("| a | b |\n| --- | --- |\n| x | 1 km |", None), ("**40 km**", None), ("Tamor (2003)", None),
    ("The files do not say when it closed, but they cover the rest. " + GOOD, None), ("Question: " + Q + "\n" + GOOD, None),
    (None, "empty"), ("  \n", "empty"), ("Answer:", "empty"), ("[1]", "empty"), ('{"answer": "", "source_ids": []}', "empty"), ("- \n- \n", "empty"), ("N/A", "empty"),
    (Q, "copy"), (Q.upper(), "copy"), ("You asked: " + Q, "copy"), (Q + "\n" + Q, "copy"),
    ("I'm sorry, but I can't help with this request.", "refusal"), ("Leider liegt mir dazu keine Antwort vor. Bitte wähle eine andere Datei.", "refusal"), ("No estoy en condiciones de responder.", "refusal"),
    ("According to Tamor, the sensor reached 40 km. The valve of the", "truncated"), ('{"answer": "According to', "truncated"), ("Main points:\n- Local valve\n-", "truncated"), ("| a | b |\n| --- | --- |\n| x |", "truncated"),
    ("Laut Tamor erreichte der neue Sensor einen Wert von 40 km und die Anlage ist nicht mit dem Ventil verbunden.", "language"),
]


def test_each_defect_and_its_neighbours(spark):
    turns = list(itertools.chain.from_iterable([(None, " User", Q, 0), (None, "ASSISTANT ", a, 1)] for a, _ in ANSWERS))
    turns += [("last", "user", Q, 0)] + [("last", "assistant", GOOD, k + 1) for k in range(20)]
    df = conversation(spark, turns)
    got = {r["message_id"]: r["defect"] for r in answer_defects.defects(df.unionAll(df.limit(7))).collect()}
    assert {ANSWERS[k][0]: got.get(f"m{2 * k + 1:03}") for k in range(len(ANSWERS))} == dict(ANSWERS)


def test_pairs_take_the_latest_earlier_question(spark):
    turns = [("c", "user", "first", 0), ("c", "user", "second", 200), ("c", "assistant", "a", 5), ("c", "assistant", "b", 200), ("c", "assistant", "d", 900), ("e", "assistant", "greeting", 0), ("e", "system", "s", 0), (None, "assistant", "x", 1)]
    got = {r["answer"]: r["question"] for r in answer_defects.pairs(conversation(spark, turns)).collect()}
    assert got == {"a": "first", "b": "first", "d": "second"}
    assert answer_defects.defects(conversation(spark, turns).limit(0)).count() == 0


def test_a_language_that_was_asked_for_is_right():
    german = "Laut Tamor erreichte der Sensor einen Wert und die Anlage ist nicht verbunden."
    assert answer_defects.other_language(Q + " What is the value?", german)
    assert not answer_defects.other_language("Answer in German, please. What is the value for the sensor?", german)


# --- near-duplicates ---------------------------------------------------------------------------------------------


def brute_pairs(rows, threshold=0.6):
    kept = [(i, t) for i, t in set(rows) if i is not None and t is not None and len(words(t)) >= near_duplicates.MIN_WORDS]
    return {(min(a, b), max(a, b)) for (a, s), (b, t) in itertools.combinations(kept, 2) if a != b and near_duplicates.jaccard(s, t) >= threshold}


def editions(seed=1, n=30):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(15, 120))]
        for c in range(rng.randrange(1, 4)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((f"d{k}-{c}", " ".join(copy)))
    return rows + rows[:4] + [("copy-1", rows[0][1]), ("copy-2", rows[0][1]), ("null", None), (None, rows[1][1]), ("empty", "")]


def test_pairs_equal_those_of_all_comparisons(spark):
    rows = editions()
    df = spark.createDataFrame([(*r, 7) for r in rows], "id string, content string, key int")
    got = {(r["id_a"], r["id_b"]) for r in near_duplicates.near_duplicates(df).collect()}
    want = brute_pairs(rows)
    assert got <= want and len(got) >= 0.99 * len(want) and ("copy-1", "copy-2") in got
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0


def test_groups_are_connected_components(spark):
    rows = editions(3)
    df = spark.createDataFrame(rows, "id string, content string")
    groups = {r["id"]: r["group_id"] for r in near_duplicates.groups(df).collect()}
    assert all(groups[a] == groups[b] for a, b in brute_pairs(rows) if a in groups and b in groups)


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["component"]) for r in near_duplicates.components(links).collect()} == {(k, 1) for k in range(1, 41)} | {(100, 100), (101, 100)}


def test_a_hot_shard_is_divided_without_loss(spark):
    rng = random.Random(4)
    rows = [(1, k.to_bytes(16), rng.getrandbits(62)) for k in range(200)] + [(2, (1000).to_bytes(16), 5), (2, (1001).to_bytes(16), 4)]
    df = spark.createDataFrame(rows, "shard long, key binary, fingerprint long")
    hot = spark.createDataFrame([(1, 3)], "shard long, parts int")
    most = 26
    got = {(bytes(r["a"]), bytes(r["b"])) for r in near_duplicates.tree_pairs(near_duplicates.divided(df, hot), most).collect()}
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and (a[2] ^ b[2]).bit_count() <= most}
    assert got == want


def test_shards_divided_by_further_values_lose_nothing(spark, monkeypatch):
    rows = editions(5)
    df = spark.createDataFrame(rows, "id string, content string")
    taken = lambda: {(r["id_a"], r["id_b"]) for r in near_duplicates.near_duplicates(df).collect()}
    whole = taken()
    monkeypatch.setattr(near_duplicates, "HOT_ROWS", 0)
    monkeypatch.setattr(near_duplicates, "SAMPLE", 1)
    assert len(whole & taken()) >= 0.99 * len(whole)
    monkeypatch.setattr(near_duplicates, "HOT_SHARDS", 0)
    monkeypatch.setattr(near_duplicates, "TREE_ROWS", 2)
    assert taken() == whole


def test_pairs_do_not_depend_on_the_size_of_a_shard(spark, monkeypatch):
    rows = []
    for seed in (0, 1319, 5094, 5765, 6439, 6617, 8795, 9030, 9456, 9756, 11341):  # pairs of similarity 0.6
        r = random.Random(seed)
        base = [f"w{r.randrange(10**6)}" for _ in range(102)]
        rows += [(f"{seed}-a", " ".join(base[:82])), (f"{seed}-b", " ".join(base[20:]))]
    df = spark.createDataFrame(rows, "id string, content string")
    taken = lambda: {(r["id_a"], r["id_b"]) for r in near_duplicates.near_duplicates(df).collect()}
    assert taken() == brute_pairs(rows)
    monkeypatch.setattr(near_duplicates, "HOT_ROWS", 0)
    monkeypatch.setattr(near_duplicates, "SAMPLE", 1)
    assert taken() == brute_pairs(rows)


def test_bk_tree_equals_a_scan():
    rng = random.Random(0)
    prints = [rng.getrandbits(64) for _ in range(300)]
    tree = near_duplicates.BKTree()
    for k, p in enumerate(prints + prints[:3]):
        tree.add(p, k)
    for q in prints[:20]:
        assert set(tree.within(q, 24)) == {k for k, p in enumerate(prints + prints[:3]) if (p ^ q).bit_count() <= 24}


# --- windows -----------------------------------------------------------------------------------------------------


def plain_first_fit(sizes, capacity):
    room, at = [], []
    for size in sizes:
        k = next((k for k, r in enumerate(room) if r >= size), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= size
        at.append(k)
    return at


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_equals_the_plain_scan(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.choice([0, 1, 5, rng.randrange(1, 100)]) for _ in range(rng.randrange(1, 120))), reverse=True)
    assert packing.first_fit_decreasing(sizes, 100) == plain_first_fit(sizes, 100)
    assert packing.first_fit_decreasing([], 100) == []


def test_windows_hold_every_token_once(spark):
    pytest.importorskip("tiktoken")
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["sensor", "valve", "größe", "x1"]) for _ in range(rng.randrange(0, 60))), 1) for k in range(60)] + [(100, "word " * 500, 1), (101, None, 1), (102, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    windows = spark.createDataFrame([(1, 64), (2, 0), (3, None)], "window_id int, capacity_tokens int")
    got = packing.packed(df, windows, group=20).collect()
    totals, bins = {}, {}
    for r in got:
        totals[r["doc_id"]] = totals.get(r["doc_id"], 0) + r["n_tokens"]
        bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["n_tokens"]
    encode = packing.encoding(packing.TOKENIZER).encode_ordinary
    assert totals == {k: len(encode(t)) if t else 0 for k, t, _ in rows}
    assert max(bins.values()) <= 64 and {r["window_id"] for r in got} == {1}
    assert packing.packed(df.limit(0), windows).count() == 0
    kept = packing.fill(packing.packed(df, windows, group=20), windows).first()
    assert kept["texts"] == 63 and kept["gaps"] == 0 and not kept["overfull"] and kept["bins"] <= 1.05 * kept["least_bins"] + 4


def test_nearly_no_room_is_wasted(spark):
    pytest.importorskip("tiktoken")
    rng = random.Random(2)
    df = spark.createDataFrame([(k, "valve " * int(rng.lognormvariate(4, 1.2))) for k in range(4000)], "doc_id long, text string")
    windows = spark.createDataFrame([(1, 512), (2, 2048)], "window_id int, capacity_tokens int")
    assert all(r["waste"] < 0.01 for r in packing.fill(packing.packed(df, windows), windows).collect())


def test_documents_of_all_sizes_meet_their_items():
    rng = random.Random(8)
    items = [(k, [f"w{rng.randrange(400)}" for _ in range(40)]) for k in range(30)]
    index = leakage.Items(items)
    for n in (1, 3, 30):  # one passage alone, several items, all of them and much else
        text = " ".join(" ".join([f"x{rng.random()}", *w[5:17]]) for _, w in items[:n]) + " plain" * 10 * n
        assert {i for _, i in index.search([text, None, "plain"])} == set(range(n))


# --- leaks -------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items):
    found = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            x = words(item)
            n = min(12, len(x))
            if n and any(w[k : k + n] == x[j : j + n] for j in range(len(x) - n + 1) for k in range(len(w) - n + 1)):
                found.add((d, i))
    return found


def test_leaks_equal_those_of_all_comparisons(spark):
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([3, 4, 5, 8, 9, 11, 12, 13, 20, 40, 60, 60])] + [(50, ""), (51, None)]
    docs = []
    for d in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))]
        source = words(rng.choice(items[:12])[1])
        a = rng.randrange(len(source))
        take = source[a : a + rng.choice([5, 11, 12, 13, 60])]
        at = rng.randrange(len(text) + 1)
        docs.append((d, ", ".join(text[:at] + take + text[at:])))
    docs += [(900, None), (901, ""), (902, items[6][1].upper() + "!"), (902, items[6][1].upper() + "!"), (903, " ".join(x for _, x in items if x) * 40)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item int")
    held = spark.createDataFrame([(*i, "p") for i in items + items[:2]], "item_id int, text string, prompt string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked(df, held).collect()}
    assert got == brute_leaks([(d, t or "") for d, t in docs], [(i, t or "") for i, t in items])
    assert leakage.leaked(df.limit(0), held).count() == 0 and leakage.leaked(df, held.limit(0)).count() == 0


def test_compression_decides_what_is_a_copy():
    question = "Which pump feeds the old boiler in hall seven near the gate of the northern works?"
    assert answer_defects.copies(question, "You asked: " + question) and answer_defects.copies(question, question.upper())
    assert not answer_defects.copies(question, "Gate, near seven: the works of the northern hall feeds old pump, boiler which the in.")  # the same words
    assert not answer_defects.copies(question, question + " Pump B17, which was fitted in 1998 and runs on two motors of 40 kW each, feeds it.")


def test_no_refusal_is_missed_by_the_first_look():
    texts = ["I cannot [3] answer this.", "Leider kann ich das nicht sagen.", "Je ne trouve rien.", "No puedo responder.", "Sorry, no.", "The pump runs.", None]
    looked = answer_defects.may_refuse(pd.Series(texts))
    assert all(x for x, t in zip(looked, texts, strict=True) if t and answer_defects.refuses(t)) and not looked[-2] and not looked[-1]
