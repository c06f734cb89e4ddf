import datetime
from types import SimpleNamespace

import pytest

from foliant import runtime
from foliant.functions import providers
from foliant.operators import library, ranking
from foliant.sources import corpus
from foliant.streaming import feeds


def test_files_are_hashed_and_parsed_without_failing_one_another(spark, tmp_path):
    def two_pages(content):
        if b"bad" in content:
            raise ValueError("damaged")
        return [(1, "first"), (2, content.decode("latin-1")[-4:])]

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 text")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 bad")
    (tmp_path / "c.doc").write_bytes(b"x")
    corpus.register_parser(".pdf", two_pages)
    found = corpus.files(spark, str(tmp_path))
    assert {r["filename"]: r["is_pdf"] for r in found.collect()} == {"a.pdf": True, "b.pdf": True, "c.doc": False}
    pages = {(r["path"].rsplit("/", 1)[1], r["page_number"], r["content"], r["error"]) for r in corpus.file_pages(found).collect()}
    assert pages == {("a.pdf", 1, "first", None), ("a.pdf", 2, "text", None), ("b.pdf", None, None, "damaged"), ("c.doc", None, None, "no parser for this format")}


def test_a_side_is_broadcast_only_if_it_is_small(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan(runtime.small_side(spark.range(5), 1000))
    assert "ResolvedHint" not in plan(runtime.small_side(spark.range(50), 1000))
    wide = spark.createDataFrame([(1, ["x" * 2000], {"a": 1}["a"])], "id int, texts array<string>, n int")
    assert "ResolvedHint" not in plan(runtime.small_side(wide, 1000)) and "ResolvedHint" in plan(runtime.small_side(wide.limit(0), 1000))


def test_no_folder_of_one_machine_on_a_cluster():
    conf, cluster = SimpleNamespace(get=lambda *_: None), SimpleNamespace(master="spark://host:7077")
    with pytest.raises(RuntimeError):
        runtime.checkpoint_folder(SimpleNamespace(conf=conf, sparkContext=cluster))


def test_duplicate_files_point_at_the_first_that_did_not_fail(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [("a", "h", "failed", at), ("b", "h", "ready", at), ("c", "h", "ready", at), ("d", None, "ready", at), ("e", None, "ready", at)]
    df = spark.createDataFrame(rows, "id string, content_hash string, status string, created_at timestamp")
    assert [tuple(r) for r in library.duplicate_files(df).collect()] == [("c", "b")]


def test_recent_turns_bring_what_they_reply_to(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [(f"m{k}", "c", "user", f"t{k}", "m0" if k == 8 else None, at + datetime.timedelta(seconds=k)) for k in range(9)]
    df = spark.createDataFrame(rows, "id string, conversation_id string, role string, content string, reply_to_message_id string, created_at timestamp")
    got = library.with_anchor(library.recent_turns(df), df).collect()
    assert {r["id"]: r["place"] for r in got} == {"m8": 1, "m7": 2, "m6": 3, "m5": 4, "m4": 5, "m3": 6, "m0": 0}


def test_status_tally_counts_unknown(spark):
    df = spark.createDataFrame([("d", "text"), ("d", None), ("d", "odd"), ("e", "ocr")], "document_id string, status string")
    assert {r["document_id"]: tuple(r)[1:] for r in library.status_tally(df).collect()} == {"d": (1, 0, 0, 0, 2), "e": (0, 1, 0, 0, 0)}


def test_providers_embed_in_batches(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None), ("c", "three")], "id string, content string")
    got = {r["vec_id"]: list(r["embedding"]) for r in providers.embedded(df, "id", "content", providers.shape_of).collect()}
    assert got == {"a": [0.0, 1.0, 0.0, 0.5], "c": [5.0, 1.0, 0.0, 0.5]}
    near = ranking.cosine(providers.embedded(df, "id", "content", providers.hashed_words), providers.embedded(df.filter("id = 'a'"), "id", "content", providers.hashed_words), 1)
    assert near.collect()[0]["vec_id"] in ("a", "c")


def test_streams_give_what_the_batch_gives(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    for part in range(3):
        rows = [(k, at + datetime.timedelta(hours=7 * k), k % 3, f"t{k % 4}", float(k), f"h{k % 5}") for k in range(part * 10, part * 10 + 10)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, content_hash string").coalesce(1).write.parquet(f"{tmp_path}/t.parquet", mode="append")
    batch = spark.read.parquet(f"{tmp_path}/t.parquet")
    events = feeds.stream(spark, f"{tmp_path}/t.parquet")
    days = feeds.run(feeds.daily_events(events), "complete")
    assert {(r["day"], r["event_type"]): r["n"] for r in days.collect()} == {(r["d"], r["event_type"]): r["count"] for r in batch.selectExpr("date_trunc('day', ts) as d", "event_type").groupBy("d", "event_type").count().collect()}
    rows = lambda df: df.selectExpr("user_id as session", "event_id as seq", "event_type as item", "value as points")
    last = feeds.run(feeds.session_scores(rows(events)), "update").groupBy("session").agg({"answered": "max"}).collect()
    want = library.running_score(rows(batch)).groupBy("session").agg({"answered": "max"}).collect()
    assert {tuple(r) for r in last} == {tuple(r) for r in want}
    fresh = feeds.run(feeds.new_files(events.withColumnRenamed("ts", "created_at")), "append")
    assert fresh.select("content_hash").distinct().count() == 5 and fresh.count() < 30
