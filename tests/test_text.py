import re

from pyspark.sql import functions as F

from foliant.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


#: Words and their stems, worked out by hand from the rule: the first ending that leaves three letters goes, -ies becomes y.
STEMS = {
    "sensors": "sensor", "computing": "comput", "computers": "comput", "batteries": "battery", "ties": "tie", "uses": "use", "bus": "bus", "2022": "2022",
    "daisies": "daisy", "supplies": "supply", "applied": "appli", "slowly": "slow", "ions": "ion", "stations": "stat", "es": "es", "ring": "ring",
    "bring": "bring", "boxes": "box", "the": "the", "ly": "ly", "1990s": "1990",
}


def test_collapsed_takes_all_blanks(spark):
    assert one(spark, T.collapsed, " a  b\n\tc ") == "a b c"
    assert one(spark, T.collapsed, None) is None


def test_terms_keep_order_and_repeats(spark):
    assert one(spark, T.terms, "The MQTT broker, über the broker 12 abc") == ["mqtt", "broker", "ber", "broker", "abc"]
    assert one(spark, T.significant_terms, "how does MQTT mqtt work") == ["mqtt", "work"]


def test_stems_of_known_words(spark):
    assert one(spark, lambda c: T.stemmed(F.lower(c)), " ".join(STEMS)).split() == list(STEMS.values())


def test_covers_needs_three_fifths(spark):
    rows = [("mqtt wireless sensors", "a sensor and MQTT"), ("mqtt wireless sensors", "sensor"), ("", "x"), ("the of", "x")]
    df = spark.createDataFrame(rows, "t string, p string").withColumn("s", T.stems(F.col("p")))
    assert [r["x"] for r in df.select(T.covers(T.terms(F.col("t")), F.col("s")).alias("x")).collect()] == [True, False, True, True]


def test_index_tokens_fold_accents(spark):
    assert one(spark, T.index_tokens, "Über die Größe, CO₂ 1.5") == ["uber", "die", "große", "co₂", "1", "5"]


def test_numbers_lose_separators(spark):
    assert one(spark, T.numbers_in, "From 1,250.5 to 12. and 1,250.5") == ["1250.5", "12"]
    assert re.fullmatch(r"\d+", "12")
