import json

from conftest import DATA
from pyspark.sql import functions as F

from quarrylane.operators import adapters
from quarrylane.streaming import events


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_answers_of_broken_json():
    assert adapters.answers('```json\n[{"id": 0}, {"id": 1,}]\n```') == [{"id": 0}, {"id": 1}]
    assert adapters.answers('noise {"id": 0} {"id": ') == [{"id": 0}]
    assert adapters.answers(None) == [] and adapters.answers("{") == []


def splitter():
    """A service that splits at underscores and fails where a text is 'bad'."""

    def split(texts):
        if any("bad" in t for t in texts):
            raise ValueError("service")
        return json.dumps([{"id": i, "tokens": t.split("_"), "confidence": 0.9 if len(t) < 9 else 0.4} for i, t in enumerate(texts)])

    return split


def test_morphemes_survive_failures(spark):
    df = spark.createDataFrame([("1", "a_b"), ("2", "bad"), ("3", "_".join("abcdefghijklmnop")), ("4", None), ("5", "a_b")], "id string, text string")
    got = {r["id"]: (list(r["tokens"]), r["confidence"], r["note"]) for r in adapters.morphemes(df, splitter()).collect()}
    assert got["1"] == got["5"] == (["a", "b"], 0.9, None) and got["2"] == ([], 0.0, "no answer") and len(got["3"][0]) == 12 and got["3"][2] == "low confidence" and got["4"][2] == "no answer"
    assert adapters.morphemes(df.limit(0), splitter()).count() == 0 and adapters.batch_size(["x" * 60] * 5) == 20


def test_comments_are_never_overwritten(spark):
    c = spark.createDataFrame([("t", "a", "own"), ("t", "b", ""), ("t", "c", None)], "table_name string, column_name string, comment string")
    p = spark.createDataFrame([("t", "a", "x"), ("t", "b", "y")], "table_name string, column_name string, proposal string")
    assert [r["comment"] for r in adapters.filled_comments(c, p).orderBy("column_name").collect()] == ["own", "y (추천)", None]


def test_proposed_words_go_through_the_dictionary(spark):
    w = spark.createDataFrame([("1", ["고객", "번호"], 0.9), ("2", ["고객", "new"], 0.9)], "id string, words array<string>, confidence double")
    k = spark.createDataFrame([("고객", "CUST"), ("번호", "NO")], "match_key string, physical string")
    assert rows(adapters.resolved_answers(w, k)) == [("1", "CUST_NO", 0.9), ("2", "CUST_NEW", 0.5)]


def test_only_new_items_are_asked(spark):
    old = spark.createDataFrame([("a",)], "text string").select(F.sha2("text", 256).alias("hash"))
    items = spark.createDataFrame([("a",), ("b",)], "text string")
    assert [r["text"] for r in adapters.kept_answers(old, items, F.sha2("text", 256)).collect()] == ["b"]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    q = events.windowed(events.event_stream(spark, DATA)).writeStream.outputMode("complete").format("memory").queryName("windowed_events").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("windowed_events")) == rows(events.windowed(batch))
    assert events.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()
