import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions.names import name_of
from parlance.operators import chunks, conflict, enrich, entities, language, love, search
from parlance.sources import fixtures, ingest
from parlance.streaming import messages as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def messages(spark):
    return fixtures.messages_from_events(spark, SF).cache()


def timed(spark, minutes):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, i, f"msg_{i}", "A", start + dt.timedelta(minutes=float(x)), f"text {i}", None, False, "text") for i, x in enumerate(minutes)]
    return spark.createDataFrame(rows, "upload_id long, msg_index int, msg_id string, sender string, timestamp timestamp_ntz, content string, content_english string, is_deleted boolean, msg_type string")


def walked(minutes):
    """Chunks by walking along the messages."""
    out, cur = [], []
    for i, x in enumerate(minutes):
        gap = bool(cur) and x - minutes[cur[-1]] > 30
        if cur and (len(cur) >= 15 or gap):
            out.append(cur)
            cur = [] if gap else cur[-2:]
        cur = [*cur, i]
    return [*out, cur] if cur else out


@pytest.mark.parametrize("minutes", [[0], list(range(15)), list(range(16)), list(range(28)), list(range(29)), list(range(41)), [0, 30, 60.02, 61], [*range(15), 100, 101], []])
def test_chunks_are_those_of_a_walk(spark, minutes):
    got = chunks.chunk_members(timed(spark, minutes)).groupBy("chunk_index").agg(F.sort_array(F.collect_list("msg_index")).alias("m")).orderBy("chunk_index").collect()
    assert [r["m"] for r in got] == walked(minutes)


def test_text_columns(spark):
    row = spark.createDataFrame([("Don't go 😀🇩🇪 www.x.y?  ",), ("",), (None,)], "c string")
    got = row.select(T.tokens(F.col("c")).alias("t"), T.emojis(F.col("c")).alias("e"), T.word_count(F.col("c")).alias("n"), T.is_question(F.col("c")).alias("q"), T.has_link(F.col("c")).alias("l"), T.bigrams(T.tokens(F.col("c"))).alias("b")).collect()
    assert got[0]["t"] == ["don't", "go", "www"] and len(got[0]["e"]) == 3 and got[0]["n"] == 4 and got[0]["q"] and got[0]["l"] and len(got[0]["b"]) == 2
    assert got[1]["t"] == [] and got[1]["n"] == 0 and got[1]["b"] == [] and got[2]["n"] == 0


def test_first_kind_wins(spark):
    got = spark.createDataFrame([("I miss you",), ("see you tonight",), ("nothing",)], "c string").select(love.kind_of(F.col("c"))).collect()
    assert [r[0] for r in got] == ["words_of_affirmation", "quality_time", None]


def test_stand_ins(spark, messages):
    got = messages.select(enrich.sentiment(F.col("content")).alias("s"), enrich.emotion(F.col("content")).alias("e"), enrich.hashed_vector(F.col("content"), 8).alias("v"), "content").collect()
    assert {r["s"]["label"] for r in got} <= {"positive", "negative", "neutral"}
    assert all(abs(sum(x * x for x in r["v"]) - 1) < 1e-5 or not any(r["v"]) for r in got)
    assert enrich.keywords(messages).groupBy("upload_id", "msg_index").count().agg(F.max("count")).first()[0] <= 5
    assert enrich.topic_table(messages).agg(F.sum("size")).first()[0] == messages.where("word_count >= 3").count()
    upper = enrich.model_column(lambda: (lambda texts: [t.upper() for t in texts]), "string")
    assert {r[0] for r in messages.where("content = 'ok'").select(upper(F.col("content"))).collect()} == {"OK"}


def test_cleaning_and_answers(spark):
    row = spark.createDataFrame([("ﬁne brb, see https://x.y 😀", '```json\n{"a": 1}\n```')], "c string, j string")
    got = row.select(enrich.clean_for_models(F.col("c"), {"brb": "be right back"}).alias("c"), enrich.json_of(F.col("j"), "a int").alias("j")).first()
    assert got["c"] == "fine be right back, see __EMOJI__" and got["j"]["a"] == 1


def test_translation_asks_for_each_text_once(spark, messages):
    got = enrich.translated(messages, lambda c: F.upper(c)).where("content <> ''")
    assert got.where("content_english <> upper(content)").isEmpty() and got.count() == messages.where("content <> ''").count()


def test_tables_documents_and_results(spark, messages, tmp_path):
    ingest.write_messages(messages, f"{tmp_path}/m")
    back = spark.read.parquet(f"{tmp_path}/m")
    assert back.where("upload_id = 3").count() == messages.where("upload_id = 3").count()
    assert "PartitionFilters: [isnotnull(upload_id" in back.where("upload_id = 3")._jdf.queryExecution().toString()
    ingest.append_new(messages.limit(10), f"{tmp_path}/c", ["upload_id", "msg_index"])
    ingest.append_new(messages.limit(10), f"{tmp_path}/c", ["upload_id", "msg_index"])
    assert spark.read.parquet(f"{tmp_path}/c").count() == 10
    doc = json.loads(ingest.document(messages.where("upload_id = 1"), 2).first()["document"])
    assert [m["id"] for m in doc["messages"]] == ["msg_0", "msg_1"] and doc["meta"]["total_messages"] == messages.where("upload_id = 1").count()
    assert "messages" not in doc or json.loads(ingest.document(messages.where("upload_id = 1"), -5).first()["document"]).get("messages", []) == []
    r = ingest.Results(spark, f"{tmp_path}/r")
    r.put("x", messages.limit(1), 3600)
    r.put("old", messages.limit(1), -1)
    assert r.get("x").count() == 1 and r.get("old") is None and r.get("none") is None
    assert ingest.together(lambda: 1, lambda: 2) == [1, 2]


def test_streams_agree_with_batches(spark, messages, tmp_path):
    m = messages.withColumn("timestamp", F.col("timestamp").cast("timestamp")).where("upload_id < 3")
    m.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(m.schema).parquet(f"{tmp_path}/in")

    def ran(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert ran(stream.buckets(source), "days", "complete").agg(F.sum("messages")).first()[0] == m.count()
    assert ran(stream.once(source), "once").count() == m.count()
    gaps = ran(stream.response_gaps(source), "gaps")
    from parlance.operators import stats

    assert gaps.count() == stats.gaps(m).count()


def test_empty_messages(spark, messages):
    none = messages.where("false")
    for f in (conflict.resolutions, love.report, chunks.chunks):
        assert f(none).count() == 0


def test_lists_of_stopwords_are_two():
    assert len(T.STOPWORDS) == len(set(T.STOPWORDS)) == 133 and len(T.CONTENT_STOPWORDS) == len(set(T.CONTENT_STOPWORDS)) == 332
    assert {"really", "kinda", "like"} == set(T.STOPWORDS) - set(T.CONTENT_STOPWORDS) and {"sorry", "dont", "tomorrow", "about"} <= set(T.CONTENT_STOPWORDS) - set(T.STOPWORDS)
    assert len(enrich.ABBREVIATIONS) == 134


def test_names_of_emoji():
    assert name_of("😂") == "FACE WITH TEARS OF JOY" and name_of("👨\u200d👩") == "MAN" and name_of("") is None and name_of(None) is None and name_of("\ue000") is None


def test_cleaning_expands_single_words(spark):
    rows = spark.createDataFrame([("LOL! see u tmrw (brb) at www.x.y/z 😂😂 ok.com  fine",), ("ｇｒ８ fr fr",), ("",), (None,)], "c string")
    assert [r[0] for r in rows.select(enrich.clean_for_models(F.col("c"))).collect()] == ["laughing! see you tomorrow be right back) at __EMOJI__ __EMOJI__ fine", "great for real for real", "", None]
    assert rows.select(enrich.clean_for_models(F.col("c"), {})).collect()[2][0] == ""


def test_entities_of_a_model_and_of_patterns(spark):
    rows = [(1, 0, "Dinner with Ann in Rome tomorrow", False), (1, 1, "ROME is far, ask ann about the birthday Party", False), (1, 2, "in Paris", True)]
    m = spark.createDataFrame(rows, "upload_id long, msg_index int, content string, is_deleted boolean")
    got = {(r["family"], r["key"]): r["mentions"] for r in entities.aggregate(m).collect()}
    assert got["persons", "ann"] == 1 and got["places", "rome"] == 1 and got["dates", "tomorrow"] == 1 and ("places", "paris") not in got and any(k[0] == "events" for k in got)
    model = lambda c: F.struct(F.array(F.lit("Bo ")).alias("persons"), F.array().cast("array<string>").alias("places"), F.array().cast("array<string>").alias("dates"), F.array(F.lit("Gala")).alias("events"))
    got = {(r["family"], r["display"]): r["mentions"] for r in entities.aggregate(m, model).collect()}
    assert got["persons", "Bo"] == 2 and got["events", "Gala"] == 2


def test_stages_fill_what_is_missing(spark, messages):
    m = messages.withColumn("sentiment_label", F.when(F.col("msg_index") % 2 == 0, F.col("sentiment_label")))
    heard = []
    rows, found = enrich.process(m, progress=lambda stage, share: heard.append(stage))
    before, after = ({(r["upload_id"], r["msg_index"]): r["sentiment_label"] for r in x.select("upload_id", "msg_index", "sentiment_label").collect()} for x in (m, rows))
    assert set(before) == set(after) and all(after[k] == v for k, v in before.items() if v) and sum(map(bool, after.values())) > sum(map(bool, before.values()))
    assert heard == ["nlp_start", "preprocess", "per_message", "conversation_topics", "entities"]
    one = json.loads(found.first()["ai_analysis"])
    assert {"topic_clusters", "topic_assignments", "entities"} == set(one) and {"topic_id", "label", "keywords", "size"} == set(one["topic_clusters"][0]) and "dates" in one["entities"]


def test_english_conversations_are_stamped_and_others_translated(spark):
    rows = [(u, i, t, None, None) for u, texts in ((1, ["this is plain english text"] * 30), (2, ["this is plain english text", "kya hai yaar nahi pata"] * 15)) for i, t in enumerate(texts)]
    m = spark.createDataFrame(rows, "upload_id long, msg_index int, content string, content_english string, original_language string")
    got = language.normalised(m, lambda c: F.upper(F.concat(c, F.lit("!")))).collect()
    assert all(not r["was_translated"] and r["original_language"] == "english" for r in got if r["upload_id"] == 1)
    assert sum(r["was_translated"] for r in got) == 15 and all(r["content_english"] == "KYA HAI YAAR NAHI PATA!" for r in got if r["was_translated"])


def test_histories_hold_each_query_once(spark):
    rows = [("a", "Trips", 1), ("a", " trips", 5), ("a", "food", 3), ("b", "food", 2), ("a", "late", 0)]
    got = search.history(spark.createDataFrame(rows, "user string, query string, at int"), 2).collect()
    assert sorted((r["user"], r["rank"], r["query"]) for r in got) == [("a", 1, " trips"), ("a", 2, "food"), ("b", 1, "food")]


def test_progress_of_streams_is_heard(spark, tmp_path):
    heard = []
    listener = stream.report(spark, lambda name, batch, rate: heard.append(name))
    try:
        q = spark.readStream.format("rate").option("rowsPerSecond", 50).load().writeStream.format("noop").queryName("heard").option("checkpointLocation", str(tmp_path)).trigger(processingTime="200 milliseconds").start()
        for _ in range(100):
            if heard:
                break
            q.awaitTermination(0.3)
        q.stop()
    finally:
        spark.streams.removeListener(listener)
    assert "heard" in heard


def test_sessions_and_stages_over_streams(spark, messages, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = messages.select("upload_id", "msg_id", "msg_index", "sender", F.col("timestamp").cast("timestamp").alias("timestamp"), "content")
    rows.write.parquet(source)
    live = spark.readStream.schema(rows.schema).parquet(source)
    q = stream.sessions(live, late="0 seconds").writeStream.format("memory").queryName("sessions_seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    n = spark.table("sessions_seen").agg(F.sum("messages")).first()[0]
    assert 0 < n <= rows.count()  # the last session of each conversation stays open
    for _ in range(2):
        stream.stage(live, lambda b: b.withColumn("n", F.length("content")), out, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(out).count() == rows.count()
