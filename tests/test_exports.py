import json

import pytest

from parlance.sources import exports as X

WHATSAPP = "orphan\n[12/01/2024, 18:42:01] Alice: hi\nsecond line\n\n[13/01/2024, 09:00:00] Bob: ‎image omitted\n[14/01/2024, 09:00:00] Bob: This message was deleted\n[15/01/2024, 09:05:00] Alice: I left home\n[45/45/2024, 09:05:00] Alice: bad date\n"
DASHED = "12/31/2024, 6:42 PM - Bob: hey\n1/2/2025, 12:05 AM - Alice: yo: there\n1/3/2025, 7:00 AM - Alice added Bob\n"
TELEGRAM = {"name": "x", "type": "personal_chat", "messages": [
    {"id": 5, "type": "message", "date": "2024-01-12T18:42:01", "date_unixtime": "1705084921", "from": "Eve", "from_id": "u1", "text": ["hi ", {"type": "bold", "text": "you"}], "text_entities": []},
    {"id": 6, "type": "message", "from": "Eve", "text": "no date"},
    {"id": 7, "type": "message", "date": "2024-01-12T18:43:00", "from": "Ann", "text": "", "media_type": "voice_message", "reply_to_message_id": 5},
    {"id": 8, "type": "service", "date": "2024-01-12T18:44:00", "actor": "Ann", "action": "pin_message", "text": ""},
]}
META = {"participants": [{"name": "A"}], "thread_path": "inbox/x", "messages": [
    {"sender_name": "JosÃ©", "timestamp_ms": 1700000060000, "content": "cafÃ©", "share": {"link": "https://x.example"}},
    {"sender_name": "A", "timestamp_ms": 1700000000000, "photos": [{"uri": "p"}]},
]}


def files(spark, *pairs):
    return spark.createDataFrame(list(pairs), "file string, text string")


def rows(df):
    return [r.asDict() for r in df.orderBy("file", "msg_index").collect()]


def test_headers_continuations_and_kinds(spark):
    got = rows(X.whatsapp(files(spark, ("a.txt", WHATSAPP))))
    assert [(r["sender"], r["content"], r["msg_type"]) for r in got] == [("Alice", "hi\nsecond line", "text"), ("Bob", "image omitted", "image"), ("Bob", "", "deleted"), ("Alice", "I left home", "system")]
    assert str(got[0]["timestamp"]) == "2024-01-12 18:42:01" and got[0]["msg_id"] == "msg_0"


def test_months_first_once_a_line_says_so(spark):
    got = rows(X.whatsapp(files(spark, ("b.txt", DASHED))))
    assert [str(r["timestamp"]) for r in got] == ["2024-12-31 18:42:00", "2025-01-02 00:05:00", "2025-01-03 07:00:00"]
    assert got[1]["content"] == "yo: there" and got[2]["msg_type"] == "system" and got[2]["sender"] == "system"


def test_telegram(spark):
    got = rows(X.telegram(files(spark, ("t.json", json.dumps(TELEGRAM)))))
    assert [(r["msg_id"], r["content"], r["msg_type"], r["reply_to_id"]) for r in got] == [("msg_0", "hi you", "text", None), ("msg_2", "", "audio", "msg_0"), ("msg_3", "pin_message", "system", None)]


def test_instagram_is_reversed_and_repaired(spark):
    got = rows(X.instagram(files(spark, ("i.json", json.dumps(META)))))
    assert [(r["msg_id"], r["sender"], r["content"], r["msg_type"]) for r in got] == [("msg_0", "A", "", "image"), ("msg_1", "José", "café https://x.example", "text")]


def test_facebook_events_and_unsent(spark):
    doc = {"messages": [{"sender_name": "A", "timestamp_ms": 2000, "type": "Call"}, {"sender_name": "B", "timestamp_ms": 1000, "content": "x", "is_unsent": True}]}
    got = rows(X.facebook(files(spark, ("f.json", json.dumps(doc)))))
    assert [(r["content"], r["msg_type"]) for r in got] == [("", "deleted"), ("[Call]", "system")]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimited_sorts_and_numbers(spark, sep):
    text = f"time{sep}author{sep}body\n2024-01-02 10:00{sep}A{sep}two\n1704067200{sep}B{sep}one\nragged\nnever{sep}A{sep}x\n"
    got = rows(X.delimited(files(spark, ("c.csv", text))))
    assert [(r["msg_id"], r["sender"], r["content"]) for r in got] == [("msg_0", "B", "one"), ("msg_1", "A", "two")]


def test_detection_and_dispatch(spark):
    fs = files(spark, ("chat.txt", WHATSAPP), ("t.json", json.dumps(TELEGRAM)), ("i.json", json.dumps(META)), ("c.csv", "sender,timestamp,message\nA,2024-01-01,hi\n"))
    assert {r["file"]: r["platform"] for r in X.detect(fs).collect()} == {"chat.txt": "whatsapp", "t.json": "telegram", "i.json": "instagram", "c.csv": "csv"}
    assert X.parse(fs).count() == 4 + 3 + 2 + 1


def test_nothing_known(spark):
    assert X.detect(files(spark, ("x.bin", "hello"), ("e.txt", ""))).where("platform = 'unknown'").count() == 1
    with pytest.raises(Exception, match="no known chat export"):
        X.parse(files(spark, ("x.bin", "hello"))).collect()
    assert X.whatsapp(files(spark)).count() == 0


def test_exports_of_one_name_in_two_folders_stay_apart(spark, tmp_path):
    for k, folder in enumerate(("a", "b")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "chat.txt").write_text("\n".join(f"[12/01/2024, 18:4{i}:01] Alice: {folder} {i}" for i in range(3 + k)))
    got = X.parse(X.read_files(spark, f"file://{tmp_path}/*/chat.txt")).collect()
    assert len({r["file"] for r in got}) == 2 and sorted((r["file"][-10], r["msg_index"], r["content"]) for r in got) == [(f, i, f"{f} {i}") for f, n in (("a", 3), ("b", 4)) for i in range(n)]
