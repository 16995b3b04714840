from parlance.operators import answers


def hits(spark):
    rows = [(0, 1, "msg_1", "A", "we argue", 0.5, "anger"), (0, 2, "msg_2", "B", "love you", 0.45, "love"), (0, 3, "msg_3", "B", "ok", 0.1, None)]
    return spark.createDataFrame(rows, "query_id int, rank int, msg_id string, sender string, content string, similarity double, emotion_label string")


def test_without_a_model(spark):
    got = answers.answer(hits(spark), "when did we say love")
    assert got["cited"] == ["msg_2", "msg_1", "msg_3"] and got["confidence"] == 0.5 and "[msg_2]" in got["answer"]


def test_pieces_citations_and_errors(spark):
    events = list(answers.answer_stream(hits(spark), "why", lambda p: iter(["As [msg_3] ", "and [msg_9] say"])))
    assert [e["event"] for e in events] == ["meta", "delta", "delta", "done"] and events[-1]["cited"] == ["msg_3"] and events[-1]["confidence"] == 0.6

    def broken(_):
        yield "x"
        raise RuntimeError("down")

    assert [e["event"] for e in answers.answer_stream(hits(spark), "why", broken)] == ["meta", "delta", "error"]
    assert answers.answer(hits(spark).where("false"), "why")["cited"] == []


def test_rephrasing():
    assert answers.rephrased("fun?", lambda p: "funny moments") == "funny moments" and answers.rephrased("fun?", None) == "fun?"
    assert answers.rephrased("plans trip budget hotel flights", lambda p: "no") == "plans trip budget hotel flights"
