"""Difficult moments: runs of messages with bad signs, how they ended, and what was said in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators.stats import top

# Words of conflict, patterns of apology, and the thresholds.
KEYWORDS = "fight angry upset hate stop leave fine whatever sorry fault blame always never serious enough".split()
APOLOGY = r"(?i)\bsorry\b|\bapolog\w*\b|\bmy fault\b|\bmy bad\b|\bdidn'?t mean\b|\bregret\b|\bforgive\b|\bi was wrong\b"
NEGATIVE, ANGER, LEAST_RUN = -0.3, 0.6, 3
APOLOGY_ROWS, TOPIC_ROWS, GAP_HOURS, CALM = 5, 20, 12, 0.2

KEYWORD_PATTERN = rf"\b({'|'.join(KEYWORDS)})\b"


def rolling(m: DataFrame) -> DataFrame:
    """Messages that aren't deleted with their place, the average sentiment of three, whether it shows conflict, and what a later step needs of the rows after it."""
    w = Window.partitionBy("upload_id").orderBy("msg_index")
    rows = m.where("NOT is_deleted").withColumns({"rn": F.row_number().over(w), "roll": F.avg("sentiment_score").over(w.rowsBetween(-1, 1))})
    sign = (F.col("roll") < NEGATIVE) | ((F.col("emotion_label") == "anger") & (F.col("emotion_score") > ANGER)) | F.lower("content").rlike(KEYWORD_PATTERN)
    rows = rows.withColumn("sign", F.coalesce(sign, F.lit(False)))
    calm = F.coalesce(F.col("roll") > CALM, F.lit(False)).cast("int")
    # whether this row and the two after it are calm; there must be three
    three = F.when(F.count("*").over(w.rowsBetween(0, 2)) == 3, F.min(calm).over(w.rowsBetween(0, 2)) == 1).otherwise(False)
    return rows.withColumns({"calm3": three, "apology": F.coalesce(F.col("content").rlike(APOLOGY), F.lit(False))})


def runs(m: DataFrame) -> DataFrame:
    """Runs of at least three rows with a sign: where they begin and end, in rows and in messages, and their worst sentiment."""
    w = Window.partitionBy("upload_id").orderBy("rn")
    rows = rolling(m).where("sign").withColumn("island", F.col("rn") - F.row_number().over(w))
    out = rows.groupBy("upload_id", "island").agg(
        F.count("*").alias("messages"), F.min("rn").alias("lo"), F.max("rn").alias("hi"), F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"),
        F.min_by("msg_index", "rn").alias("first_index"), F.max_by("msg_index", "rn").alias("last_index"), F.min_by("sender", "rn").alias("trigger_sender"),
        F.min_by("content", "rn").alias("trigger"), F.min_by("msg_id", "rn").alias("trigger_id"), F.round(F.coalesce(F.min("sentiment_score"), F.lit(-0.3)), 4).alias("worst"),
    ).where(F.col("messages") >= LEAST_RUN)
    minutes = F.floor((F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / F.lit(60e6)).cast("bigint")
    return out.withColumns({"duration_minutes": F.greatest(minutes, F.lit(0)), "window_id": F.concat(F.lit("w_"), "first_index", F.lit("_"), "last_index")}).drop("island")


def _after(found: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """Each run with the rows after it, met by place: a run's next places are few, so it is an equality join."""
    places = found.select("upload_id", "window_id", "hi", "end_ts", F.explode(F.sequence(F.col("hi") + 1, F.col("hi") + most)).alias("rn"))
    return places.join(rows, ["upload_id", "rn"])


def resolutions(m: DataFrame) -> DataFrame:
    """How each run ended: an apology in five messages, else a gap of twelve hours, else three calm messages in twenty, else not at all."""
    rows = rolling(m).select("upload_id", "rn", "timestamp", "sender", "msg_index", "apology", "calm3")
    found = runs(m)
    after = _after(found, rows, TOPIC_ROWS)
    minutes = F.floor((F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.col("end_ts").cast("timestamp"))) / F.lit(60e6)).cast("bigint")
    after = after.withColumns({"d": F.col("rn") - F.col("hi"), "minutes": F.greatest(minutes, F.lit(0))})
    seen = F.struct("rn", "msg_index", "sender", "minutes")
    least = lambda cond: F.min(F.when(cond, seen))
    best = after.groupBy("upload_id", "window_id").agg(
        least(F.col("apology") & (F.col("d") <= APOLOGY_ROWS)).alias("a"),
        least((F.col("d") == 1) & (F.col("minutes") >= GAP_HOURS * 60)).alias("g"),
        least(F.col("calm3") & (F.col("d") <= TOPIC_ROWS - 2)).alias("t"),
    )
    kind = F.when(F.col("a").isNotNull(), "apology").when(F.col("g").isNotNull(), "time_gap").when(F.col("t").isNotNull(), "topic_change").otherwise("unresolved")
    hit = F.coalesce("a", "g", "t")
    out = found.join(best, ["upload_id", "window_id"], "left").withColumns({"resolution": kind, "hit": hit})
    return out.select("upload_id", "window_id", "start_ts", "trigger", "trigger_sender", "duration_minutes", "worst", "resolution", F.col("hit.msg_index").alias("resolved_index"), F.col("hit.sender").alias("resolved_by"), F.col("hit.minutes").alias("minutes_after"))


def summary(m: DataFrame) -> DataFrame:
    r = resolutions(m)
    done = F.col("resolution") != "unresolved"
    return r.groupBy("upload_id").agg(
        F.count("*").alias("conflicts"), F.round(F.avg(F.col("duration_minutes") / 60), 4).alias("avg_duration_hours"),
        F.round(F.avg(F.when(done, F.col("minutes_after") / 60)), 4).alias("avg_recovery_hours"), F.count_if(done).alias("resolved"),
    )


def triggers(m: DataFrame, k: int = 5) -> DataFrame:
    """Keywords in the messages that began the runs; a run without one counts its most used word."""
    r = runs(m).withColumn("found", F.regexp_extract_all(F.lower(F.substring("trigger", 1, 280)), F.lit(KEYWORD_PATTERN), F.lit(1)))
    own = top_words(m).where("rank = 1").select("upload_id", "window_id", "word")
    each = r.join(own, ["upload_id", "window_id"], "left").select("upload_id", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.when(F.col("word").isNotNull(), F.array("word")).otherwise(F.array().cast("array<string>")))).alias("trigger"))
    return top(each.groupBy("upload_id", "trigger").agg(F.count("*").alias("runs")), ["upload_id"], k, F.desc("runs"), "trigger")


def roles(m: DataFrame) -> DataFrame:
    """Who begins and who resolves most: sender, count and total."""
    r = resolutions(m)
    begun = r.select("upload_id", F.lit("escalates").alias("role"), F.col("trigger_sender").alias("sender"))
    ended = r.where("resolution <> 'unresolved' AND resolved_by IS NOT NULL").select("upload_id", F.lit("resolves").alias("role"), F.col("resolved_by").alias("sender"))
    counts = begun.unionByName(ended).groupBy("upload_id", "role", "sender").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("upload_id", "role")))
    return top(counts, ["upload_id", "role"], 1, F.desc("n"), "sender").drop("rank")


def per_month(m: DataFrame) -> DataFrame:
    return runs(m).groupBy("upload_id", F.date_format("start_ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("conflicts"))


def _words_in(places: DataFrame, m: DataFrame) -> DataFrame:
    rows = rolling(m).select("upload_id", "rn", "content")
    each = places.join(rows, ["upload_id", "rn"]).select("upload_id", "window_id", "rn", F.posexplode(T.tokens_without_links(F.col("content"))).alias("pos", "word"))
    return each.where(~F.col("word").isin(*T.CONTENT_STOPWORDS))


def top_words(m: DataFrame, k: int = 8) -> DataFrame:
    """Most used words of each run; ties go to the one met first."""
    places = runs(m).select("upload_id", "window_id", F.explode(F.sequence("lo", "hi")).alias("rn"))
    counts = _words_in(places, m).groupBy("upload_id", "window_id", "word").agg(F.count("*").alias("uses"), F.min(F.struct("rn", "pos")).alias("at"))
    return top(counts, ["upload_id", "window_id"], k, F.desc("uses"), "at").select("upload_id", "window_id", "rank", "word", "uses")


def language(m: DataFrame, k: int = 40) -> DataFrame:
    """Most used words in the runs, and in the five messages after them (as often as runs precede them)."""
    found = runs(m)
    inside = found.select("upload_id", "window_id", F.explode(F.sequence("lo", "hi")).alias("rn"))
    after = found.select("upload_id", "window_id", F.explode(F.sequence(F.col("hi") + 1, F.col("hi") + APOLOGY_ROWS)).alias("rn"))
    each = [_words_in(p, m).groupBy("upload_id", "word").agg(F.count("*").alias("uses")).withColumn("part", F.lit(name)) for name, p in (("during", inside), ("after", after))]
    return top(each[0].unionByName(each[1]), ["upload_id", "part"], k, F.desc("uses"), "word")


def start_times(m: DataFrame) -> DataFrame:
    """Runs by the hour and by the weekday (0 is Monday) on which they begin, all values of both."""
    r = runs(m).select("upload_id", F.hour("start_ts").alias("hour"), F.weekday("start_ts").alias("weekday"))
    both = r.select("upload_id", F.lit("hour").alias("part"), F.col("hour").alias("value")).unionByName(r.select("upload_id", F.lit("weekday").alias("part"), F.col("weekday").alias("value")))
    counts = both.groupBy("upload_id", "part", "value").agg(F.count("*").alias("n"))
    values = lambda part, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.lit(part).alias("part"), i.alias("value")))
    spine = m.select("upload_id").distinct().select("upload_id", F.inline(F.concat(values("hour", 24), values("weekday", 7))))
    return spine.join(counts, ["upload_id", "part", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def themes(m: DataFrame, k: int = 3) -> DataFrame:
    """The one theme given without a language model, named by the keyword that begins most runs (that met first, of equal ones); with its runs and the first k messages that began one."""
    r = runs(m)
    each = r.select("upload_id", "lo", F.posexplode(F.regexp_extract_all(F.lower(F.substring("trigger", 1, 280)), F.lit(KEYWORD_PATTERN), F.lit(1))).alias("pos", "word"))
    words = each.groupBy("upload_id", "word").agg(F.count("*").alias("n"), F.min(F.struct("lo", "pos")).alias("at"))
    words = top(words, ["upload_id"], 1, F.desc("n"), "at").select("upload_id", "word")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("lo", F.col(c).alias("x")))), lambda s: s["x"])
    r = r.groupBy("upload_id").agg(F.count("*").alias("conflicts"), F.round(F.avg("worst"), 4).alias("avg_peak"), in_order("window_id").alias("window_ids"), F.slice(in_order("trigger_id"), 1, k).alias("examples"))
    label = F.when(F.col("word").isNotNull(), F.concat(F.lit("Around '"), "word", F.lit("'"))).otherwise("Recurring tension")
    return r.join(words, "upload_id", "left").select("upload_id", label.alias("label"), "conflicts", "avg_peak", "window_ids", "examples")


def named_themes(m: DataFrame, answers: DataFrame) -> DataFrame:
    """Themes that a model named: answers has upload_id, window_id and theme; windows it doesn't name are in none, and those it made up don't count."""
    told = answers.select("upload_id", "window_id", "theme").dropDuplicates(["upload_id", "window_id"])
    return runs(m).join(told, ["upload_id", "window_id"]).groupBy("upload_id", "theme").agg(F.count("*").alias("conflicts"), F.round(F.avg("worst"), 4).alias("avg_peak"))


def sample_messages(m: DataFrame, k: int = 5) -> DataFrame:
    """What stands for each run: the first message, the one of worst sentiment, the two of strongest emotion, the last; each once."""
    rows = rolling(m).select("upload_id", "rn", "msg_index", "sentiment_score", "emotion_score")
    each = runs(m).select("upload_id", "window_id", F.explode(F.sequence("lo", "hi")).alias("rn")).join(rows, ["upload_id", "rn"])
    w = Window.partitionBy("upload_id", "window_id")
    each = each.withColumns({
        "p_first": F.row_number().over(w.orderBy("rn")), "p_last": F.row_number().over(w.orderBy(F.desc("rn"))),
        "p_worst": F.row_number().over(w.orderBy(F.coalesce("sentiment_score", F.lit(1.0)), "rn")), "p_strong": F.row_number().over(w.orderBy(F.desc(F.coalesce("emotion_score", F.lit(0.0))), "rn")),
    })
    place = F.when(F.col("p_first") == 1, 1).when(F.col("p_worst") == 1, 2).when(F.col("p_strong") <= 2, 2 + F.col("p_strong")).when(F.col("p_last") == 1, 5)
    return top(each.withColumn("place", place).where("place IS NOT NULL"), ["upload_id", "window_id"], k, "place").select("upload_id", "window_id", "rank", "msg_index")


def arcs(m: DataFrame, margin: int = 5) -> DataFrame:
    """The sentiment of each run's messages and of those around it, nulls too."""
    rows = rolling(m).select("upload_id", "rn", "msg_index", "sentiment_score")
    places = runs(m).select("upload_id", "window_id", F.explode(F.sequence(F.greatest(F.col("lo") - margin, F.lit(1)), F.col("hi") + margin)).alias("rn"))
    return places.join(rows, ["upload_id", "rn"]).select("upload_id", "window_id", "msg_index", "sentiment_score")


def in_keywords(text: Column) -> Column:
    return F.lower(text).rlike(KEYWORD_PATTERN)
