"""The health score: seven factors from 0 to 1, weighted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import conflict
from parlance.operators.stats import by_upload, gaps

# Weights, in the order of the report, and the patterns of shared plans.
WEIGHTS = {"communication_balance": 0.15, "response_consistency": 0.15, "sentiment_trend": 0.20, "conflict_recovery": 0.15, "affection_frequency": 0.15, "engagement_depth": 0.10, "shared_activities": 0.10}
SHARED = r"(?i)\bwe(?:'ll|'re| are| should| could)?\b|\bus\b|\bour\b|\blet'?s\b|\btogether\b|\btomorrow\b|\btonight\b|\bthis weekend\b|\bdate night\b|\bplan(?:ning|s)?\b|\bmovie\b|\bdinner\b|\btrip\b|\bvacation\b"


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _share(x: Column, digits: int = 1) -> Column:
    """With so many digits after the point, halves up."""
    return F.format_string(f"%.{digits}f", x)


def _counts(m: DataFrame) -> DataFrame:
    """Of each conversation, in one pass: messages by sender, and the measures of those that aren't deleted."""
    live = ~F.col("is_deleted")
    hit = F.coalesce((F.col("sentiment_score") > 0.3) & F.col("emotion_label").isin("joy", "love"), F.lit(False))
    by = m.groupBy("upload_id", "sender").agg(
        F.count("*").alias("n"), F.count_if(live).alias("live"), F.count_if(live & hit).alias("affectionate"), F.sum(F.when(live, F.col("word_count"))).alias("words"),
        F.count_if(live & T.is_question(F.col("content"))).alias("questions"), F.count_if(live & F.col("content").rlike(SHARED)).alias("shared"),
    )
    sums = [F.sum(c).alias(c) for c in ("live", "affectionate", "words", "questions", "shared")]
    return by.groupBy("upload_id").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("senders"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "sender"))).alias("ranked"), *sums)


def _gaps(m: DataFrame) -> DataFrame:
    log = F.log1p("minutes")
    return gaps(m).groupBy("upload_id").agg(F.count("*").alias("gaps"), F.stddev_pop(log).alias("sd"), F.avg(log).alias("mean"), F.percentile("minutes", F.lit(0.5)).alias("median"))


def _slope(m: DataFrame) -> DataFrame:
    """The slope of monthly averages over months that have one, in order."""
    months = m.where("sentiment_score IS NOT NULL").groupBy("upload_id", F.date_trunc("month", "timestamp").alias("month")).agg(F.avg("sentiment_score").alias("y"))
    months = months.withColumn("x", F.row_number().over(by_upload("month")) - 1)
    return months.groupBy("upload_id").agg(F.regr_slope("y", "x").alias("slope"), F.count("*").alias("months"))


def _conflicts(m: DataFrame) -> DataFrame:
    return conflict.summary(m).select("upload_id", "conflicts", "avg_recovery_hours")


# what each factor is made of: its table (a pass over the messages), its score, and the measure in words
_C = F.col
_ratio = lambda a, b: _C(a) / _C(b)


def _balance() -> tuple[Column, Column]:
    score = F.when(_C("senders") == 1, 1.0).otherwise(clamp(1 - (_ratio("most", "n") - 1 / _C("senders")) / (1 - 1 / _C("senders"))))
    shares = F.transform("ranked", lambda r: F.concat(r["sender"], F.lit(" "), F.bround(-r["n"] / _C("n") * 100).cast("int").cast("string"), F.lit("%")))
    return score, F.array_join(shares, " · ")


def _consistency() -> tuple[Column, Column]:
    few = F.coalesce(_C("gaps"), F.lit(0)) < 5
    variability = F.when(_C("mean") > 0, _C("sd") / _C("mean")).otherwise(0.0)
    raw = F.concat(F.lit("median "), _share(_C("median")), F.lit(" min · variability "), _share(variability, 2))
    return F.when(few, 0.5).otherwise(1 - clamp(variability / 1.5)), F.when(few, "insufficient data").otherwise(raw)


def _trend() -> tuple[Column, Column]:
    few = F.coalesce(_C("months"), F.lit(0)) < 2
    raw = F.concat(F.when(_C("slope") >= 0, "+").otherwise(""), _share(_C("slope"), 3), F.lit(" sentiment/month"))
    return F.when(few, 0.5).otherwise(clamp(0.5 + 5 * _C("slope"))), F.when(few, "insufficient data").otherwise(raw)


def _recovery() -> tuple[Column, Column]:
    none, open_ = _C("conflicts").isNull(), _C("avg_recovery_hours").isNull()
    score = F.when(none, 1.0).when(open_, 0.4).otherwise(1 - clamp(_C("avg_recovery_hours") / 24))
    number = _C("conflicts").cast("string")
    raw = F.when(none, "no difficult moments to measure").when(open_, F.concat(number, F.lit(" difficult moments, none resolved cleanly")))
    return score, raw.otherwise(F.concat(_share(_C("avg_recovery_hours")), F.lit("h avg over "), number, F.lit(" moments")))


def _affection() -> tuple[Column, Column]:
    none = _C("live") == 0
    return F.when(none, 0.0).otherwise(clamp(_ratio("affectionate", "live") * 5)), F.when(none, "no messages").otherwise(F.concat(_share(_ratio("affectionate", "live") * 100), F.lit("% of messages")))


def _engagement() -> tuple[Column, Column]:
    words, asked = F.when(_C("live") > 0, _ratio("words", "live")).otherwise(0.0), F.when(_C("live") > 0, _ratio("questions", "live")).otherwise(0.0)
    raw = F.concat(_share(words), F.lit(" words avg · "), _share(asked * 100), F.lit("% questions"))
    return (F.least(F.lit(1.0), words / 15) + F.least(F.lit(1.0), asked * 8)) / 2, raw


def _shared() -> tuple[Column, Column]:
    none = _C("live") == 0
    ratio = _ratio("shared", "live")
    return F.when(none, 0.0).otherwise(clamp(ratio * 4)), F.when(none, "no messages").otherwise(F.concat(_share(ratio * 100), F.lit("% of messages reference shared time")))


PARTS = {
    "communication_balance": (_counts, _balance), "response_consistency": (_gaps, _consistency), "sentiment_trend": (_slope, _trend), "conflict_recovery": (_conflicts, _recovery),
    "affection_frequency": (_counts, _affection), "engagement_depth": (_counts, _engagement), "shared_activities": (_counts, _shared),
}


def _factor(name: str):
    """The factor's score of every conversation."""

    def of(m: DataFrame) -> DataFrame:
        table, form = PARTS[name]
        rows = table(m) if table is _counts else m.select("upload_id").distinct().join(table(m), "upload_id", "left")
        return rows.select("upload_id", F.round(form()[0], 6).alias("score"))

    return of


FACTORS = {k: _factor(k) for k in PARTS}


def factors(m: DataFrame) -> DataFrame:
    """Every factor's score, weighted score and measure in words; four passes over the messages, and one row a conversation from each."""
    rows = _counts(m)
    for table in (_gaps, _slope, _conflicts):
        rows = rows.join(table(m), "upload_id", "left")
    each = [F.struct(F.lit(k).alias("factor"), F.round(form()[0], 6).alias("score"), F.lit(WEIGHTS[k]).alias("w"), form()[1].alias("raw_value")) for k, (_, form) in PARTS.items()]
    rows = rows.select("upload_id", F.explode(F.array(*each)).alias("f")).select("upload_id", "f.*")
    return rows.select("upload_id", "factor", "score", F.round(F.col("score") * F.col("w"), 4).alias("weighted"), "raw_value")


def composite(m: DataFrame) -> DataFrame:
    """The score out of 100 and its band."""
    rows = factors(m).groupBy("upload_id").agg(F.round(F.sum("weighted") * 100).cast("int").alias("overall"))
    return rows.withColumn("band", F.when(F.col("overall") < 40, "red").when(F.col("overall") < 70, "amber").otherwise("green"))


def insights(m: DataFrame) -> DataFrame:
    """Each factor's level in a word, and what it was measured from."""
    level = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.4, "moderate").otherwise("low")
    return factors(m).select("upload_id", "factor", level.alias("level"), "raw_value")


def uniform(m: DataFrame, margin: float = 0.12) -> DataFrame:
    """Whether all of a conversation's factors are near their mean, so that there is little to tell."""
    rows = factors(m).select("upload_id", "score", F.avg("score").over(Window.partitionBy("upload_id")).alias("mean"))
    return rows.groupBy("upload_id").agg(F.bool_and(F.abs(F.col("score") - F.col("mean")) <= margin).alias("uniform"))
