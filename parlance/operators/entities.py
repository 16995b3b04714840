"""Entities of messages in four families, and their mentions whatever their case: persons, places, dates and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.stats import first_of

# Words of events.
EVENTS = ("birthday", "anniversary", "wedding", "engagement", "graduation", "funeral", "vacation", "trip", "holiday", "christmas", "thanksgiving", "diwali", "hanukkah", "ramadan", "eid", "new year", "party", "concert", "festival", "reunion", "interview", "meeting", "appointment", "dinner", "lunch", "brunch", "date night")
PATTERN = r"\b((?:[\w']+\s+){0,2}(?:" + "|".join(EVENTS) + r"))\b"


def event_phrases(text: Column) -> Column:
    """Distinct phrases of an event's word and up to two words before it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)" + PATTERN), F.lit(1)))


# The stand-in's words: days, and words before a name that tell a person or a place.
DATES = r"\b(today|tonight|tomorrow|yesterday|this weekend|next week|last week|(?:mon|tues|wednes|thurs|fri|satur|sun)day)\b"
PERSONS, PLACES = r"\b(?:with|and|from|tell|ask) ([A-Z][a-z]+)\b", r"\b(?:in|at|to|near) ([A-Z][a-z]+)\b"


FAMILIES = ("persons", "places", "dates", "events")


def extracted(text: Column) -> Column:
    """A struct of persons, places and dates: the stand-in for a model, by a few patterns."""
    find = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    return F.struct(find(PERSONS).alias("persons"), find(PLACES).alias("places"), find("(?i)" + DATES).alias("dates"), F.array().cast("array<string>").alias("events"))


def mentions(m: DataFrame, extract: Callable[[Column], Column] | None = None) -> DataFrame:
    """upload_id, msg_index, family and phrase. extract: a model's column, a struct of the four families; events by phrase are added to its own."""
    rows = m.where("NOT is_deleted").withColumn("_e", (extract or extracted)(F.col("content")))
    events = F.array_union(F.coalesce("_e.events", F.array().cast("array<string>")), event_phrases(F.col("content")))
    families = {"persons": F.col("_e.persons"), "places": F.col("_e.places"), "dates": F.col("_e.dates"), "events": events}
    each = rows.select("upload_id", "msg_index", F.explode(F.array(*[F.struct(F.lit(k).alias("family"), v.alias("found")) for k, v in families.items()])).alias("f"))
    each = each.select("upload_id", "msg_index", "f.family", F.explode("f.found").alias("phrase"))
    return each.withColumn("phrase", F.trim("phrase")).where("phrase <> ''")


def aggregate(m: DataFrame, extract: Callable[[Column], Column] | None = None) -> DataFrame:
    """Mentions of each phrase of a family, in whatever case; the most common spelling stands for it."""
    spelt = mentions(m, extract).groupBy("upload_id", "family", F.lower("phrase").alias("key"), "phrase").agg(F.count("*").alias("n"))
    shown = first_of(spelt, ["upload_id", "family", "key"], F.desc("n"), "phrase").select("upload_id", "family", "key", F.col("phrase").alias("display"))
    return spelt.groupBy("upload_id", "family", "key").agg(F.sum("n").alias("mentions")).join(shown, ["upload_id", "family", "key"])
