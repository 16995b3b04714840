"""Chat exports as messages. Every parser takes files (file, text) and gives rows for all of them at once:
file, msg_id, msg_index, sender, timestamp (UTC), content, msg_type, reply_to_id, has_media, is_deleted.

Text and JSON exports are parsed by column expressions; only delimited files, whose quoting and headers vary by file,
go through Python, a file at a time.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as T


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file (its whole path: exports of one name lie in many folders) and text of every file: UTF-8, or Latin-1 where the bytes are no valid UTF-8.

    Spark reads no files whose names begin with _ or a dot; exports of such names have to be renamed.
    """
    raw = spark.read.format("binaryFile").load(path)
    as_text = F.col("content").cast("string")
    return raw.select(F.col("path").alias("file"), F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode("content", "ISO-8859-1")).alias("text"))


# ---- detection ----

# Signatures of the exports and the weights of the evidence.
SIGNATURES = (
    r"(?m)^\[\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4},?\s+\d{1,2}:\d{2}",
    r"(?im)^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4},?\s+\d{1,2}:\d{2}\s*(?:AM|PM)?\s*-\s",
    r"(?i)Messages and calls are end-to-end encrypted",
)
TELEGRAM_KEYS, INSTAGRAM_KEYS, FACEBOOK_KEYS = ("text_entities", "from_id", "date_unixtime"), ("thread_path", "magic_words", "is_still_participant"), ("joinable_mode", "thread_type", "image", "messages_received_time")
HEADER_WORDS = ("sender", "from", "author", "timestamp", "date", "message", "content")
LEAST_CONFIDENCE = 0.4


def detect(files: DataFrame) -> DataFrame:
    """file, platform and confidence: sums of evidence, at most 1; ties go to the platform listed first."""
    name, text = F.lower(F.regexp_extract("file", r"([^/]+)$", 1)), F.col("text")
    given = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    is_json = F.trim(text).rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull()
    top_keys = F.coalesce(F.json_object_keys(F.when(F.trim(text).startswith("{"), text)), F.array().cast("array<string>"))
    message = F.coalesce(F.get_json_object(text, "$.messages[0]"), F.lit("{}"))
    keys = F.coalesce(F.json_object_keys(message), F.array().cast("array<string>"))
    has = lambda arr, words: F.arrays_overlap(arr, F.array(*map(F.lit, words)))
    sample = F.substring(text, 1, 8192)
    both = F.array_contains(keys, "sender_name") & F.array_contains(keys, "timestamp_ms")
    instagram, facebook = has(F.array_union(keys, top_keys), INSTAGRAM_KEYS), has(top_keys, FACEBOOK_KEYS)
    first = F.element_at(F.split(sample, "\n"), 1)
    header = (F.size(F.split(first, ",")) >= 3) & F.exists(F.array(*map(F.lit, HEADER_WORDS)), lambda w: F.lower(first).contains(w))
    dot_json = given(name.endswith(".json"), 0.05)
    plain = ~is_json
    whatsapp = given(name.contains("whatsapp"), 0.4) + given(name.endswith(".txt"), 0.1)
    for s in SIGNATURES:
        whatsapp = whatsapp + given(plain & sample.rlike(s), 0.5)
    scores = (
        ("whatsapp", whatsapp),
        ("telegram", dot_json + given(is_json & has(keys, TELEGRAM_KEYS), 0.85) + given(is_json & F.array_contains(top_keys, "type") & F.array_contains(top_keys, "messages") & F.get_json_object(text, "$.type").rlike("chat|group|channel"), 0.4)),
        ("instagram", dot_json + given(is_json & both & instagram, 0.85)),
        ("facebook", dot_json + given(is_json & both & ~instagram & facebook, 0.85) + given(is_json & both & ~instagram & ~facebook, 0.6)),
        ("csv", given(name.rlike(r"\.[ct]sv$"), 0.5) + given(plain & header, 0.4)),
    )
    best = F.array_max(F.array(*[F.struct(F.round(F.least(F.lit(1.0), s), 6).alias("score"), F.lit(-i).alias("order"), F.lit(p).alias("platform")) for i, (p, s) in enumerate(scores)]))
    return files.withColumn("_b", best).select("file", F.when(F.col("_b.score") > 0, F.col("_b.platform")).otherwise("unknown").alias("platform"), F.col("_b.score").alias("confidence"))


# ---- text exports with a header on each message ----

_DAY = r"\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}"
_TIME = r"\d{1,2}:\d{2}(?::\d{2})?"
BRACKET = rf"^\[({_DAY}),?\s+({_TIME})\s*(AM|PM|am|pm)?\]\s*([^:]+?):\s(.*)$"
ISO = rf"^(\d{{4}}-\d{{2}}-\d{{2}}),?\s+({_TIME})\s*-\s*(.*)$"
DASH = rf"^({_DAY}),?\s+({_TIME})\s*(AM|PM|am|pm)?\s*-\s*(.*)$"
# Phrases that stand for media, for deleted messages and for the system's notes, in the order tried.
MEDIA = (("image omitted", "image"), ("video omitted", "video"), ("audio omitted", "audio"), ("voice message omitted", "audio"), ("ptt omitted", "audio"), ("sticker omitted", "sticker"), ("gif omitted", "image"), ("document omitted", "file"), ("contact card omitted", "file"), ("<media omitted>", "image"))
DELETED = ("this message was deleted", "you deleted this message", "<this message was edited>")
SYSTEM = (r"^Messages and calls are end-to-end encrypted", r"\bcreated group\b", r"\b(added|removed|left|joined)\b", r"\bchanged the subject\b", r"\bchanged this group's icon\b", r"\bchanged the group description\b", r"\bsecurity code changed\b", r"\bmessages to this (chat|group)\b")


def whatsapp(files: DataFrame) -> DataFrame:
    """Lines with a header begin a message, others continue it; a header whose time can't be read is left out.

    Whether a file writes days or months first is settled by the latest line that only one of them fits; until then, and
    wherever the way of writing dates changes, days come first.
    """
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "[‎‏]", ""), " ", " ")
    lines = files.select("file", F.posexplode(F.split(clean, "\n")).alias("line", "s")).withColumn("s", F.rtrim(F.regexp_replace("s", r"\s+$", ""))).where("s <> ''")
    s = F.col("s")
    kind = F.when(s.rlike(BRACKET), "b").when(s.rlike(ISO), "i").when(s.rlike(DASH), "d")
    part = lambda b, i, d: F.when(F.col("kind") == "b", F.regexp_extract(s, BRACKET, b)).when(F.col("kind") == "i", F.regexp_extract(s, ISO, i) if i else F.lit("")).when(F.col("kind") == "d", F.regexp_extract(s, DASH, d))
    rows = lines.withColumn("kind", kind)
    rows = rows.withColumns({"date": part(1, 1, 1), "time": part(2, 2, 2), "ampm": F.upper(part(3, 0, 3)), "rest": part(5, 3, 4)})
    rows = rows.withColumn("sender", F.when(F.col("kind") == "b", F.trim(F.regexp_extract(s, BRACKET, 4))).when(F.col("rest").contains(":"), F.trim(F.regexp_extract("rest", r"^([^:]*):", 1))).otherwise(""))
    rows = rows.withColumn("body", F.when(F.col("kind") == "b", F.col("rest")).when(F.col("rest").contains(":"), F.regexp_replace("rest", r"^[^:]*:\s*", "")).otherwise(F.col("rest")))
    rows = rows.withColumn("no_sender", F.col("kind").isin("i", "d") & ~F.col("rest").contains(":"))
    rows = rows.withColumns({"a": F.regexp_extract("date", r"^(\d+)", 1).cast("int"), "b": F.regexp_extract("date", r"^\d+\D(\d+)", 1).cast("int"), "c": F.regexp_extract("date", r"(\d+)$", 1)})
    shape = F.when(F.col("kind").isin("b", "d"), F.concat(F.regexp_extract("date", r"(\D)", 1), F.length("c")))
    w = Window.partitionBy("file").orderBy("line")
    rows = rows.withColumn("shape", shape)
    heads = w.rowsBetween(Window.unboundedPreceding, -1)
    new_shape = F.col("shape").isNotNull() & (F.coalesce(F.last("shape", True).over(heads), F.lit("")) != F.col("shape"))
    forced = F.when(F.col("shape").isNotNull() & (F.col("b") > 12) & (F.col("a") <= 12), "m").when(F.col("shape").isNotNull() & (F.col("a") > 12) & (F.col("b") <= 12), "d").when(new_shape, "d")
    rows = rows.withColumn("forced", forced).withColumn("order", F.coalesce(F.last("forced", True).over(w), F.lit("d")))
    day, month = F.when(F.col("order") == "d", F.col("a")).otherwise(F.col("b")), F.when(F.col("order") == "d", F.col("b")).otherwise(F.col("a"))
    year = F.when(F.length("c") == 4, F.col("c").cast("int")).when(F.length("c") == 2, F.col("c").cast("int") + F.when(F.col("c").cast("int") < 69, 2000).otherwise(1900))
    date = F.when(F.col("kind") == "i", F.col("date")).otherwise(F.format_string("%04d-%02d-%02d", year, month, day))
    hour = F.regexp_extract("time", r"^(\d+)", 1).cast("int")
    hour24 = F.when(F.col("ampm").isin("AM", "PM"), F.when((hour >= 1) & (hour <= 12), hour % 12 + F.when(F.col("ampm") == "PM", 12).otherwise(0))).otherwise(hour)
    clock = F.concat(F.format_string("%02d", hour24), F.regexp_extract("time", r"^\d+(:\d{2})", 1), F.when(F.col("time").rlike(r"^\d+:\d{2}:\d{2}"), F.regexp_extract("time", r"(:\d{2})$", 1)).otherwise(":00"))
    stamp = F.try_to_timestamp(F.concat(date, F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = rows.withColumn("timestamp", F.when(F.col("kind").isNotNull() & hour24.isNotNull(), stamp))
    # a header that can't be read is left out, as if its line weren't there
    rows = rows.where(F.col("kind").isNull() | F.col("timestamp").isNotNull())
    rows = rows.withColumn("group", F.count("kind").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("group > 0")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", F.when(F.col("kind").isNotNull(), F.col("body")).otherwise(s).alias("t")))), lambda x: x["t"])
    head = lambda c: F.max(F.when(F.col("kind").isNotNull(), F.col(c))).alias(c)
    m = rows.groupBy("file", "group").agg(head("sender"), head("timestamp"), head("body"), F.bool_or(F.coalesce("no_sender", F.lit(False))).alias("no_sender"), texts.alias("texts"))
    low = F.lower("body")
    deleted = F.lit(False)
    for p in DELETED:
        deleted = deleted | low.contains(p)
    system = F.col("no_sender")
    for p in SYSTEM:
        system = system | F.col("body").rlike(f"(?i){p}")
    media = F.when(F.lit(False), "")
    for p, kind_ in MEDIA:
        media = media.when(low.contains(p), kind_)
    m = m.withColumns({"is_deleted": deleted, "_system": system, "_media": F.when(~system, media)})
    more = F.slice(F.col("texts"), 2, F.size("texts"))
    content = F.array_join(F.filter(F.concat(F.array(F.when(F.col("is_deleted"), "").otherwise(F.col("body"))), more), lambda t: t != ""), "\n")
    return m.select(
        "file", F.concat(F.lit("msg_"), F.col("group") - 1).alias("msg_id"), (F.col("group") - 1).cast("int").alias("msg_index"),
        F.when(F.col("sender") != "", F.col("sender")).when(F.col("_system"), "system").otherwise("unknown").alias("sender"), "timestamp", content.alias("content"),
        F.when(F.col("_system"), "system").when(F.col("is_deleted"), "deleted").otherwise(F.coalesce("_media", F.lit("text"))).alias("msg_type"),
        F.lit(None).cast("string").alias("reply_to_id"), F.col("_media").isNotNull().alias("has_media"), "is_deleted",
    )


# ---- JSON exports ----

# Kinds of media.
TELEGRAM_MEDIA = {"voice_message": "audio", "video_message": "video", "video_file": "video", "audio_file": "audio", "animation": "video", "sticker": "sticker"}


def _messages(files: DataFrame) -> DataFrame:
    """file, pos, n and raw: each element of a document's messages as a variant."""
    rows = files.select("file", F.from_json("text", "messages array<string>")["messages"].alias("all"))
    return rows.select("file", F.size("all").alias("n"), F.posexplode("all").alias("pos", "json")).withColumn("raw", F.try_parse_json("json")).where("raw IS NOT NULL")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("raw"), f"$.{path}", kind)


def _kind(path: str) -> Column:
    """Schema of a field as text; null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(F.col("raw"), f"$.{path}", "variant"))


def _flat(path: str) -> Column:
    """A text that is a string, or a list of strings and of objects with a text."""
    parts = F.transform(_get(path, "array<variant>"), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))))
    return F.when(_kind(path).startswith("ARRAY"), F.array_join(parts, "")).when(_kind(path) == "STRING", _get(path)).otherwise("")


def _truthy(path: str) -> Column:
    """Whether a field is there and isn't null, false, zero or empty."""
    return F.coalesce((_kind(path) != "VOID") & ~_get(path).isin("", "false", "0", "[]", "{}"), F.lit(False))


def telegram(files: DataFrame) -> DataFrame:
    """Messages in the order of the file; ids keep the places of those left out. Replies find their target by its own id."""
    rows = _messages(files)
    unix = _get("date_unixtime", "bigint")
    stamp = F.coalesce(F.timestamp_seconds(unix), F.try_to_timestamp(_get("date")))
    text = F.when(_flat("text") != "", _flat("text")).when(_kind("text_entities").startswith("ARRAY"), _flat("text_entities")).otherwise("")
    media_type = _get("media_type")
    pairs = [x for k, v in TELEGRAM_MEDIA.items() for x in (F.lit(k), F.lit(v))]
    known = F.create_map(*pairs)[media_type]
    media = F.when(known.isNotNull(), known).when(_truthy("photo"), "image").when(_truthy("sticker_emoji") | (_truthy("file") & F.lower(F.coalesce(media_type, F.lit(""))).contains("sticker")), "sticker").when(_truthy("file"), "file")
    service = F.coalesce(_get("type") == "service", F.lit(False))
    rows = rows.select(
        "file", "pos", stamp.alias("timestamp"), F.coalesce(F.nullif(_get("from"), F.lit("")), F.nullif(_get("actor"), F.lit("")), F.lit("unknown")).alias("sender"),
        F.when(service & (text == ""), F.coalesce(_get("action"), F.lit(""))).otherwise(text).alias("text"), F.when(~service, media).alias("media"), service.alias("service"),
        _kind("poll").isNotNull().alias("poll"), _truthy("deleted").alias("is_deleted"), _get("id", "bigint").alias("own"), _get("reply_to_message_id", "bigint").alias("target"),
    ).where("timestamp IS NOT NULL")
    rows = rows.withColumn("msg_id", F.concat(F.lit("msg_"), "pos"))
    targets = rows.where("own IS NOT NULL").groupBy("file", F.col("own").alias("target")).agg(F.max_by("msg_id", "pos").alias("reply_to_id"))
    rows = rows.join(targets, ["file", "target"], "left")
    kind = F.when(F.col("is_deleted"), "deleted").when(F.col("service"), "system").when(F.col("media").isNotNull(), F.col("media")).when(F.col("poll"), "system").otherwise("text")
    index = F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1
    return rows.select("file", "msg_id", index.alias("msg_index"), "sender", "timestamp", F.when(F.col("is_deleted"), "").otherwise(F.col("text")).alias("content"), kind.alias("msg_type"), "reply_to_id", F.col("media").isNotNull().alias("has_media"), "is_deleted")


def repaired(x: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; other texts as they are."""
    again = F.encode(x, "ISO-8859-1").cast("string")
    return F.when(x.rlike(r"^[\x{00}-\x{FF}]*$") & F.is_valid_utf8(again), again).otherwise(x)


def _meta(files: DataFrame, facebook: bool) -> DataFrame:
    """Newest first in the file, so places are counted from its end."""
    rows = _messages(files).withColumn("place", F.col("n") - 1 - F.col("pos"))
    ms = _get("timestamp_ms", "bigint")
    text = F.when(_kind("content") == "STRING", repaired(_get("content"))).otherwise("")
    listed = lambda p: F.coalesce(_kind(p).startswith("ARRAY") & (F.size(_get(p, "array<variant>")) > 0), F.lit(False))
    media = F.when(listed("photos"), "image").when(listed("videos"), "video").when(listed("audio_files"), "audio")
    if facebook:
        media = media.when(listed("gifs"), "image").when(F.coalesce(_kind("sticker").startswith("OBJECT") & (_get("sticker") != "{}"), F.lit(False)), "sticker")
    link = F.coalesce(F.nullif(_get("share.link"), F.lit("")), F.nullif(_get("share.share_text"), F.lit("")))
    share = F.coalesce(_kind("share").startswith("OBJECT"), F.lit(False)) & media.isNull()
    shared = F.when(share & link.isNotNull(), F.when(text != "", F.trim(F.concat(text, F.lit(" "), link))).otherwise(repaired(link))).otherwise(text)
    event = F.coalesce(F.lit(facebook) & ~share & media.isNull() & (text == "") & (_get("type") != "") & ~_get("type").isin("Generic", "Share"), F.lit(False))
    deleted = _truthy("is_unsent") if facebook else F.lower(text).contains("unsent a message")
    rows = rows.select(
        "file", "place", F.timestamp_millis(ms).alias("timestamp"), repaired(F.coalesce(F.nullif(_get("sender_name"), F.lit("")), F.lit("unknown"))).alias("sender"),
        F.when(event, F.concat(F.lit("["), _get("type"), F.lit("]"))).otherwise(shared).alias("text"), media.alias("media"), event.alias("event"), deleted.alias("is_deleted"),
    ).where("timestamp IS NOT NULL")
    kind = F.when(F.col("is_deleted"), "deleted").when(F.col("event"), "system").otherwise(F.coalesce("media", F.lit("text")))
    index = F.row_number().over(Window.partitionBy("file").orderBy("place")) - 1
    return rows.select("file", F.concat(F.lit("msg_"), "place").alias("msg_id"), index.alias("msg_index"), "sender", "timestamp", F.when(F.col("is_deleted"), "").otherwise(F.col("text")).alias("content"), kind.alias("msg_type"), F.lit(None).cast("string").alias("reply_to_id"), F.col("media").isNotNull().alias("has_media"), "is_deleted")


def instagram(files: DataFrame) -> DataFrame:
    return _meta(files, False)


def facebook(files: DataFrame) -> DataFrame:
    return _meta(files, True)


# ---- delimited exports ----

# Words of each column's header, and the ways of writing a time, in the order tried.
SENDER, WHEN, CONTENT = ("sender", "from", "author", "user", "name", "participant"), ("timestamp", "datetime", "date", "time", "sent_at", "created_at", "when"), ("message", "content", "text", "body", "msg")
TIMES = (
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d/%m/%Y", "%d.%m.%Y %H:%M:%S",
    "%d.%m.%Y %H:%M", "%d.%m.%Y", "%d-%m-%Y %H:%M:%S", "%d-%m-%Y %H:%M", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y", "%m/%d/%y %I:%M %p", "%m/%d/%y %H:%M",
)


def parse_time(s: str) -> datetime | None:
    s = s.strip()
    try:
        x = float(s)
        return datetime.fromtimestamp(x / 1000 if x > 1e10 else x, timezone.utc).replace(tzinfo=None)
    except (ValueError, OverflowError, OSError):
        pass
    try:
        t = datetime.fromisoformat(s.replace("Z", "+00:00"))
        return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t
    except ValueError:
        pass
    for f in TIMES:
        try:
            return datetime.strptime(s, f)
        except ValueError:
            continue
    return None


def delimited_rows(text: str) -> list[tuple[str, datetime, str]]:
    """(sender, time, content) of a file's rows that hold all three."""
    head = [x for x in text.splitlines()[:20] if x.strip()]
    if not head:
        return []
    # the delimiter that cuts most lines into the same number of fields, three at least
    cuts = {d: [len(r) for r in csv.reader(head, delimiter=d)] for d in ",;\t|"}
    best = max(cuts, key=lambda d: (max(cuts[d], key=cuts[d].count) >= 3, cuts[d].count(max(cuts[d], key=cuts[d].count)), max(cuts[d])))
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=best) if r]
    names = [x.strip().lower() for x in rows[0]]
    find = lambda keys: next((i for i, n in enumerate(names) if any(k in n for k in keys)), None)
    headed = not any(parse_time(x) for x in rows[0]) and any(find(k) is not None for k in (SENDER, WHEN, CONTENT))
    # a column that another one has taken by its more telling name isn't taken twice
    if headed:
        at = [find(SENDER), find(WHEN), find(CONTENT)]
        if None in at:
            return []
    else:
        at = [0, 1, 2] if len(rows[0]) >= 3 else None
        if at is None:
            return []
    out = []
    for r in rows[1:] if headed else rows:
        if len(r) > max(at) and (when := parse_time(r[at[1]])) is not None:
            out.append((r[at[0]].strip() or "unknown", when, r[at[2]]))
    return sorted(out, key=lambda x: x[1])


def delimited(files: DataFrame) -> DataFrame:
    """Rows in order of time, numbered in that order; ragged rows and rows without a readable time are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = delimited_rows(text or "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].replace(tzinfo=timezone.utc) for r in rows], pa.timestamp("us", tz="UTC")), pa.array([r[2] for r in rows], pa.string())],
                    names=["file", "msg_index", "sender", "timestamp", "content"],
                )

    rows = files.select("file", "text").mapInArrow(run, "file string, msg_index int, sender string, timestamp timestamp, content string")
    return rows.select("file", F.concat(F.lit("msg_"), "msg_index").alias("msg_id"), "msg_index", "sender", "timestamp", "content", F.lit("text").alias("msg_type"), F.lit(None).cast("string").alias("reply_to_id"), F.lit(False).alias("has_media"), F.lit(False).alias("is_deleted"))


PARSERS = {"whatsapp": whatsapp, "telegram": telegram, "instagram": instagram, "facebook": facebook, "csv": delimited}


def parse(files: DataFrame, platform: str | None = None) -> DataFrame:
    """Messages of all files, each by its own platform's parser (or by the one named), with their measures.

    Files of which no platform is told with enough confidence raise an error when they are read.
    """
    if platform is not None:
        return measured(PARSERS[platform](files).withColumn("platform", F.lit(platform)))
    told = files.join(detect(files), "file")
    known = (F.col("platform") != "unknown") & (F.col("confidence") >= LEAST_CONFIDENCE)
    parts = [parser(told.where(known & (F.col("platform") == name)).select("file", "text")).withColumn("platform", F.lit(name)) for name, parser in PARSERS.items()]
    refused = F.raise_error(F.concat(F.lit("no known chat export: "), "file"))
    kinds = dict(parts[0].dtypes)
    parts.append(told.where(~known).select(*[(refused if c == "msg_id" else F.lit(None)).cast(k).alias(c) for c, k in kinds.items() if c not in ("file", "platform")], "file", "platform"))
    out = reduce(DataFrame.unionByName, parts)
    return measured(out)


def measured(m: DataFrame) -> DataFrame:
    """Adds counts, emoji and links."""
    c = F.col("content")
    return m.withColumns({"word_count": T.word_count(c), "char_count": T.char_count(c), "emojis": T.emojis(c), "has_emoji": F.size(T.emojis(c)) > 0, "has_url": T.has_link(c)})
