"""Message tables derived from the star schema's tables, in Spark and (for checks) in SQL.

The synthetic tables hold no chat exports, so their events, conversations and embeddings stand in for messages and
chunks: each derivation is a plain rule over a row's ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T

# What a message says, by the upper bound (not included) of a number derived from its id.
PHRASES = (
    (6, "you never listen, stop it"), (12, "whatever, I am so angry right now"), (16, "I am sorry, that was my fault"), (24, "love you so much 😍"),
    (30, "miss you, see you tonight?"), (36, "let's plan a movie night this weekend!"), (41, "I'll grab milk on my way"), (46, "got you a surprise for your birthday 🎉🎉"),
    (51, "big hugs and kisses 😘"), (58, "haha that is hilarious 😂😂"), (65, "did you finish the project report?"), (72, "check https://example.com/report tomorrow"),
    (80, "the weather looks great for hiking"), (86, "ok"), (90, "this is serious, enough already"), (95, "kya hai yaar, nahi pata mujhe"), (101, ""),
)

_PHRASE_CASE = "CASE " + " ".join("WHEN h < {} THEN '{}'".format(n, p.replace("'", "''")) for n, p in PHRASES) + " END"


def messages_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each event, ten conversations of three senders; sentiment and emotion are functions of the id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    rows = e.selectExpr(
        "user_id % 10 AS upload_id", "event_id", "(event_id * 7919) % 101 AS h", "(event_id * 104729) % 97 AS g",
        "CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS INT) AS msg_index",
    )
    case = "CASE " + " ".join('WHEN h < {} THEN "{}"'.format(n, p) for n, p in PHRASES) + " END"
    rows = rows.selectExpr(
        "upload_id", "msg_index", "concat('msg_', msg_index) AS msg_id", "element_at(array('Alice', 'Bob', 'Carol'), CAST(event_id % 3 + 1 AS INT)) AS sender",
        "timestampadd(MINUTE, CAST(3 * msg_index + 800 * (msg_index div 37) + 4000 * (msg_index div 111) + 35 * (msg_index div 53) + upload_id AS INT), TIMESTAMP_NTZ '2024-01-01 08:00:00') AS timestamp",
        f"{case} AS content", "h >= 98 AS is_deleted", "CASE WHEN g % 7 <> 0 THEN ((g * 37) % 201 - 100) / 100D END AS sentiment_score",
        "element_at(array('joy', 'love', 'sadness', 'anger', 'fear', 'surprise', 'disgust', NULL, NULL), CAST(g % 9 + 1 AS INT)) AS emotion_label",
        "CASE WHEN g % 9 < 7 THEN ((g * 53) % 101) / 100D END AS emotion_score",
        "CASE WHEN event_id % 11 = 0 AND msg_index >= 3 THEN concat('msg_', msg_index - 1 - event_id % 3) END AS reply_to_id",
        "CASE WHEN h >= 98 THEN 'deleted' WHEN event_id % 53 = 0 THEN 'system' ELSE 'text' END AS msg_type", "event_id % 29 = 0 AS has_media",
    )
    c = F.col("content")
    label = F.when(F.col("sentiment_score") >= 0.05, "positive").when(F.col("sentiment_score") <= -0.05, "negative").when(F.col("sentiment_score").isNotNull(), "neutral")
    return rows.withColumns({
        "sentiment_label": label, "content_english": F.lit(None).cast("string"), "was_translated": F.lit(False), "original_language": F.lit(None).cast("string"),
        "word_count": T.word_count(c), "char_count": T.char_count(c), "emojis": T.emojis(c), "has_emoji": F.size(T.emojis(c)) > 0, "has_url": T.has_link(c),
    })


_EMOJI_SQL = T.EMOJI

#: The same as common table expressions: m has the columns that the queries use.
MESSAGES_SQL = f"""e0 AS (SELECT user_id % 10 AS upload_id, event_id, (event_id * 7919) % 101 AS h, (event_id * 104729) % 97 AS g,
  (row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1)::INT AS msg_index FROM events),
e1 AS (SELECT *, {_PHRASE_CASE} AS content FROM e0),
m AS (SELECT upload_id, msg_index, 'msg_' || msg_index AS msg_id, (['Alice', 'Bob', 'Carol'])[(event_id % 3 + 1)::INT] AS sender,
  TIMESTAMP '2024-01-01 08:00:00' + to_minutes((3 * msg_index + 800 * (msg_index // 37) + 4000 * (msg_index // 111) + 35 * (msg_index // 53) + upload_id)::BIGINT) AS "timestamp",
  content, h >= 98 AS is_deleted, CASE WHEN g % 7 <> 0 THEN ((g * 37) % 201 - 100) / 100.0::DOUBLE END AS sentiment_score,
  (['joy', 'love', 'sadness', 'anger', 'fear', 'surprise', 'disgust', NULL, NULL])[(g % 9 + 1)::INT] AS emotion_label,
  CASE WHEN g % 9 < 7 THEN ((g * 53) % 101) / 100.0::DOUBLE END AS emotion_score,
  CASE WHEN event_id % 11 = 0 AND msg_index >= 3 THEN 'msg_' || (msg_index - 1 - event_id % 3) END AS reply_to_id,
  CASE WHEN h >= 98 THEN 'deleted' WHEN event_id % 53 = 0 THEN 'system' ELSE 'text' END AS msg_type, event_id % 29 = 0 AS has_media,
  len(regexp_extract_all(content, '\\S+'))::INT AS word_count, length(content)::INT AS char_count, regexp_extract_all(content, '{_EMOJI_SQL}') AS emojis,
  regexp_matches(content, '(?i)\\b(?:https?://|www\\.)[^\\s<>"''\\)]+') AS has_url FROM e1)"""


def messages_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each turn; its role is the sender."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.selectExpr(
        "conv_id AS upload_id", "CAST(turn AS INT) AS msg_index", "concat('msg_', turn) AS msg_id", "role AS sender",
        "timestampadd(MINUTE, CAST(1440 * conv_id + 7 * turn AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS timestamp", "text AS content", "false AS is_deleted", "'text' AS msg_type",
        "CAST(NULL AS STRING) AS content_english",
    )


CONVERSATIONS_SQL = """mc AS (SELECT conv_id AS upload_id, turn::INT AS msg_index, 'msg_' || turn AS msg_id, role AS sender,
  TIMESTAMP '2024-01-01' + to_minutes((1440 * conv_id + 7 * turn)::BIGINT) AS "timestamp", text AS content FROM conversations)"""


def uploads_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_set("role")).alias("participants"), F.count("*").alias("total_messages"))
    return rows.selectExpr(
        "id", "concat('chat_', id, '.txt') AS filename", "participants", "total_messages", "timestampadd(HOUR, CAST(id AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS created_at",
        "element_at(array('pending', 'parsing', 'nlp_processing', 'embedding', 'done', 'failed'), CAST(id % 6 + 1 AS INT)) AS status",
    )


UPLOADS_SQL = """u AS (SELECT conv_id AS id, 'chat_' || conv_id || '.txt' AS filename, list_sort(list_distinct(list(role))) AS participants, count(*) AS total_messages,
  TIMESTAMP '2024-01-01' + to_hours(conv_id) AS created_at, (['pending', 'parsing', 'nlp_processing', 'embedding', 'done', 'failed'])[(conv_id % 6 + 1)::INT] AS status FROM conversations GROUP BY conv_id)"""


def chunks_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of fifteen messages, every thirteen, with a vector each."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.selectExpr("vec_id", "vec_id % 5 AS upload_id", "CAST(vec_id div 5 AS INT) AS chunk_index", "CAST(13 * (vec_id div 5) AS INT) AS start_msg_index", "CAST(13 * (vec_id div 5) + 14 AS INT) AS end_msg_index", "embedding")


CHUNKS_SQL = """v AS (SELECT vec_id, vec_id % 5 AS upload_id, (vec_id // 5)::INT AS chunk_index, (13 * (vec_id // 5))::INT AS start_msg_index, (13 * (vec_id // 5) + 14)::INT AS end_msg_index, embedding FROM embeddings)"""
