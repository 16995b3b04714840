"""The queries of the catalogue in SQL, for checks. Messages, chunks and uploads are common table expressions."""

from __future__ import annotations

from parlance.operators import conflict, entities, health, language, love
from parlance.operators.stats import EMOTIONS
from parlance.sources.fixtures import CHUNKS_SQL, CONVERSATIONS_SQL, MESSAGES_SQL, UPLOADS_SQL

ORACLE_SQL: dict[str, str] = {}


def add(name: str, body: str, *tables: str) -> None:
    ORACLE_SQL[name] = "WITH RECURSIVE " + ",\n".join(t for t in tables if t) + "\n" + body


def messages(name: str, body: str, *more: str) -> None:
    add(name, body, MESSAGES_SQL, *more)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def re2(pattern: str) -> str:
    return pattern.replace("'", "''")


# The words of the messages (they say few things, see fixtures) that the two lists of stopwords hold, told here by hand.
SHORT = quoted("you it am so now that was my much this on got for your and haha is did the ok".split())
STOP = SHORT + ", " + quoted("never sorry see way tomorrow great".split())
TOKENS = "regexp_extract_all(lower({}), '[A-Za-z][A-Za-z'']{{1,}}')"
NO_LINKS = "regexp_replace({}, '(?i)https?://\\S+|www\\.\\S+', ' ', 'g')"
MINUTES = "((epoch_us({0}) - epoch_us({1})) / 60000000.0)"
DISTINCT_UPLOADS = "up AS (SELECT DISTINCT upload_id FROM m)"


def top(inner: str, keys: str, order: str, k: int, columns: str, rank: bool = True) -> str:
    return f"SELECT {columns}{', rank' if rank else ''} FROM (SELECT *, (row_number() OVER (PARTITION BY {keys} ORDER BY {order}))::INT AS rank FROM ({inner})) WHERE rank <= {k}"


messages("S09_ordered_scan", "SELECT upload_id, msg_index, msg_id, sender, content, sentiment_score FROM m WHERE NOT is_deleted")
STRIDE = "SELECT {1} FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY msg_index) - 1 AS rn, count(*) OVER (PARTITION BY upload_id) AS n FROM {0}) WHERE n <= 200 OR list_contains(list_transform(range(200), lambda i: floor(i * n / 200.0::DOUBLE)::BIGINT), rn)"
messages("S12_stride_sample", STRIDE.format("m", "upload_id, msg_index"))
add("S14_upload_page", "SELECT id, filename, total_messages, created_at, (SELECT count(*) FROM u) AS total FROM u ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 10", UPLOADS_SQL)
messages("F13_model_input", "SELECT upload_id, msg_index FROM m WHERE NOT is_deleted AND msg_type NOT IN ('deleted', 'system') AND trim(content) <> '' AND (NOT has_media OR length(trim(content)) >= 10) AND word_count >= 3 AND length(content) >= 10")
messages("F20_keyword_rich", f"SELECT upload_id, msg_index, len(list_filter(list_distinct({TOKENS.format('content')}), lambda w: w NOT IN ({STOP}))) >= 5 AS rich FROM m")
messages("F21_previews", "SELECT upload_id, msg_index, CASE WHEN length(trim(content)) > 20 THEN rtrim(left(trim(content), 20)) || '…' ELSE trim(content) END AS preview FROM m WHERE content <> ''")
add("F22_display_name", """SELECT id, CASE len(participants) WHEN 0 THEN regexp_replace(filename, '\\.[^.]*$', '') WHEN 1 THEN participants[1] WHEN 2 THEN participants[1] || ' & ' || participants[2]
  ELSE array_to_string(participants, ', ') END AS name FROM u""", UPLOADS_SQL)
messages("F23_analyzable", "SELECT upload_id, count(*) FILTER (len(regexp_extract_all(content, '\\w+')) >= 3 AND NOT is_deleted) AS analyzable, count(*) AS messages FROM m GROUP BY 1")

add("J07_chunk_messages", "SELECT v.upload_id, chunk_index, count(*) AS messages, min(msg_index) AS lo, max(msg_index) AS hi FROM v JOIN m ON m.upload_id = v.upload_id AND msg_index BETWEEN start_msg_index AND end_msg_index GROUP BY 1, 2", MESSAGES_SQL, CHUNKS_SQL)
add("J08_message_chunk", "SELECT v.upload_id, msg_index, min(chunk_index) AS chunk_index FROM v JOIN m ON m.upload_id = v.upload_id AND msg_index BETWEEN start_msg_index AND end_msg_index GROUP BY 1, 2", MESSAGES_SQL, CHUNKS_SQL)
add("J09_new_chunks", "SELECT upload_id, chunk_index FROM v WHERE chunk_index % 3 <> 0", CHUNKS_SQL)

messages("A01_overview_totals", """SELECT upload_id, count(*) AS total_messages, sum(word_count)::BIGINT AS total_words, sum(char_count)::BIGINT AS total_chars, sum(len(emojis))::BIGINT AS total_emojis,
  count(DISTINCT "timestamp"::DATE) AS active_days, round(count(*) / count(DISTINCT "timestamp"::DATE), 2) AS messages_per_day FROM m GROUP BY 1""")
messages("A03_date_stats", """SELECT upload_id, count(*) AS active_days, (max(d) - min(d) + 1)::BIGINT AS conversation_days, (SELECT max(n) FROM (SELECT upload_id AS u, count(*) AS n FROM r GROUP BY upload_id, isl) WHERE u = upload_id) AS longest_streak,
  coalesce(max(gap), 0)::BIGINT AS longest_silence FROM r GROUP BY 1""",
    """d AS (SELECT DISTINCT upload_id, "timestamp"::DATE AS d FROM m)""", """r AS (SELECT *, d - (row_number() OVER w)::INT AS isl, d - lag(d) OVER w AS gap FROM d WINDOW w AS (PARTITION BY upload_id ORDER BY d))""")
HOURS = """SELECT up.upload_id, h::INT AS hour, count(x.upload_id) AS messages FROM up CROSS JOIN range(24) t(h) LEFT JOIN {0} x ON x.upload_id = up.upload_id AND hour(x."timestamp") = h GROUP BY 1, 2"""
messages("A04_hour_histogram", HOURS.format("m"), DISTINCT_UPLOADS)
messages("A05_busiest", top("""SELECT upload_id, part, value, count(*) AS messages FROM (SELECT upload_id, 'hour' AS part, hour("timestamp")::VARCHAR AS value FROM m UNION ALL
  SELECT upload_id, 'weekday', (isodow("timestamp") - 1)::VARCHAR FROM m UNION ALL SELECT upload_id, 'month', strftime("timestamp", '%Y-%m') FROM m) GROUP BY ALL""", "upload_id, part", "messages DESC, length(value), value", 1, "upload_id, part, value, messages", False))
GAPS = f"""g AS (SELECT *, {MINUTES.format('"timestamp"', 'since')} AS minutes FROM (SELECT upload_id, sender, "timestamp", lag(sender) OVER w AS before, lag("timestamp") OVER w AS since FROM m WINDOW w AS (PARTITION BY upload_id ORDER BY "timestamp", msg_index))
  WHERE before <> sender AND {MINUTES.format('"timestamp"', 'since')} < 1440)"""
messages("A06_median_response", "SELECT up.upload_id, round(quantile_cont(minutes, 0.5), 2) AS median_minutes FROM up LEFT JOIN g USING (upload_id) GROUP BY 1", DISTINCT_UPLOADS, GAPS)
messages("W03_response_gaps", 'SELECT upload_id, sender, "timestamp", round(minutes, 6) AS minutes FROM g', GAPS)
messages("A07_who_texts_first", """SELECT upload_id, sender, count(*) AS days, round(count(*) / sum(count(*)) OVER (PARTITION BY upload_id), 4) AS share FROM
  (SELECT *, row_number() OVER (PARTITION BY upload_id, "timestamp"::DATE ORDER BY "timestamp", msg_index) AS n FROM m) WHERE n = 1 GROUP BY 1, 2""")
messages("A08_participants", r"""SELECT upload_id, sender, count(*) AS messages, sum(word_count)::BIGINT AS words, sum(char_count)::BIGINT AS chars, sum(len(emojis))::BIGINT AS emojis,
  count(*) FILTER (regexp_matches(content, '\?\s*$')) AS questions, count(*) FILTER (regexp_matches(content, '!\s*$')) AS exclamations, round(sum(char_count) / count(*), 2) AS avg_length FROM m GROUP BY 1, 2""")
messages("A09_longest_message", top("SELECT *, left(content, 280) AS preview FROM m WHERE NOT is_deleted", "upload_id", "char_count DESC, msg_index", 1, "upload_id, msg_id, sender, char_count, preview", False))
messages("A10_most_replied_to", "SELECT r.upload_id, r.msg_id, r.replies, m.sender, left(m.content, 280) AS preview FROM (" + top("SELECT upload_id, reply_to_id AS msg_id, count(*) AS replies FROM m WHERE reply_to_id IS NOT NULL GROUP BY 1, 2", "upload_id", "replies DESC, msg_id", 1, "upload_id, msg_id, replies", False) + ") r JOIN m ON m.upload_id = r.upload_id AND m.msg_id = r.msg_id")
messages("A11_first_message", top("SELECT *, left(content, 280) AS preview FROM m", "upload_id", '"timestamp", msg_index', 1, 'upload_id, msg_id, sender, "timestamp", preview', False))
STATS_WORDS = f"""w AS (SELECT upload_id, sender, msg_index, pos, token FROM (SELECT upload_id, sender, msg_index, is_deleted, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM
  (SELECT *, list_filter({TOKENS.format('content')}, lambda x: x NOT IN ({SHORT})) AS t FROM m)) WHERE NOT is_deleted)"""
EMOJI_ROWS = "em AS (SELECT upload_id, sender, msg_index, sentiment_score, unnest(emojis) AS token, generate_subscripts(emojis, 1) - 1 AS pos FROM m WHERE NOT is_deleted)"
messages("A12_favourite_tokens", top("""SELECT upload_id, sender, kind, token, sum(n)::BIGINT AS uses, min(pl) AS pl FROM (SELECT upload_id, unnest([sender, NULL]) AS sender, kind, token, count(*) AS n, min(msg_index * 1000 + pos) AS pl FROM
  (SELECT upload_id, sender, msg_index, pos, token, 'word' AS kind FROM w UNION ALL SELECT upload_id, sender, msg_index, pos, token, 'emoji' FROM em) GROUP BY upload_id, sender, kind, token) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY upload_id, sender, kind, token"), "upload_id, sender, kind", "uses DESC, pl", 1, "upload_id, sender, kind, token, uses", False), STATS_WORDS, EMOJI_ROWS)
messages("A13_participant_dive", f"""SELECT upload_id, sender, count(*) AS messages, round(avg(sentiment_score), 3) + 0.0 AS avg_sentiment,
  count(*) FILTER (sentiment_score >= 0.05) AS positive, count(*) FILTER (sentiment_score > -0.05 AND sentiment_score < 0.05) AS neutral, count(*) FILTER (sentiment_score <= -0.05) AS negative,
  {', '.join(f"count(*) FILTER (emotion_label = '{e}') AS {e}" for e in EMOTIONS)}, arg_min(msg_id, msg_index) AS first_msg, arg_max(msg_id, msg_index) AS last_msg FROM m GROUP BY 1, 2""")
messages("A13_participant_hours", """SELECT s.upload_id, s.sender, h::INT AS hour, count(m.upload_id) AS messages FROM (SELECT DISTINCT upload_id, sender FROM m) s CROSS JOIN range(24) t(h)
  LEFT JOIN m ON m.upload_id = s.upload_id AND m.sender = s.sender AND hour(m."timestamp") = h GROUP BY 1, 2, 3""")
messages("A13_participant_words", top("SELECT upload_id, sender, token AS word, count(*) AS uses, min(msg_index * 1000 + pos) AS pl FROM w GROUP BY 1, 2, 3", "upload_id, sender", "uses DESC, pl", 10, "upload_id, sender, word, uses"), STATS_WORDS)


def dominant(unit: str, name: str = "dom") -> str:
    return f"""{name} AS (SELECT upload_id, bucket, emotion_label AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY upload_id, bucket ORDER BY n DESC, emotion_label) AS k FROM
  (SELECT upload_id, date_trunc('{unit}', "timestamp")::DATE AS bucket, emotion_label, count(*) AS n FROM m WHERE emotion_label IS NOT NULL GROUP BY 1, 2, 3)) WHERE k = 1)"""


for unit in ("day", "week", "month"):
    messages(f"A14_timeline_{unit}", f"""SELECT s.upload_id, s.bucket, s.sender, s.sender_messages, s.sender_sentiment, b.messages, b.sentiment, dominant FROM
  (SELECT upload_id, date_trunc('{unit}', "timestamp")::DATE AS bucket, sender, count(*) AS sender_messages, round(avg(sentiment_score), 9) + 0.0 AS sender_sentiment FROM m GROUP BY 1, 2, 3) s JOIN
  (SELECT upload_id, date_trunc('{unit}', "timestamp")::DATE AS bucket, count(*) AS messages, round(avg(sentiment_score), 9) + 0.0 AS sentiment FROM m GROUP BY 1, 2) b USING (upload_id, bucket) LEFT JOIN dom USING (upload_id, bucket)""", dominant(unit))
for name, keys in (("A15_emotion_distribution", "upload_id"), ("A16_emotion_by_sender", "upload_id, sender")):
    messages(name, f"""SELECT {keys}, emotion_label, n, round(CASE WHEN sum(n) OVER (PARTITION BY {keys}) > 0 THEN n / sum(n) OVER (PARTITION BY {keys}) ELSE 0 END, 4) AS share FROM
  (SELECT * REPLACE (coalesce(n, 0) AS n) FROM (SELECT DISTINCT {keys}, unnest([{quoted(EMOTIONS)}]) AS emotion_label FROM m) LEFT JOIN (SELECT {keys}, emotion_label, count(*) AS n FROM m GROUP BY ALL) USING ({keys}, emotion_label))""")
for name, keys in (("A15_emotion_samples", "upload_id, emotion_label"), ("A16_emotion_samples_by_sender", "upload_id, sender, emotion_label")):
    messages(name, top("SELECT * FROM m WHERE emotion_label IS NOT NULL AND NOT is_deleted AND content <> ''", keys, 'emotion_score DESC NULLS LAST, "timestamp", msg_index', 2, f"{keys}, msg_id, emotion_score"))
PEAKS = ["""wk AS (SELECT upload_id, date_trunc('week', "timestamp")::DATE AS bucket, round(avg(sentiment_score), 6) + 0.0 AS sentiment, count(*) AS scored FROM m WHERE sentiment_score IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5)""", dominant("week"),
    "pk AS (SELECT upload_id, bucket, sentiment, scored, dominant, bucket + 6 AS bucket_end, kind, rank::INT AS rank FROM (SELECT *, 'peak' AS kind, row_number() OVER (PARTITION BY upload_id ORDER BY sentiment DESC, bucket) AS rank FROM wk LEFT JOIN dom USING (upload_id, bucket) UNION ALL SELECT *, 'valley', row_number() OVER (PARTITION BY upload_id ORDER BY sentiment, bucket) FROM wk LEFT JOIN dom USING (upload_id, bucket)) WHERE rank <= 5)"]
messages("A17_peaks", "SELECT * FROM pk", *PEAKS)
messages("A17_peak_messages", top("""SELECT m.*, pk.bucket, kind FROM m JOIN pk ON pk.upload_id = m.upload_id AND pk.bucket = date_trunc('week', "timestamp")::DATE WHERE NOT is_deleted AND content <> ''""", "upload_id, bucket, kind", """CASE WHEN kind = 'peak' THEN -sentiment_score ELSE sentiment_score END NULLS LAST, "timestamp", msg_index""", 3, "upload_id, bucket, kind, msg_id, sentiment_score"), *PEAKS)
CALENDAR = [dominant("day"), """dy AS (SELECT upload_id, "timestamp"::DATE AS bucket, round(avg(sentiment_score), 4) + 0.0 AS sentiment, count(*) AS messages FROM m GROUP BY 1, 2)""",
    "cal AS (SELECT upload_id, bucket, sentiment, coalesce(messages, 0) AS messages, dominant FROM (SELECT upload_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 DAY))::DATE AS bucket FROM dy GROUP BY upload_id) LEFT JOIN dy USING (upload_id, bucket) LEFT JOIN dom USING (upload_id, bucket))"]
messages("A18_calendar", "SELECT * FROM cal", *CALENDAR)
messages("A18_extreme_days", "SELECT upload_id, arg_min(bucket, (-sentiment, bucket)) AS happiest, arg_min(bucket, (sentiment, bucket)) AS hardest FROM cal WHERE sentiment IS NOT NULL AND messages >= 3 GROUP BY 1", *CALENDAR)
messages("A48_week_grid", "SELECT upload_id, date_trunc('week', bucket)::DATE AS week, (isodow(bucket) - 1)::INT AS weekday, messages FROM cal", *CALENDAR)

TOK = f"""t AS (SELECT upload_id, sender, msg_index, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT *, {TOKENS.format(NO_LINKS.format('content'))} AS t FROM m WHERE NOT is_deleted))"""
TC = f"tc AS (SELECT upload_id, sender, word, count(*) AS n, min(msg_index * 1000 + pos) AS pl, word IN ({STOP}) AS is_stop FROM t GROUP BY 1, 2, 3)"
messages("A19_corpus_scan", "SELECT upload_id, sender, sum(n)::BIGINT AS tokens, count(*) AS distinct_words, count(*) FILTER (NOT is_stop) AS distinct_content_words FROM tc GROUP BY 1, 2", TOK, TC)
messages("A20_word_frequency", "SELECT f.upload_id, f.rank, f.word, f.uses, f.share, tc.sender, tc.n AS by_sender FROM (" + top("SELECT upload_id, word, uses, pl, share FROM (SELECT upload_id, word, is_stop, sum(n)::BIGINT AS uses, min(pl) AS pl, round(sum(n) / sum(sum(n)) OVER (PARTITION BY upload_id), 6) AS share FROM tc GROUP BY 1, 2, 3) WHERE NOT is_stop", "upload_id", "uses DESC, pl", 20, "upload_id, word, uses, share") + ") f JOIN tc USING (upload_id, word)", TOK, TC)
messages("A22_richness", "SELECT upload_id, sender, count(*) FILTER (NOT is_stop) AS unique_words, sum(n)::BIGINT AS tokens, round(count(*) FILTER (NOT is_stop) / sum(n), 4) AS richness FROM tc GROUP BY 1, 2", TOK, TC)
messages("A23_distinctive", "SELECT upload_id, sender, word, uses, total, round(score, 6) AS score, rank FROM (" + top("SELECT *, n AS uses, n / total AS score FROM (SELECT *, sum(n) OVER (PARTITION BY upload_id, word)::BIGINT AS total FROM tc WHERE NOT is_stop) WHERE total >= 5", "upload_id, sender", "score DESC, n DESC, word", 12, "upload_id, sender, word, uses, total, score") + ")", TOK, TC)
messages("A48_dominant_sender", top("SELECT upload_id, word, sum(n)::BIGINT AS uses, min(pl) AS pl, arg_min(sender, (-n, sender)) AS sender FROM tc WHERE NOT is_stop GROUP BY 1, 2", "upload_id", "uses DESC, pl", 20, "upload_id, word, uses, sender"), TOK, TC)
BG = f"bg AS (SELECT upload_id, sender, word || ' ' || nxt AS bigram, count(*) AS n, min(msg_index * 1000 + pos) AS pl FROM (SELECT *, lead(word) OVER (PARTITION BY upload_id, msg_index ORDER BY pos) AS nxt FROM t) WHERE nxt IS NOT NULL AND word NOT IN ({STOP}) AND nxt NOT IN ({STOP}) GROUP BY 1, 2, 3)"
messages("A21_bigrams", top("SELECT upload_id, bigram, sum(n)::BIGINT AS uses, min(pl) AS pl FROM bg GROUP BY 1, 2", "upload_id", "uses DESC, pl", 20, "upload_id, bigram, uses"), TOK, BG)
messages("A21_inside_phrases", top("SELECT upload_id, bigram, sum(n)::BIGINT AS uses, min(pl) AS pl FROM bg GROUP BY 1, 2 HAVING count(*) FILTER (n >= 3) = (SELECT count(DISTINCT sender) FROM bg b WHERE b.upload_id = bg.upload_id) AND (SELECT count(DISTINCT sender) FROM bg b WHERE b.upload_id = bg.upload_id) >= 2", "upload_id", "uses DESC, pl", 16, "upload_id, bigram, uses"), TOK, BG)
EMOJI_NAMES = "CASE {0} WHEN '😍' THEN 'SMILING FACE WITH HEART-SHAPED EYES' WHEN '🎉' THEN 'PARTY POPPER' WHEN '😘' THEN 'FACE THROWING A KISS' WHEN '😂' THEN 'FACE WITH TEARS OF JOY' END"
messages("X27_emoji_names", f"SELECT DISTINCT emoji, {EMOJI_NAMES.format('emoji')} AS name FROM (SELECT unnest(emojis) AS emoji FROM m)")
LENGTHS = """SELECT upload_id, "timestamp"::DATE AS day, sender, round(avg(char_count), 2) AS avg_length FROM m WHERE NOT is_deleted AND content <> '' GROUP BY 1, 2, 3"""
messages("A24_length_timeline", LENGTHS)
messages("A47_wide_timeline", f"SELECT upload_id, day, {', '.join(f'''max(avg_length) FILTER (sender = '{s}') AS {s}''' for s in ('Alice', 'Bob', 'Carol'))} FROM ({LENGTHS}) GROUP BY 1, 2".replace("AS Alice", 'AS "Alice"').replace("AS Bob", 'AS "Bob"').replace("AS Carol", 'AS "Carol"'))
messages("A25_emoji_frequency", "SELECT upload_id, token AS emoji, count(*) AS uses, round(avg(sentiment_score), 4) + 0.0 AS avg_sentiment, round(count(*) / sum(count(*)) OVER (PARTITION BY upload_id), 6) AS share, " + EMOJI_NAMES.format("token") + " AS unicode_name FROM em GROUP BY 1, 2", EMOJI_ROWS)
messages("A25_emoji_by_sender", "SELECT upload_id, token AS emoji, sender, count(*) AS uses FROM em GROUP BY 1, 2, 3", EMOJI_ROWS)
messages("A25_emoji_of_one_sender", top("SELECT upload_id, emoji, sender, n, round(n / total, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY upload_id, emoji) AS total FROM (SELECT upload_id, token AS emoji, sender, count(*) AS n FROM em GROUP BY 1, 2, 3)) WHERE total >= 5 AND n / total >= 0.7", "upload_id, sender", "n DESC, emoji", 12, "upload_id, sender, emoji, n, share"), EMOJI_ROWS)
messages("A26_word_trend", r"""SELECT upload_id, "timestamp"::DATE AS day, count(*) AS messages FROM m WHERE NOT is_deleted AND regexp_matches(lower(content), '\blove\b') GROUP BY 1, 2""")
NIGHT = 'hour("timestamp") IN (23, 0, 1, 2, 3, 4)'
messages("A27_late_night", f"""SELECT upload_id, sender, hour("timestamp")::INT AS hour, count(*) AS messages, any_value(at_night) AS at_night, round(any_value(at_night) / any_value(total), 6) AS night_share FROM
  (SELECT *, count(*) FILTER ({NIGHT}) OVER (PARTITION BY upload_id) AS at_night, count(*) OVER (PARTITION BY upload_id) AS total FROM m) WHERE {NIGHT} GROUP BY 1, 2, 3""")
messages("A27_late_night_samples", top(f"SELECT * FROM m WHERE NOT is_deleted AND content <> '' AND {NIGHT}", "upload_id", 'abs(coalesce(sentiment_score, 0)) DESC, "timestamp" DESC, msg_index', 6, "upload_id, msg_id, sentiment_score"))

ROLL = f"""r0 AS (SELECT *, row_number() OVER w AS rn, avg(sentiment_score) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS roll FROM m WHERE NOT is_deleted WINDOW w AS (PARTITION BY upload_id ORDER BY msg_index)),
r AS (SELECT *, coalesce(roll < -0.3, false) OR coalesce(emotion_label = 'anger' AND emotion_score > 0.6, false) OR regexp_matches(lower(content), '{conflict.KEYWORD_PATTERN}') AS sign,
  regexp_matches(content, '{re2(conflict.APOLOGY)}') AS apology,
  coalesce(roll > 0.2, false) AND coalesce(lead(roll > 0.2) OVER w, false) AND coalesce(lead(roll > 0.2, 2) OVER w, false) AS calm3 FROM r0 WINDOW w AS (PARTITION BY upload_id ORDER BY rn))"""
RUNS = """k0 AS (SELECT *, rn - row_number() OVER (PARTITION BY upload_id ORDER BY rn) AS isl FROM r WHERE sign),
k AS (SELECT upload_id, count(*) AS messages, min(rn) AS lo, max(rn) AS hi, min("timestamp") AS start_ts, max("timestamp") AS end_ts, arg_min(msg_index, rn) AS first_index, arg_max(msg_index, rn) AS last_index,
  arg_min(sender, rn) AS trigger_sender, arg_min(content, rn) AS trigger, arg_min(msg_id, rn) AS trigger_id, round(coalesce(min(sentiment_score), -0.3), 4) AS worst, floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 60000000)::BIGINT AS duration_minutes,
  'w_' || arg_min(msg_index, rn) || '_' || arg_max(msg_index, rn) AS window_id FROM k0 GROUP BY upload_id, isl HAVING count(*) >= 3)"""
RES = """f AS (SELECT k.upload_id, k.window_id, r.rn, r.msg_index, r.sender, r.apology, r.calm3, r.rn - k.hi AS d, greatest(0, floor((epoch_us(r."timestamp") - epoch_us(k.end_ts)) / 60000000))::BIGINT AS minutes FROM k JOIN r ON r.upload_id = k.upload_id AND r.rn BETWEEN k.hi + 1 AND k.hi + 20),
h AS (SELECT *, CASE WHEN apology AND d <= 5 THEN 1 WHEN d = 1 AND minutes >= 720 THEN 2 WHEN calm3 AND d <= 18 THEN 3 END AS c FROM f),
hh AS (SELECT upload_id, window_id, unnest([CASE WHEN apology AND d <= 5 THEN 1 END, CASE WHEN d = 1 AND minutes >= 720 THEN 2 END, CASE WHEN calm3 AND d <= 18 THEN 3 END]) AS c, rn, msg_index, sender, minutes FROM f),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upload_id, window_id ORDER BY c, rn) AS n FROM hh WHERE c IS NOT NULL) WHERE n = 1),
rs AS (SELECT k.upload_id, k.window_id, start_ts, trigger, trigger_sender, duration_minutes, worst, coalesce((['apology', 'time_gap', 'topic_change'])[b.c], 'unresolved') AS resolution, b.msg_index AS resolved_index, b.sender AS resolved_by, b.minutes AS minutes_after FROM k LEFT JOIN b USING (upload_id, window_id))"""
CW = f"""cw AS (SELECT k.upload_id, k.window_id, r.rn, p.part, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos FROM k CROSS JOIN (VALUES ('during'), ('after')) p(part) JOIN (SELECT *, {TOKENS.format(NO_LINKS.format('content'))} AS t FROM r) r
  ON r.upload_id = k.upload_id AND CASE WHEN p.part = 'during' THEN r.rn BETWEEN k.lo AND k.hi ELSE r.rn BETWEEN k.hi + 1 AND k.hi + 5 END),
cs AS (SELECT * FROM cw WHERE word NOT IN ({STOP})),
tw AS (""" + top("SELECT upload_id, window_id, word, count(*) AS uses, min(rn * 1000 + pos) AS pl FROM cs WHERE part = 'during' GROUP BY 1, 2, 3", "upload_id, window_id", "uses DESC, pl", 8, "upload_id, window_id, word, uses") + "),\ncl AS (" + top("SELECT upload_id, part, word, count(*) AS uses FROM cs GROUP BY 1, 2, 3", "upload_id, part", "uses DESC, word", 40, "upload_id, part, word, uses") + ")"
messages("W08_rolling", "SELECT upload_id, msg_index, round(roll, 6) + 0.0 AS roll, sign, apology, calm3 FROM r", ROLL)
messages("A28_conflict_windows", "SELECT * REPLACE (lo::INT AS lo, hi::INT AS hi) FROM k", ROLL, RUNS)
messages("A28_conflict_top_words", "SELECT * FROM tw", ROLL, RUNS, CW)
messages("A28_conflict_samples", top("""SELECT upload_id, window_id, msg_index, min(p) AS p FROM (SELECT upload_id, window_id, msg_index, unnest([CASE WHEN a = 1 THEN 1 END, CASE WHEN w = 1 THEN 2 END, CASE WHEN s <= 2 THEN 2 + s END, CASE WHEN z = 1 THEN 5 END]) AS p FROM
  (SELECT k.upload_id, window_id, msg_index, row_number() OVER (PARTITION BY k.upload_id, window_id ORDER BY rn) AS a, row_number() OVER (PARTITION BY k.upload_id, window_id ORDER BY rn DESC) AS z,
   row_number() OVER (PARTITION BY k.upload_id, window_id ORDER BY coalesce(sentiment_score, 1), rn) AS w, row_number() OVER (PARTITION BY k.upload_id, window_id ORDER BY coalesce(emotion_score, 0) DESC, rn) AS s
   FROM k JOIN r ON r.upload_id = k.upload_id AND r.rn BETWEEN lo AND hi)) WHERE p IS NOT NULL GROUP BY 1, 2, 3""", "upload_id, window_id", "p", 5, "upload_id, window_id, msg_index"), ROLL, RUNS)
messages("A29_conflict_resolution", "SELECT * FROM rs", ROLL, RUNS, RES)
SUMMARY = "cf AS (SELECT upload_id, count(*) AS conflicts, round(avg(duration_minutes / 60), 4) AS avg_duration_hours, round(avg(minutes_after / 60) FILTER (resolution <> 'unresolved'), 4) AS avg_recovery_hours, count(*) FILTER (resolution <> 'unresolved') AS resolved FROM rs GROUP BY 1)"
messages("A30_conflict_summary", "SELECT * FROM cf", ROLL, RUNS, RES, SUMMARY)
messages("A30_conflict_triggers", top(f"""SELECT upload_id, trigger, count(*) AS runs FROM (SELECT k.upload_id, unnest(CASE WHEN len(regexp_extract_all(lower(left(trigger, 280)), '{conflict.KEYWORD_PATTERN}')) > 0 THEN regexp_extract_all(lower(left(trigger, 280)), '{conflict.KEYWORD_PATTERN}') WHEN tw.word IS NOT NULL THEN [tw.word] ELSE [] END) AS trigger
  FROM k LEFT JOIN tw ON tw.upload_id = k.upload_id AND tw.window_id = k.window_id AND tw.rank = 1) GROUP BY 1, 2""", "upload_id", "runs DESC, trigger", 5, "upload_id, trigger, runs"), ROLL, RUNS, CW)
messages("A30_conflict_roles", top("SELECT *, sum(n) OVER (PARTITION BY upload_id, role)::BIGINT AS total FROM (SELECT upload_id, role, sender, count(*) AS n FROM (SELECT upload_id, 'escalates' AS role, trigger_sender AS sender FROM rs UNION ALL SELECT upload_id, 'resolves', resolved_by FROM rs WHERE resolution <> 'unresolved' AND resolved_by IS NOT NULL) GROUP BY 1, 2, 3)", "upload_id, role", "n DESC, sender", 1, "upload_id, role, sender, n, total", False), ROLL, RUNS, RES)
messages("A30_conflict_months", "SELECT upload_id, strftime(start_ts, '%Y-%m') AS month, count(*) AS conflicts FROM k GROUP BY 1, 2", ROLL, RUNS)
messages("A31_conflict_language", "SELECT * FROM cl", ROLL, RUNS, CW)
messages("A31_conflict_starts", """SELECT up.upload_id, s.part, s.value::INT AS value, count(x.upload_id) AS n FROM up CROSS JOIN (SELECT 'hour' AS part, range AS value FROM range(24) UNION ALL SELECT 'weekday', range FROM range(7)) s LEFT JOIN
  (SELECT upload_id, 'hour' AS part, hour(start_ts) AS value FROM k UNION ALL SELECT upload_id, 'weekday', isodow(start_ts) - 1 FROM k) x ON x.upload_id = up.upload_id AND x.part = s.part AND x.value = s.value GROUP BY 1, 2, 3""", DISTINCT_UPLOADS, ROLL, RUNS)
# the keywords of a run's first message, told phrase by phrase; equal counts go to the one whose run and place come first
messages("A32_conflict_themes", """SELECT k.upload_id, coalesce('Around ' || chr(39) || any_value(b.word) || chr(39), 'Recurring tension') AS label, count(*) AS conflicts, round(avg(worst), 4) + 0.0 AS avg_peak, string_agg(window_id, ',' ORDER BY lo) AS window_ids,
  array_to_string(list(trigger_id ORDER BY lo)[1:3], ',') AS examples FROM k LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY n DESC, pl) AS q FROM (SELECT upload_id, word, count(*) AS n, min(lo * 1000 + pos) AS pl FROM
    (SELECT upload_id, lo, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT *, CASE WHEN trigger LIKE 'you never%' THEN ['never', 'stop'] WHEN trigger LIKE 'whatever%' THEN ['whatever', 'angry'] WHEN trigger LIKE 'I am sorry%' THEN ['sorry', 'fault']
      WHEN trigger LIKE 'this is serious%' THEN ['serious', 'enough'] END AS ws FROM k)) GROUP BY 1, 2)) WHERE q = 1) b ON b.upload_id = k.upload_id GROUP BY 1""", ROLL, RUNS)
messages("J14_named_themes", "SELECT upload_id, 'theme ' || first_index % 3 AS theme, count(*) AS conflicts, round(avg(worst), 4) + 0.0 AS avg_peak FROM k GROUP BY 1, 2", ROLL, RUNS)
messages("J13_conflict_arcs", "SELECT k.upload_id, window_id, msg_index, sentiment_score FROM k JOIN r ON r.upload_id = k.upload_id AND r.rn BETWEEN lo - 5 AND hi + 5", ROLL, RUNS)

LOVE_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(content), '{p.replace(chr(39), chr(39) * 2)}')" for p in ps) + f" THEN '{k}'" for k, ps in love.KINDS.items()) + " END"
LOVE = "lc0 AS (SELECT * FROM m WHERE NOT is_deleted AND content <> '' AND sentiment_score > 0.3 AND emotion_label IN ('joy', 'love')),\nlc AS (SELECT *, " + LOVE_KIND + " AS kind FROM (" + STRIDE.format("lc0", "*") + ")),\n" + f"""lr AS (SELECT upload_id, sender, place::INT AS place, kind, n, round(CASE WHEN sum(n) OVER (PARTITION BY upload_id, sender) > 0 THEN n / sum(n) OVER (PARTITION BY upload_id, sender) ELSE 0 END, 4) AS share FROM
  (SELECT s.upload_id, s.sender, p.place, p.kind, count(lc.upload_id) AS n FROM (SELECT DISTINCT upload_id, sender FROM m) s CROSS JOIN (SELECT unnest([{quoted(love.KINDS)}]) AS kind, unnest(range(5)) AS place) p LEFT JOIN lc ON lc.upload_id = s.upload_id AND lc.sender = s.sender AND lc.kind = p.kind GROUP BY 1, 2, 3, 4))"""
messages("J10_love_residual", "SELECT upload_id, msg_id, sender, left(content, 400) AS prompt FROM lc WHERE kind IS NULL", LOVE)
messages("A33_love_report", "SELECT * FROM lr", LOVE)
messages("J11_love_with_answers", "SELECT * FROM lr", LOVE.replace(LOVE_KIND + " AS kind", f"coalesce({LOVE_KIND}, ([{quoted(love.KINDS)}])[msg_index % 6 + 1]) AS kind"))
messages("A33_love_examples", top("SELECT * FROM lc WHERE kind IS NOT NULL", "upload_id, sender, kind", 'emotion_score DESC, "timestamp" DESC, msg_index', 3, "upload_id, sender, kind, msg_id"), LOVE)
messages("A33_love_summary", """SELECT upload_id, sender, CASE WHEN n1 > 0 THEN k1 END AS primary_kind, CASE WHEN n2 > 0 THEN k2 END AS secondary_kind,
  CASE WHEN n1 = 0 THEN sender || '''s expressions of love don''t lean strongly into any single category yet.' ELSE sender || ' primarily expresses love through ' || replace(k1, '_', ' ') || ' (' || round(s1 * 100)::INT || '%)' ||
  CASE WHEN n2 = 0 THEN '.' ELSE ' and ' || replace(k2, '_', ' ') || ' (' || round(s2 * 100)::INT || '%).' END END AS sentence FROM
  (SELECT upload_id, sender, max(kind) FILTER (q = 1) AS k1, max(n) FILTER (q = 1) AS n1, max(share) FILTER (q = 1) AS s1, max(kind) FILTER (q = 2) AS k2, max(n) FILTER (q = 2) AS n2, max(share) FILTER (q = 2) AS s2 FROM
   (SELECT *, row_number() OVER (PARTITION BY upload_id, sender ORDER BY share DESC, place) AS q FROM lr) GROUP BY 1, 2)""", LOVE)

HEALTH = {
    "communication_balance": "SELECT upload_id, CASE WHEN count(*) = 1 THEN 1.0 ELSE greatest(0, least(1, 1 - (max(n) / sum(n) - 1.0::DOUBLE / count(*)) / (1 - 1.0::DOUBLE / count(*)))) END AS score FROM (SELECT upload_id, sender, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1",
    "response_consistency": "SELECT up.upload_id, CASE WHEN count(minutes) < 5 THEN 0.5 WHEN avg(ln(1 + minutes)) <= 0 THEN 1 ELSE 1 - greatest(0, least(1, stddev_pop(ln(1 + minutes)) / avg(ln(1 + minutes)) / 1.5)) END AS score FROM up LEFT JOIN g USING (upload_id) GROUP BY 1",
    "sentiment_trend": """SELECT up.upload_id, CASE WHEN count(y) < 2 THEN 0.5 ELSE greatest(0, least(1, 0.5 + 5 * regr_slope(y, x))) END AS score FROM up LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY mo) - 1 AS x FROM (SELECT upload_id, date_trunc('month', "timestamp") AS mo, avg(sentiment_score) AS y FROM m WHERE sentiment_score IS NOT NULL GROUP BY 1, 2)) USING (upload_id) GROUP BY 1""",
    "conflict_recovery": "SELECT up.upload_id, CASE WHEN conflicts IS NULL THEN 1 WHEN avg_recovery_hours IS NULL THEN 0.4 ELSE 1 - greatest(0, least(1, avg_recovery_hours / 24)) END AS score FROM up LEFT JOIN cf USING (upload_id)",
    "affection_frequency": "SELECT upload_id, greatest(0, least(1, 5 * (count(*) FILTER (sentiment_score > 0.3 AND emotion_label IN ('joy', 'love')) / count(*)))) AS score FROM m WHERE NOT is_deleted GROUP BY 1",
    "engagement_depth": r"SELECT upload_id, (least(1, avg(word_count) / 15) + least(1, 8 * (count(*) FILTER (regexp_matches(content, '\?\s*$')) / count(*)))) / 2 AS score FROM m WHERE NOT is_deleted GROUP BY 1",
    "shared_activities": f"SELECT upload_id, greatest(0, least(1, 4 * avg(regexp_matches(content, '{re2(health.SHARED)}')::INT))) AS score FROM m WHERE NOT is_deleted GROUP BY 1",
}
HEALTH_TABLES = (DISTINCT_UPLOADS, GAPS, ROLL, RUNS, RES, SUMMARY)
for (factor, body), n in zip(HEALTH.items(), ("A34", "A35", "A36", "A37", "A38", "A39", "A40")):
    messages(f"{n}_health_{factor}", f"SELECT upload_id, round(score::DOUBLE, 6) AS score FROM ({body})", *HEALTH_TABLES)
HF = "hf AS (" + " UNION ALL ".join(f"SELECT upload_id, '{f}' AS factor, round(score::DOUBLE, 6) AS score, round(round(score::DOUBLE, 6) * {health.WEIGHTS[f]}::DOUBLE, 4) AS weighted FROM ({body})" for f, body in HEALTH.items()) + ")"
messages("A41_health_score", "SELECT *, CASE WHEN overall < 40 THEN 'red' WHEN overall < 70 THEN 'amber' ELSE 'green' END AS band FROM (SELECT upload_id, round(sum(weighted) * 100)::INT AS overall FROM hf GROUP BY 1)", *HEALTH_TABLES, HF)
RAW = """rv AS (SELECT upload_id, 'communication_balance' AS factor, string_agg(sender || ' ' || round_even(100 * n / total, 0)::INT || '%', ' · ' ORDER BY n DESC, sender) AS raw_value FROM (SELECT *, sum(n) OVER (PARTITION BY upload_id)::DOUBLE AS total FROM (SELECT upload_id, sender, count(*)::DOUBLE AS n FROM m GROUP BY 1, 2)) GROUP BY 1
  UNION ALL SELECT up.upload_id, 'response_consistency', CASE WHEN count(minutes) < 5 THEN 'insufficient data' ELSE printf('median %.1f min · variability %.2f', round(median(minutes), 1), round(CASE WHEN avg(ln(1 + minutes)) > 0 THEN stddev_pop(ln(1 + minutes)) / avg(ln(1 + minutes)) ELSE 0 END, 2)) END FROM up LEFT JOIN g USING (upload_id) GROUP BY 1
  UNION ALL SELECT up.upload_id, 'sentiment_trend', CASE WHEN count(y) < 2 THEN 'insufficient data' ELSE CASE WHEN regr_slope(y, x) >= 0 THEN '+' ELSE '' END || printf('%.3f sentiment/month', round(regr_slope(y, x), 3)) END FROM up LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY mo) - 1 AS x FROM
    (SELECT upload_id, date_trunc('month', "timestamp") AS mo, avg(sentiment_score) AS y FROM m WHERE sentiment_score IS NOT NULL GROUP BY 1, 2)) USING (upload_id) GROUP BY 1
  UNION ALL SELECT up.upload_id, 'conflict_recovery', CASE WHEN conflicts IS NULL THEN 'no difficult moments to measure' WHEN avg_recovery_hours IS NULL THEN conflicts || ' difficult moments, none resolved cleanly' ELSE printf('%.1f', round(avg_recovery_hours, 1)) || 'h avg over ' || conflicts || ' moments' END FROM up LEFT JOIN cf USING (upload_id)
  UNION ALL SELECT upload_id, 'affection_frequency', printf('%.1f', round(100 * (count(*) FILTER (sentiment_score > 0.3 AND emotion_label IN ('joy', 'love')) / count(*)), 1)) || '% of messages' FROM m WHERE NOT is_deleted GROUP BY 1
  UNION ALL SELECT upload_id, 'engagement_depth', printf('%.1f', round(avg(word_count), 1)) || ' words avg · ' || printf('%.1f', round(100 * (count(*) FILTER (content LIKE '%?') / count(*)), 1)) || '% questions' FROM m WHERE NOT is_deleted GROUP BY 1
  UNION ALL SELECT upload_id, 'shared_activities', printf('%.1f', round(100 * avg(regexp_matches(content, 'SHARED')::INT), 1)) || '% of messages reference shared time' FROM m WHERE NOT is_deleted GROUP BY 1)""".replace("SHARED", re2(health.SHARED))
messages("A41_health_insights", "SELECT hf.upload_id, hf.factor, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'moderate' ELSE 'low' END AS level, raw_value FROM hf JOIN rv USING (upload_id, factor)", *HEALTH_TABLES, HF, RAW)
messages("F24_uniform_factors", "SELECT upload_id, bool_and(abs(score - mean) <= 0.12) AS uniform FROM (SELECT *, avg(score) OVER (PARTITION BY upload_id) AS mean FROM hf) GROUP BY 1", *HEALTH_TABLES, HF)

messages("A42_import_stats", """SELECT upload_id, sum(word_count)::BIGINT AS words, sum(char_count)::BIGINT AS chars, sum(len(emojis))::BIGINT AS emojis, count(*) FILTER (has_media) AS media, round(avg(char_count) FILTER (char_count > 0), 2) AS avg_length,
  floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 86400000000)::BIGINT AS span_days FROM m GROUP BY 1""")
messages("A42_participant_order", """SELECT upload_id, (row_number() OVER (PARTITION BY upload_id ORDER BY pl))::INT AS place, sender FROM (SELECT upload_id, sender, min(msg_index) AS pl FROM m GROUP BY 1, 2)""")
EVENTS = f"ev AS (SELECT upload_id, msg_index, is_deleted, unnest(list_distinct(regexp_extract_all(content, '(?i){re2(entities.PATTERN)}'))) AS phrase FROM m)"
messages("X24_event_phrases", "SELECT upload_id, msg_index, phrase FROM ev", EVENTS)
# of the messages, three phrases hold a day; none names a person or a place
messages("A43_entities", """SELECT upload_id, family, lower(phrase) AS key, sum(n)::BIGINT AS mentions, arg_min(phrase, (-n, phrase)) AS display FROM (SELECT upload_id, family, phrase, count(*) AS n FROM (SELECT upload_id, 'events' AS family, phrase FROM ev WHERE NOT is_deleted UNION ALL
  SELECT upload_id, 'dates', CASE WHEN content LIKE '%tonight%' THEN 'tonight' WHEN content LIKE '%this weekend%' THEN 'this weekend' ELSE 'tomorrow' END FROM m WHERE NOT is_deleted AND (content LIKE '%tonight%' OR content LIKE '%this weekend%' OR content LIKE '%tomorrow%')) GROUP BY ALL) GROUP BY 1, 2, 3""", EVENTS)

LANG_TOKENS = f"regexp_extract_all(lower(trim({{0}})), '{re2(language.TOKEN)}')"


def lang(source: str, text: str, keys: str) -> str:
    scripts = ", ".join(f"len(regexp_extract_all({text}, '[{r}]'))" for r in language.SCRIPTS.values())
    lexicons = ", ".join(f"len(list_intersect(w, [{quoted(x.split())}]))" for x in language.LEXICONS.values())
    names, lex = quoted(language.SCRIPTS), quoted(language.LEXICONS)
    return f"""l0 AS (SELECT {keys}, {text} AS txt, {LANG_TOKENS.format(text)} AS w FROM {source}),
l1 AS (SELECT {keys}, w, len(w) AS n, [{scripts.replace(text, 'txt')}] AS sc, len(regexp_extract_all(txt, '[{language.LATIN}]')) AS latin, [{lexicons}] AS hits FROM l0),
l2 AS (SELECT *, list_max(sc) AS top, latin + list_sum(sc) AS letters, list_reverse_sort(list_transform(list_filter(range(1, 9), lambda i: hits[i] >= 2 AND hits[i] / n >= 0.15), lambda i: {{'share': hits[i] / n, 'o': -i}})) AS ranked FROM l1),
lang AS (SELECT {keys}, CASE WHEN n <= 2 THEN 'too_short' WHEN top > 0 AND top / letters >= 0.3 THEN ([{names}])[list_position(sc, top)] WHEN len(ranked) = 0 THEN 'english' WHEN len(ranked) > 1 AND ranked[1].share - ranked[2].share <= 0.04 THEN 'mixed_code_switched' ELSE ([{lex}])[-ranked[1].o] END AS category,
  round(CASE WHEN n <= 2 THEN 0 WHEN top > 0 AND top / letters >= 0.3 THEN top / letters WHEN len(ranked) = 0 THEN 0.6 ELSE ranked[1].share END, 3)::DOUBLE AS confidence FROM l2)"""


messages("X11_language", "SELECT * FROM lang", lang("m", "content", "upload_id, msg_index"))
messages("A44_language_stats", "SELECT upload_id, category, count(*) AS messages FROM lang GROUP BY 1, 2", lang("m", "content", "upload_id, msg_index"))
add("X11_language_documents", "SELECT * FROM lang", lang("documents", "text", "doc_id"))

add("W15_upload_previews", """SELECT upload_id, (row_number() OVER (PARTITION BY upload_id ORDER BY msg_index))::INT AS place, msg_index, sender, CASE WHEN length(trim(content)) > 200 THEN rtrim(left(trim(content), 200)) || '…' ELSE trim(content) END AS preview FROM
  (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY msg_index DESC) AS k FROM mc WHERE content <> '') WHERE k <= 3""", CONVERSATIONS_SQL)
messages("W16_context", "SELECT a.upload_id, a.msg_index AS around, b.msg_index, (b.msg_index - a.msg_index)::INT AS distance FROM m a JOIN m b ON a.upload_id = b.upload_id AND b.msg_index BETWEEN a.msg_index - 10 AND a.msg_index + 10")
# the session walked as the closed form says it: chunk c of a session holds places 13 c to 13 c + 14
CHUNK = """c0 AS (SELECT *, trim(content) AS txt, coalesce((epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY upload_id ORDER BY msg_index))) > 1800000000, false) AS gap FROM m WHERE msg_type = 'text' AND NOT is_deleted AND length(trim(content)) >= 2),
c1 AS (SELECT *, sum(gap::INT) OVER (PARTITION BY upload_id ORDER BY msg_index) AS session FROM c0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY upload_id, session ORDER BY msg_index) - 1 AS pos, count(*) OVER (PARTITION BY upload_id, session) AS n FROM c1),
c3 AS (SELECT c2.*, c FROM c2 JOIN range(2000) t(c) ON pos BETWEEN 13 * c AND 13 * c + 14 AND c < CASE WHEN n <= 15 THEN 1 ELSE 1 + ceil((n - 15) / 13.0) END),
c4 AS (SELECT *, dense_rank() OVER (PARTITION BY upload_id ORDER BY session, c) - 1 AS chunk_index FROM c3)"""
messages("W17_chunk_members", "SELECT upload_id, chunk_index, msg_index FROM c4", CHUNK)
messages("W17_chunks", """SELECT upload_id, chunk_index::INT AS chunk_index, min(msg_index) AS start_msg_index, max(msg_index) AS end_msg_index, min("timestamp") AS start_ts, max("timestamp") AS end_ts, array_to_string(list_sort(list_distinct(list(sender))), ',') AS participants,
  count(*) AS messages, string_agg(sender || ': ' || txt, chr(10) ORDER BY msg_index) AS content FROM c4 GROUP BY 1, 2""", CHUNK)
messages("W19_anchors", """SELECT upload_id, chunk_index::INT AS chunk_index, arg_min(msg_index, (short, d, before)) AS anchor_index, count(*) AS messages FROM (SELECT *, length(txt) < 4 AS short, abs(p - mid) AS d, p < mid AS before FROM
  (SELECT *, row_number() OVER (PARTITION BY upload_id, chunk_index ORDER BY msg_index) - 1 AS p, count(*) OVER (PARTITION BY upload_id, chunk_index) // 2 AS mid FROM c4)) GROUP BY 1, 2""", CHUNK)

QV = "qv AS (SELECT vec_id AS query_id, upload_id, embedding AS query FROM v WHERE vec_id % 50 = 0)"
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
COS = f"round({DOT.format('{0}', '{1}')} / (sqrt({DOT.format('{0}', '{0}')}) * sqrt({DOT.format('{1}', '{1}')})), 5)"
NN = f"nn AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, upload_id, chunk_index))::INT AS rank FROM (SELECT qv.query_id, v.*, {COS.format('embedding', 'query')} AS similarity FROM v JOIN qv USING (upload_id)))"
add("V03_nearest", "SELECT query_id, rank, chunk_index, similarity FROM nn WHERE rank <= 10", CHUNKS_SQL, QV, NN)
add("A46_confidence", "SELECT query_id, least(1.0, max(similarity))::DOUBLE AS confidence FROM nn WHERE rank <= 5 AND vec_id <> query_id GROUP BY 1", CHUNKS_SQL, QV, NN)
add("V05_intent_rerank", top(f"SELECT query_id, chunk_index, rank AS fr, round(CASE WHEN ([{quoted(EMOTIONS)}])[(vec_id % 7 + 1)::INT] IN ('love', 'joy') THEN least(1.0, similarity + 0.1) ELSE similarity END, 5)::DOUBLE AS score FROM nn WHERE rank <= 20", "query_id", "score DESC, fr", 10, "query_id, chunk_index, score"), CHUNKS_SQL, QV, NN)
add("V03_search", top("""SELECT query_id, upload_id, chunk_index, similarity, arg_min({'i': msg_index, 's': sender, 'e': emotion_label}, (short, d, before)) AS a FROM (SELECT *, length(trim(content)) < 4 AS short, abs(p - mid) AS d, p < mid AS before FROM
  (SELECT nn.query_id, nn.upload_id, nn.chunk_index, nn.similarity, m.msg_index, m.sender, m.emotion_label, m.content, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY nn.query_id, nn.upload_id, nn.chunk_index) // 2 AS mid
   FROM nn JOIN m ON m.upload_id = nn.upload_id AND m.msg_index BETWEEN start_msg_index AND end_msg_index WHERE nn.rank <= 25 AND similarity >= 0.3 WINDOW w AS (PARTITION BY nn.query_id, nn.upload_id, nn.chunk_index ORDER BY m.msg_index))) GROUP BY 1, 2, 3, 4""",
    "query_id", "similarity DESC, chunk_index", 5, "query_id, upload_id, chunk_index, similarity, a.i AS anchor_index, a.s AS sender, a.e AS emotion_label"), MESSAGES_SQL, CHUNKS_SQL, QV, NN)
add("T08_newest_first", """SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY m."timestamp" DESC, s.rank))::INT AS rank, s.upload_id, chunk_index, anchor_index, m."timestamp" FROM (""" + ORACLE_SQL["V03_search"].split(NN + "\n", 1)[1] + """) s JOIN m ON m.upload_id = s.upload_id AND m.msg_index = s.anchor_index""", MESSAGES_SQL, CHUNKS_SQL, QV, NN)
add("V04_similar", top(f"SELECT v.upload_id, v.chunk_index, {COS.format('v.embedding', 'o.embedding')} AS similarity FROM v JOIN o USING (upload_id) WHERE v.chunk_index <> o.chunk_index", "upload_id", "similarity DESC, chunk_index", 10, "upload_id, chunk_index, similarity"), CHUNKS_SQL, "o AS (SELECT * FROM v WHERE upload_id = 2 AND 40 BETWEEN start_msg_index AND end_msg_index ORDER BY chunk_index LIMIT 1)")

messages("X01_tokens", f"SELECT upload_id, msg_index, (generate_subscripts(t, 1) - 1)::INT AS pos, unnest(t) AS token FROM (SELECT *, {TOKENS.format('content')} AS t FROM m)")
messages("X04_emojis", "SELECT upload_id, msg_index, (generate_subscripts(emojis, 1) - 1)::INT AS pos, unnest(emojis) AS emoji FROM m")
messages("X05_metadata", "SELECT upload_id, msg_index, word_count, char_count, len(emojis)::INT AS emojis, has_url FROM m")
messages("X08_bigrams", f"SELECT upload_id, msg_index, (i - 1)::INT AS pos, t[i] AS first, t[i + 1] AS second FROM (SELECT *, unnest(range(1, greatest(len(t), 1))) AS i FROM (SELECT *, {TOKENS.format('content')} AS t FROM m))")
messages("X20_content_key", "SELECT upload_id, msg_index, md5(content) AS key FROM m")
messages("X22_citations", r"SELECT upload_id, msg_index, unnest(regexp_extract_all('See [' || msg_id || '] and [' || coalesce(reply_to_id, 'msg_x') || '].', '\[(msg_[\w\-]+)\]', 1)) AS cited FROM m")
add("X25_vector_length", "SELECT vec_id, 80::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM v", CHUNKS_SQL)
add("X26_cosine", f"SELECT a.vec_id, {COS.format('a.embedding', 'b.embedding')} AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id - 1", CHUNKS_SQL)
messages("X28_response_gauge", "SELECT upload_id, round(greatest(0.05, 1 - log10(1 + greatest(0, least(60, x))) / log10(61)), 6) AS fill FROM (SELECT up.upload_id, round(quantile_cont(minutes, 0.5), 2) AS x FROM up LEFT JOIN g USING (upload_id) GROUP BY 1)", DISTINCT_UPLOADS, GAPS)
add("X29_progress", "SELECT id, status, CASE status WHEN 'pending' THEN 5 WHEN 'parsing' THEN 25 WHEN 'nlp_processing' THEN 55 WHEN 'embedding' THEN 85 ELSE 100 END AS percent, status IN ('nlp_processing', 'embedding', 'done') AS stats_ready, status = 'done' AS search_ready FROM u", UPLOADS_SQL)
messages("J15_nearest_peak_day", """SELECT pk.upload_id, pk.bucket AS peak, arg_min(d.day, (abs(d.day - pk.bucket), d.day)) AS day FROM pk JOIN (SELECT DISTINCT upload_id, "timestamp"::DATE AS day FROM m) d USING (upload_id) WHERE kind = 'peak' GROUP BY 1, 2""", *PEAKS)

SAID = "sd AS (SELECT *, (row_number() OVER (PARTITION BY upload_id ORDER BY msg_index) - 1)::INT AS rn FROM m WHERE content <> '')"
for name in ("S04_whatsapp", "S06_instagram", "S07_facebook", "S08_delimited"):
    messages(name, """SELECT upload_id, rn AS msg_index, sender, "timestamp", content, 'text' AS msg_type, NULL::VARCHAR AS reply_to_id FROM sd""", SAID)
messages("S05_telegram", """SELECT a.upload_id, a.rn AS msg_index, a.sender, a."timestamp", a.content, 'text' AS msg_type, 'msg_' || b.rn AS reply_to_id FROM sd a LEFT JOIN sd b ON a.upload_id = b.upload_id AND a.reply_to_id = b.msg_id""", SAID)
add("S02_detect", """SELECT 'chat_' || i || CASE WHEN p = 'whatsapp' THEN '.txt' WHEN p = 'csv' THEN '.csv' ELSE '.json' END AS file, p AS written_as, p AS platform FROM (SELECT DISTINCT user_id % 10 AS i FROM events), (SELECT unnest(['whatsapp', 'telegram', 'instagram', 'facebook', 'csv']) AS p)""", "one AS (SELECT 1)")
messages("U07_translated", "SELECT upload_id, msg_index, content AS content_english, false AS was_translated FROM m")

messages("S10_next_page", "SELECT upload_id, msg_index, msg_id FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY msg_index) AS n FROM m WHERE msg_index > 40 AND sentiment_score IS NULL) WHERE n <= 50")
SAMPLED = "sa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY md5(upload_id || ':' || msg_index), msg_index) AS place FROM m) WHERE place <= 200)"
messages("S11_sample", "SELECT upload_id, msg_index FROM sa", SAMPLED)
# one phrase of the messages isn't English
messages("K03_normalised", """SELECT upload_id, msg_index, CASE WHEN english OR content NOT LIKE 'kya hai%' THEN content ELSE '[en] ' || content END AS content_english, CASE WHEN english THEN 'english' WHEN content LIKE 'kya hai%' THEN 'hinglish' WHEN len(regexp_extract_all(content, '[A-Za-z][A-Za-z'']*')) <= 2 THEN 'too_short' ELSE 'english' END AS original_language,
  NOT english AND content LIKE 'kya hai%' AS was_translated FROM m JOIN (SELECT upload_id, avg((content NOT LIKE 'kya hai%')::INT) >= 0.95 AS english FROM sa GROUP BY 1) USING (upload_id)""", SAMPLED)
messages("X10_language_code", "SELECT upload_id, msg_index, CASE WHEN length(trim(content)) < 3 THEN 'unknown' WHEN category = 'english' THEN 'en' WHEN category = 'hinglish' THEN 'hi' ELSE 'unknown' END AS code FROM lang JOIN m USING (upload_id, msg_index)", lang("m", "content", "upload_id, msg_index"))
messages("S13_document_export", """SELECT upload_id, msg_index, '{"msg_id":"' || msg_id || '","sender":"' || sender || '","timestamp":"' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.000') || '","content":"' || content || '","type":"' || msg_type || '"' || coalesce(',"reply_to_id":"' || reply_to_id || '"', '') || '}' AS message FROM m""")
messages("K07_documents", """SELECT upload_id, '{"ucj_version":"1.0","meta":{"participants":["' || array_to_string(list_sort(list_distinct(list(sender))), '","') || '"],"total_messages":' || count(*) || ',"date_range":{"start":"' || strftime(min("timestamp"), '%Y-%m-%dT%H:%M:%S') || '","end":"' || strftime(max("timestamp"), '%Y-%m-%dT%H:%M:%S') || '"}},"messages":[' ||
  string_agg('{"id":"' || msg_id || '","sender":"' || sender || '","timestamp":"' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '","content":"' || content || '","type":"' || msg_type || '"' || coalesce(',"reply_to_id":"' || reply_to_id || '"', '') || ',"metadata":{"word_count":' || word_count || ',"char_count":' || char_count || ',"has_emoji":' || (len(emojis) > 0)::VARCHAR || ',"emojis":[' ||
    CASE WHEN len(emojis) > 0 THEN '"' || array_to_string(emojis, '","') || '"' ELSE '' END || '],"has_url":' || has_url::VARCHAR || ',"is_deleted":' || is_deleted::VARCHAR || ',"has_media":' || has_media::VARCHAR || '}}', ',' ORDER BY msg_index) || ']}' AS document FROM m GROUP BY 1""")
# what the cleaning changes in the messages: emoji, a link and one short form
messages("X09_clean", r"""SELECT upload_id, msg_index, CASE WHEN content LIKE 'love you so%' THEN 'love you so much __EMOJI__' WHEN content LIKE 'got you%' THEN 'got you a surprise for your birthday __EMOJI__ __EMOJI__' WHEN content LIKE 'big hugs%' THEN 'big hugs and kisses __EMOJI__'
  WHEN content LIKE 'haha%' THEN 'haha that is hilarious __EMOJI__ __EMOJI__' WHEN content LIKE 'check http%' THEN 'check tomorrow' ELSE content END AS clean FROM m""")
# good and bad words of each phrase, and its emotion, told by hand
MOODS = "mo AS (SELECT * FROM (VALUES ('you never%', 0, 2, 'anger'), ('whatever%', 0, 1, 'anger'), ('I am sorry%', 0, 2, 'sadness'), ('love you so%', 1, 0, 'love'), ('miss you,%', 0, 0, 'love'), ('got you a%', 1, 0, 'surprise'), ('big hugs%', 0, 0, 'love'), ('haha%', 1, 0, 'joy'), ('the weather%', 1, 0, 'joy')) t(p, good, bad, emotion))"
messages("U01_sentiment_emotion", "SELECT upload_id, msg_index, CASE WHEN good > bad THEN 'positive' WHEN bad > good THEN 'negative' ELSE 'neutral' END AS sentiment_label, CASE WHEN coalesce(good + bad, 0) > 0 THEN (good - bad) / (good + bad) ELSE 0.0 END::DOUBLE AS sentiment_score, emotion AS emotion_label FROM m LEFT JOIN mo ON content LIKE p", MOODS)
KEYS = """kw AS (SELECT upload_id, msg_index, unnest(t) AS word FROM (SELECT *, list_filter(""" + TOKENS.format(NO_LINKS.format("content")) + f""", lambda x: x NOT IN ({SHORT})) AS t FROM m)),
ktf AS (SELECT upload_id, msg_index, word, count(*) AS tf FROM kw GROUP BY 1, 2, 3), kdf AS (SELECT upload_id, word, count(*) AS df FROM ktf GROUP BY 1, 2), kn AS (SELECT upload_id, count(*) AS n FROM m GROUP BY 1),
ks AS (SELECT upload_id, msg_index, word, tf * ln((1 + n) / (1 + df)) AS score FROM ktf JOIN kdf USING (upload_id, word) JOIN kn USING (upload_id)),
ky AS (SELECT upload_id, msg_index, word, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY upload_id, msg_index ORDER BY score DESC, word) AS rank FROM ks) WHERE rank <= 5)"""
messages("U03_keywords", "SELECT upload_id, msg_index, rank, word, score FROM ky", KEYS)
TOPICS = """ksz AS (SELECT upload_id, word, size FROM (SELECT upload_id, word, count(*) AS size FROM ky GROUP BY 1, 2) JOIN kn USING (upload_id) WHERE size >= greatest(5, least(50, n // 100))),
kt AS (SELECT upload_id, msg_index, coalesce(topic, 'misc') AS topic FROM (SELECT upload_id, msg_index FROM m WHERE word_count >= 3) LEFT JOIN (SELECT upload_id, msg_index, arg_min(word, (size, word)) AS topic FROM ky JOIN ksz USING (upload_id, word) GROUP BY 1, 2) USING (upload_id, msg_index))"""
messages("U04_topics", "SELECT * FROM kt", KEYS, TOPICS)
messages("A45_topic_table", """SELECT upload_id, topic AS label, size, CASE WHEN topic = 'misc' THEN -1 ELSE row_number() OVER (PARTITION BY upload_id, topic = 'misc' ORDER BY size DESC, topic) - 1 END::INT AS topic_id, coalesce(keywords, '') AS keywords FROM (SELECT upload_id, topic, count(*) AS size FROM kt GROUP BY 1, 2) LEFT JOIN
  (SELECT upload_id, topic, string_agg(word, ',' ORDER BY q) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY upload_id, topic ORDER BY n DESC, word) AS q FROM (SELECT upload_id, topic, word, count(*) AS n FROM ky JOIN kt USING (upload_id, msg_index) GROUP BY 1, 2, 3)) WHERE q <= 5 GROUP BY 1, 2) USING (upload_id, topic)""", KEYS, TOPICS)
messages("V01_vectors", """SELECT upload_id, chunk_index, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY upload_id, chunk_index)), 3) AS value FROM (SELECT upload_id, chunk_index::INT AS chunk_index, (('0x' || left(md5(word), 4))::INT % 64)::INT AS slot, count(*)::DOUBLE AS n FROM
  (SELECT upload_id, chunk_index, unnest(regexp_extract_all(lower(sender || ': ' || txt), '[A-Za-z][A-Za-z'']{1,}')) AS word FROM c4) GROUP BY 1, 2, 3)""", CHUNK)
add("V08_suggestions", """SELECT * FROM (VALUES (1, 'What do we argue about?', 'What are the most common reasons we argue or disagree?', 'relationship'), (2, 'How does affection show up?', 'How does each person express affection or love in the conversation?', 'relationship'), (3, 'Happiest moments', 'Which conversations stand out as the happiest or most fun?', 'moments'),
  (4, 'When did things change?', 'When did the communication patterns change, and how?', 'patterns'), (5, 'Most discussed topics', 'What topics do we discuss most often?', 'content'), (6, 'How do we apologize?', 'How does each person apologize, and how is it received?', 'relationship'), (7, 'Plans we made', 'What plans did we make together — trips, events, ideas?', 'content'),
  (8, 'Inside jokes', 'What are the recurring jokes, references, or shared phrases?', 'content')) t(place, label, query, category)""", "one AS (SELECT 1)")
