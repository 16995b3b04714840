"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions.names import emoji_name
from parlance.operators import chunks, conflict, emotion, enrich, entities, health, language, love, search, stats, uploads, words
from parlance.plans import exported, sql
from parlance.sources import fixtures, ingest

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "A08_participants"


def on_messages(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(fixtures.messages_from_events(spark, sf_dir))


def on_chunks(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(fixtures.chunks_from_embeddings(spark, sf_dir), fixtures.messages_from_events(spark, sf_dir))


def asked(c: DataFrame) -> DataFrame:
    """Every fiftieth vector as a query, each in its own conversation."""
    return c.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "upload_id", F.col("embedding").alias("query"))


def scan(m: DataFrame) -> DataFrame:
    return m.where("NOT is_deleted").select("upload_id", "msg_index", "msg_id", "sender", "content", "sentiment_score")


def frequency(m: DataFrame) -> DataFrame:
    """Long instead of a map for each word, as SQL compares it."""
    return words.frequency(m, 20).select("upload_id", "rank", "word", "uses", "share", F.explode("per_sender").alias("sender", "by_sender"))


def metadata(m: DataFrame) -> DataFrame:
    return m.select("upload_id", "msg_index", "word_count", "char_count", F.size("emojis").alias("emojis"), "has_url")


def tokens(m: DataFrame) -> DataFrame:
    return m.select("upload_id", "msg_index", F.posexplode(T.tokens(F.col("content"))).alias("pos", "token"))


def emoji(m: DataFrame) -> DataFrame:
    return m.select("upload_id", "msg_index", F.posexplode("emojis").alias("pos", "emoji"))


def pairs(m: DataFrame) -> DataFrame:
    return m.select("upload_id", "msg_index", F.posexplode(T.bigrams(T.tokens(F.col("content")))).alias("pos", "pair")).select("upload_id", "msg_index", "pos", "pair.first", "pair.second")


def analyzable(m: DataFrame) -> DataFrame:
    ok = (F.regexp_count("content", F.lit(r"\w+")) >= 3) & ~F.col("is_deleted")
    return m.groupBy("upload_id").agg(F.count_if(ok).alias("analyzable"), F.count("*").alias("messages"))


def nlp_ready(m: DataFrame) -> DataFrame:
    """Messages that the language models take."""
    t = F.coalesce("content_english", "content")
    ok = ~F.col("is_deleted") & ~F.col("msg_type").isin("deleted", "system") & (F.trim(t) != "") & (~F.col("has_media") | (F.length(F.trim(t)) >= 10)) & (F.col("word_count") >= 3) & (F.length(t) >= 10)
    return m.where(ok).select("upload_id", "msg_index")


def gaps(m: DataFrame) -> DataFrame:
    return stats.gaps(m).select("upload_id", "sender", "timestamp", F.round("minutes", 6).alias("minutes"))


def rolling(m: DataFrame) -> DataFrame:
    return conflict.rolling(m).select("upload_id", "msg_index", F.round("roll", 6).alias("roll"), "sign", "apology", "calm3")


def members(m: DataFrame) -> DataFrame:
    return chunks.chunk_members(m).select("upload_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "msg_index")


def context(m: DataFrame) -> DataFrame:
    return chunks.context(m, m.select("upload_id", "msg_index"))


def new_chunks(c: DataFrame, _: DataFrame) -> DataFrame:
    return chunks.missing(c, c.where("chunk_index % 3 = 0")).select("upload_id", "chunk_index")


def wide_timeline(m: DataFrame) -> DataFrame:
    return words.wide(words.length_timeline(m), ["upload_id", "day"], "avg_length")


def nearest_peak_day(m: DataFrame) -> DataFrame:
    """Of each peak the nearest day with messages; ties go to the earlier."""
    p = emotion.peaks(m).where("kind = 'peak'").select("upload_id", F.col("bucket").alias("peak"))
    d = m.select("upload_id", F.to_date("timestamp").alias("day")).distinct()
    return p.join(d, "upload_id").groupBy("upload_id", "peak").agg(F.min_by("day", F.struct(F.abs(F.datediff("day", "peak")), "day")).alias("day"))


def week_grid(m: DataFrame) -> DataFrame:
    """Days of the calendar by week, as a struct's fields."""
    return emotion.calendar(m).select("upload_id", F.to_date(F.date_trunc("week", "bucket")).alias("week"), F.weekday("bucket").cast("int").alias("weekday"), "messages")


def vector_lengths(c: DataFrame, _: DataFrame) -> DataFrame:
    v = search.fit_length(F.col("embedding"), 80)
    return c.select("vec_id", F.size(v).alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def pairs_of_vectors(c: DataFrame, _: DataFrame) -> DataFrame:
    other = c.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    return c.join(other, "vec_id").select("vec_id", F.round(search.cosine(F.col("embedding"), F.col("before")), 5).alias("similarity"))


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.nearest(fixtures.chunks_from_embeddings(spark, sf_dir), asked(fixtures.chunks_from_embeddings(spark, sf_dir)), 20)
    hits = hits.withColumn("emotion_label", F.element_at(F.array(*map(F.lit, stats.EMOTIONS)), (F.col("vec_id") % 7 + 1).cast("int")))
    return search.rerank(hits.select("query_id", "rank", "upload_id", "chunk_index", "similarity", "emotion_label"), "when did we love and laugh", 10).select("query_id", "rank", "chunk_index", "score")


def cited(m: DataFrame) -> DataFrame:
    answer = F.concat(F.lit("See ["), F.col("msg_id"), F.lit("] and ["), F.coalesce("reply_to_id", F.lit("msg_x")), F.lit("]."))
    return m.select("upload_id", "msg_index", F.explode(search.citations(answer)).alias("cited"))


def modelled(m: DataFrame) -> DataFrame:
    """The stand-ins' sentiment and emotion."""
    return m.select("upload_id", "msg_index", enrich.sentiment(F.col("content")).alias("s"), enrich.emotion(F.col("content")).alias("e")).select("upload_id", "msg_index", F.col("s.label").alias("sentiment_label"), F.round("s.score", 6).alias("sentiment_score"), F.col("e.label").alias("emotion_label"))


def cleaned(m: DataFrame) -> DataFrame:
    return m.select("upload_id", "msg_index", enrich.clean_for_models(F.col("content")).alias("clean"))


def vectors(m: DataFrame) -> DataFrame:
    """The components that aren't zero."""
    each = chunks.chunks(m).select("upload_id", "chunk_index", F.posexplode(enrich.hashed_vector(F.col("content"))).alias("slot", "value"))
    return each.where("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 3))


def themes(m: DataFrame) -> DataFrame:
    """Lists as text, as SQL compares it."""
    return conflict.themes(m).withColumns({"window_ids": F.array_join("window_ids", ","), "examples": F.array_join("examples", ",")})


def answers(m: DataFrame) -> DataFrame:
    """What stands for a model's answers: a kind for every message by its place, one of them unknown."""
    kinds = F.array(*[F.lit(k) for k in love.KINDS], F.lit("no such kind"))
    return m.select("upload_id", "msg_id", F.element_at(kinds, (F.col("msg_index") % 6 + 1).cast("int")).alias("category"))


def named(m: DataFrame) -> DataFrame:
    told = conflict.runs(m).select("upload_id", "window_id", F.concat(F.lit("theme "), F.col("first_index") % 3).alias("theme"))
    return conflict.named_themes(m, told)


def newest(c: DataFrame, m: DataFrame) -> DataFrame:
    return search.newest_first(search.search(c, m, asked(c), 5), m)


def topic_table(m: DataFrame) -> DataFrame:
    return enrich.topic_table(m).withColumn("keywords", F.array_join("keywords", ","))


def emoji_names(m: DataFrame) -> DataFrame:
    return m.select(F.explode("emojis").alias("emoji")).distinct().select("emoji", emoji_name(F.col("emoji")).alias("name"))


QUERIES: dict[str, Query] = {
    "S02_detect": exported.detected,
    "S04_whatsapp": exported.round_trip("whatsapp"),
    "S05_telegram": exported.round_trip("telegram"),
    "S06_instagram": exported.round_trip("instagram"),
    "S07_facebook": exported.round_trip("facebook"),
    "S08_delimited": exported.round_trip("csv"),
    "K07_documents": on_messages(ingest.document),
    "U01_sentiment_emotion": on_messages(modelled),
    "U03_keywords": on_messages(enrich.keywords),
    "U04_topics": on_messages(enrich.topics),
    "A45_topic_table": on_messages(topic_table),
    "U07_translated": on_messages(lambda m: enrich.translated(m).select("upload_id", "msg_index", "content_english", "was_translated")),
    "V01_vectors": on_messages(vectors),
    "X09_clean": on_messages(cleaned),
    "S09_ordered_scan": on_messages(scan),
    "S10_next_page": on_messages(lambda m: ingest.next_page(m, 40, 50).select("upload_id", "msg_index", "msg_id")),
    "S11_sample": on_messages(lambda m: language.sample(m).select("upload_id", "msg_index")),
    "K03_normalised": on_messages(lambda m: language.normalised(m, lambda c: F.concat(F.lit("[en] "), c)).select("upload_id", "msg_index", "content_english", "original_language", "was_translated")),
    "S12_stride_sample": on_messages(lambda m: love.stride_sample(m, 200).select("upload_id", "msg_index")),
    "S13_document_export": on_messages(lambda m: m.select("upload_id", "msg_index", F.to_json(F.struct("msg_id", "sender", "timestamp", "content", F.col("msg_type").alias("type"), "reply_to_id")).alias("message"))),
    "S14_upload_page": lambda s, d: uploads.page(fixtures.uploads_from_conversations(s, d), 20, 10).select("id", "filename", "total_messages", "created_at", "total"),
    "F13_model_input": on_messages(nlp_ready),
    "F20_keyword_rich": on_messages(lambda m: m.select("upload_id", "msg_index", search.keyword_rich(F.col("content")).alias("rich"))),
    "F21_previews": on_messages(lambda m: m.where("content <> ''").select("upload_id", "msg_index", T.preview(F.col("content"), 20).alias("preview"))),
    "F22_display_name": lambda s, d: fixtures.uploads_from_conversations(s, d).select("id", uploads.display_name(F.col("participants"), F.col("filename")).alias("name")),
    "F23_analyzable": on_messages(analyzable),
    "J07_chunk_messages": on_chunks(lambda c, m: chunks.chunk_messages(c, m).groupBy("upload_id", "chunk_index").agg(F.count("*").alias("messages"), F.min("msg_index").alias("lo"), F.max("msg_index").alias("hi"))),
    "J08_message_chunk": on_chunks(chunks.message_chunk),
    "J09_new_chunks": on_chunks(new_chunks),
    "J10_love_residual": on_messages(love.residual),
    "J13_conflict_arcs": on_messages(conflict.arcs),
    "J15_nearest_peak_day": on_messages(nearest_peak_day),
    "A01_overview_totals": on_messages(stats.overview_totals),
    "A03_date_stats": on_messages(stats.date_stats),
    "A04_hour_histogram": on_messages(stats.hour_histogram),
    "A05_busiest": on_messages(stats.busiest),
    "A06_median_response": on_messages(stats.median_response),
    "A07_who_texts_first": on_messages(stats.who_texts_first),
    "A08_participants": on_messages(stats.participants),
    "A09_longest_message": on_messages(stats.longest_message),
    "A10_most_replied_to": on_messages(stats.most_replied_to),
    "A11_first_message": on_messages(stats.first_message),
    "A12_favourite_tokens": on_messages(stats.favourite_tokens),
    "A13_participant_dive": on_messages(lambda m: stats.participant_dive(m)),
    "A13_participant_hours": on_messages(lambda m: stats.participant_hours(m)),
    "A13_participant_words": on_messages(lambda m: stats.participant_words(m)),
    "A14_timeline_day": on_messages(lambda m: emotion.timeline(m, "day")),
    "A14_timeline_week": on_messages(lambda m: emotion.timeline(m, "week")),
    "A14_timeline_month": on_messages(lambda m: emotion.timeline(m, "month")),
    "A15_emotion_distribution": on_messages(emotion.distribution),
    "A15_emotion_samples": on_messages(emotion.samples),
    "A16_emotion_by_sender": on_messages(lambda m: emotion.distribution(m, True)),
    "A16_emotion_samples_by_sender": on_messages(lambda m: emotion.samples(m, True)),
    "A17_peaks": on_messages(emotion.peaks),
    "A17_peak_messages": on_messages(emotion.peak_messages),
    "A18_calendar": on_messages(emotion.calendar),
    "A18_extreme_days": on_messages(emotion.extreme_days),
    "A19_corpus_scan": on_messages(words.corpus_scan),
    "A20_word_frequency": on_messages(frequency),
    "A21_bigrams": on_messages(words.bigrams),
    "A21_inside_phrases": on_messages(words.inside_phrases),
    "A22_richness": on_messages(words.richness),
    "A23_distinctive": on_messages(words.distinctive),
    "A24_length_timeline": on_messages(words.length_timeline),
    "A25_emoji_frequency": on_messages(words.emoji_frequency),
    "A25_emoji_by_sender": on_messages(words.emoji_by_sender),
    "A25_emoji_of_one_sender": on_messages(words.emoji_of_one_sender),
    "A26_word_trend": on_messages(lambda m: words.trend(m, "Love")),
    "A27_late_night": on_messages(words.late_night),
    "A27_late_night_samples": on_messages(words.late_night_samples),
    "A28_conflict_windows": on_messages(conflict.runs),
    "A28_conflict_top_words": on_messages(conflict.top_words),
    "A28_conflict_samples": on_messages(conflict.sample_messages),
    "A29_conflict_resolution": on_messages(conflict.resolutions),
    "A30_conflict_summary": on_messages(conflict.summary),
    "A30_conflict_triggers": on_messages(conflict.triggers),
    "A30_conflict_roles": on_messages(conflict.roles),
    "A30_conflict_months": on_messages(conflict.per_month),
    "A31_conflict_language": on_messages(conflict.language),
    "A31_conflict_starts": on_messages(conflict.start_times),
    "A32_conflict_themes": on_messages(themes),
    "J14_named_themes": on_messages(named),
    "A33_love_report": on_messages(love.report),
    "J11_love_with_answers": on_messages(lambda m: love.report(m, answers(m))),
    "A33_love_examples": on_messages(love.examples),
    "A33_love_summary": on_messages(love.summary),
    **{f"{n}_health_{k}": on_messages(f) for n, (k, f) in zip(("A34", "A35", "A36", "A37", "A38", "A39", "A40"), health.FACTORS.items())},
    "A41_health_score": on_messages(health.composite),
    "A41_health_insights": on_messages(health.insights),
    "F24_uniform_factors": on_messages(health.uniform),
    "A42_import_stats": on_messages(stats.import_stats),
    "A42_participant_order": on_messages(stats.participant_order),
    "A43_entities": on_messages(entities.aggregate),
    "A44_language_stats": on_messages(language.stats),
    "A46_confidence": lambda s, d: search.confidence(search.nearest(fixtures.chunks_from_embeddings(s, d), asked(fixtures.chunks_from_embeddings(s, d)), 5).where("vec_id <> query_id")),
    "A47_wide_timeline": on_messages(wide_timeline),
    "A48_dominant_sender": on_messages(words.dominant_sender),
    "A48_week_grid": on_messages(week_grid),
    "W03_response_gaps": on_messages(gaps),
    "W08_rolling": on_messages(rolling),
    "W15_upload_previews": lambda s, d: uploads.previews(fixtures.messages_from_conversations(s, d), fixtures.uploads_from_conversations(s, d)),
    "W16_context": on_messages(context),
    "W17_chunks": on_messages(chunks.chunks),
    "W17_chunk_members": on_messages(members),
    "W19_anchors": on_messages(lambda m: chunks.anchors(chunks.chunk_members(m))),
    "V03_search": on_chunks(lambda c, m: search.search(c, m, asked(c), 5)),
    "V03_nearest": on_chunks(lambda c, _: search.nearest(c, asked(c), 10).select("query_id", "rank", "chunk_index", "similarity")),
    "T08_newest_first": on_chunks(newest),
    "V04_similar": on_chunks(lambda c, _: search.similar_to(c, 40, 2, 10)),
    "V05_intent_rerank": intents,
    "V08_suggestions": lambda s, d: search.suggestions(s),
    "X01_tokens": on_messages(tokens),
    "X04_emojis": on_messages(emoji),
    "X05_metadata": on_messages(metadata),
    "X08_bigrams": on_messages(pairs),
    "X10_language_code": on_messages(lambda m: m.select("upload_id", "msg_index", language.code(F.col("content")).alias("code"))),
    "X27_emoji_names": on_messages(emoji_names),
    "X11_language": on_messages(language.detected),
    "X11_language_documents": lambda s, d: language.detected(s.read.parquet(f"{d}/documents.parquet"), "text"),
    "X20_content_key": on_messages(lambda m: m.select("upload_id", "msg_index", F.md5("content").alias("key"))),
    "X22_citations": on_messages(cited),
    "X24_event_phrases": on_messages(lambda m: m.select("upload_id", "msg_index", F.explode(entities.event_phrases(F.col("content"))).alias("phrase"))),
    "X25_vector_length": on_chunks(vector_lengths),
    "X26_cosine": on_chunks(pairs_of_vectors),
    "X28_response_gauge": on_messages(lambda m: stats.median_response(m).select("upload_id", F.round(uploads.response_gauge(F.col("median_minutes")), 6).alias("fill"))),
    "X29_progress": lambda s, d: uploads.progress(fixtures.uploads_from_conversations(s, d)),
}
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
