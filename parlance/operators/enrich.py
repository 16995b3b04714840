"""Columns that models fill: sentiment, emotion, keywords, topics, vectors and translations.

Each takes the model as a function over a batch of texts, run by a pandas UDF that loads it once in a worker. Without
one, a small deterministic stand-in made of columns answers; it says little, but lets a whole flow run without models.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parlance.functions import text as T

# The stand-ins' words.
GOOD = "love great amazing happy fun thanks thank hilarious surprise awesome nice good best proud".split()
BAD = "angry hate never stop fault sorry bad sad upset fight blame worst lonely".split()
EMOTION_WORDS = {"joy": "happy fun haha hilarious great", "love": "love miss hug hugs kiss kisses", "sadness": "sad sorry lonely crying", "anger": "angry hate stop fight", "fear": "scared afraid worried", "surprise": "surprise wow", "disgust": "gross disgusting"}


def model_column(load: Callable[[], Callable[[list[str]], list]], kind: str) -> Callable[[Column], Column]:
    """A model over batches of texts as a column; load is called once in each worker and task."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()), index=batch.index)

    return run


def _share(words: Column, known: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*known))).cast("double")


def sentiment(text: Column) -> Column:
    """A struct (label, score): good words less bad ones, over their number."""
    words = T.tokens(text)
    good, bad = _share(words, GOOD), _share(words, BAD)
    score = F.when(good + bad > 0, (good - bad) / (good + bad)).otherwise(0.0)
    return F.struct(F.when(score >= 0.05, "positive").when(score <= -0.05, "negative").otherwise("neutral").alias("label"), score.alias("score"))


def emotion(text: Column) -> Column:
    """A struct (label, score): the emotion of most words; null without any."""
    words = T.tokens(text)
    each = F.array(*[F.struct(_share(words, x.split()).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("label")) for i, (k, x) in enumerate(EMOTION_WORDS.items())])
    best = F.array_max(each)
    return F.when(best["n"] > 0, F.struct(best["label"].alias("label"), (best["n"] / F.greatest(F.size(words), F.lit(1))).alias("score")))


def keywords(m: DataFrame, k: int = 5) -> DataFrame:
    """Each message's words of largest tf-idf within its conversation: a count of words, and one of messages that hold each."""
    words = m.select("upload_id", "msg_index", F.explode(F.filter(T.tokens_without_links(F.col("content")), lambda w: ~w.isin(*T.STOPWORDS))).alias("word"))
    tf = words.groupBy("upload_id", "msg_index", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("upload_id", "word").agg(F.count("*").alias("df"))
    n = m.groupBy("upload_id").agg(F.count("*").alias("n"))
    scored = tf.join(df, ["upload_id", "word"]).join(n, "upload_id").withColumn("score", F.col("tf") * F.log((1 + F.col("n")) / (1 + F.col("df"))))
    w = Window.partitionBy("upload_id", "msg_index").orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("upload_id", "msg_index", "rank", "word", F.round("score", 6).alias("score"))


def topics(m: DataFrame, least_words: int = 3) -> DataFrame:
    """Each message's topic: its rarest keyword that enough messages share (a hundredth of them, from 5 to 50), else misc."""
    keys = keywords(m)
    n = m.groupBy("upload_id").agg(F.greatest(F.lit(5), F.least(F.lit(50), F.floor(F.count("*") / 100))).alias("least"))
    sizes = keys.groupBy("upload_id", "word").agg(F.count("*").alias("size")).join(n, "upload_id").where(F.col("size") >= F.col("least"))
    best = keys.join(sizes, ["upload_id", "word"]).groupBy("upload_id", "msg_index").agg(F.min_by("word", F.struct("size", "word")).alias("topic"))
    rows = m.where(F.col("word_count") >= least_words).select("upload_id", "msg_index")
    return rows.join(best, ["upload_id", "msg_index"], "left").withColumn("topic", F.coalesce("topic", F.lit("misc")))


def topic_table(m: DataFrame, k: int = 5) -> DataFrame:
    """Each conversation's topics, numbered by size from 0 (misc is -1), with their size and the k keywords that most of their messages share."""
    t = topics(m)
    sizes = t.groupBy("upload_id", "topic").agg(F.count("*").alias("size"))
    own = F.col("topic") != "misc"
    number = F.row_number().over(Window.partitionBy("upload_id", own).orderBy(F.desc("size"), "topic")) - 1
    sizes = sizes.withColumn("topic_id", F.when(own, number).otherwise(-1))
    words = keywords(m).join(t, ["upload_id", "msg_index"]).groupBy("upload_id", "topic", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("upload_id", "topic").orderBy(F.desc("n"), "word"))
    best = words.withColumn("place", place).where(F.col("place") <= k).groupBy("upload_id", "topic").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    out = sizes.join(best, ["upload_id", "topic"], "left")
    return out.select("upload_id", "topic_id", F.col("topic").alias("label"), F.coalesce(F.transform("w", lambda x: x["word"]), F.array().cast("array<string>")).alias("keywords"), "size")


def hashed_vector(text: Column, n: int = 64) -> Column:
    """Counts of words by hash, of unit length: a stand-in for a model's vector. Texts without words give zeros.

    A word's slot is the number that the first four digits of its MD5 write, modulo n. Words, counts and norm are each worked out once.
    """
    slot = lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % n)
    counts = lambda slots: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda c: T.let(norm(c), lambda z: F.transform(c, lambda x: F.when(z > 0, x / z).otherwise(0.0).cast("float")))
    return T.let(F.transform(T.tokens(text), slot), lambda slots: T.let(counts(slots), unit))


def translated(m: DataFrame, translate: Callable[[Column], Column] | None = None, cache: DataFrame | None = None) -> DataFrame:
    """content_english by a translator for what needs it, each different text once; cache: key (md5) and english of texts known already."""
    need = m.where("content_english IS NULL AND content <> ''").select(F.md5("content").alias("key"), "content").dropDuplicates(["key"])
    if cache is not None:
        need = need.join(cache.select("key"), "key", "left_anti")
    new = need.select("key", (translate or (lambda c: c))(F.col("content")).alias("english"))
    known = new if cache is None else new.unionByName(cache.select("key", "english"))
    rows = m.withColumn("_key", F.md5("content")).join(known.withColumnRenamed("key", "_key"), "_key", "left")
    changed = F.lower(F.trim("english")) != F.lower(F.trim("content"))
    return rows.withColumns({"content_english": F.coalesce("content_english", "english", "content"), "was_translated": F.coalesce(changed, F.lit(False))}).drop("_key", "english")


# Links with bare domains, the mark that emoji become, and short forms with what they stand for.
_ANY_LINK = r"(?i)\b(?:https?://|ftp://|www\.)\S+|\b\S+\.(?:com|org|net|io|gov|edu|co|uk|de|in)(?:/\S*)?\b"
MARKS = r""".,!?;:"'()[]{}"""
ABBREVIATIONS = {
    "u": "you", "ur": "your", "r": "are", "y": "why", "n": "and", "k": "okay", "kk": "okay", "thx": "thanks", "thnx": "thanks", "ty": "thank you", "tysm": "thank you so much",
    "pls": "please", "plz": "please", "cuz": "because", "bcuz": "because", "bc": "because", "b4": "before", "l8r": "later", "l8": "late", "gr8": "great", "w8": "wait",
    "wat": "what", "wut": "what", "wht": "what", "wud": "would", "shud": "should", "cud": "could", "abt": "about", "ppl": "people", "smth": "something", "sumthin": "something",
    "smthn": "something", "evry1": "everyone", "any1": "anyone", "no1": "no one", "som1": "someone",
    "lol": "laughing", "lmao": "laughing", "rofl": "laughing", "lmfao": "laughing hard", "omg": "oh my god", "omfg": "oh my god", "wtf": "what the heck", "wth": "what the heck",
    "tbh": "to be honest", "tbf": "to be fair", "imo": "in my opinion", "imho": "in my honest opinion", "fyi": "for your information", "btw": "by the way", "afaik": "as far as i know",
    "iirc": "if i recall correctly", "idk": "i do not know", "idc": "i do not care", "idgaf": "i do not care", "dgaf": "do not care", "ily": "i love you", "ilysm": "i love you so much",
    "lmk": "let me know", "ngl": "not going to lie", "smh": "shaking my head", "fwiw": "for what it is worth", "iykyk": "if you know you know", "icymi": "in case you missed it",
    "tldr": "too long did not read", "tl;dr": "too long did not read", "rn": "right now", "asap": "as soon as possible", "atm": "at the moment", "irl": "in real life",
    "dm": "direct message", "pm": "private message", "afk": "away from keyboard", "bbl": "be back later", "brb": "be right back", "bff": "best friend", "bf": "boyfriend", "gf": "girlfriend",
    "hubby": "husband", "wifey": "wife", "fam": "family", "bro": "brother", "sis": "sister", "mom": "mother", "dad": "father",
    "af": "very", "asf": "very", "ngl,": "not going to lie,", "deadass": "seriously", "lowkey": "kind of", "highkey": "very", "fr": "for real", "frfr": "for real", "fr fr": "for real", "ong": "for real",
    "tmrw": "tomorrow", "tmr": "tomorrow", "tmrrw": "tomorrow", "tn": "tonight", "tnite": "tonight", "yest": "yesterday", "wkend": "weekend", "wknd": "weekend",
    "msg": "message", "txt": "text", "convo": "conversation", "info": "information", "vid": "video", "pic": "picture", "pics": "pictures", "pix": "pictures", "addy": "address", "appt": "appointment",
    "prob": "problem", "probly": "probably", "prolly": "probably",
    "ya": "yes", "yea": "yes", "yeah": "yes", "yep": "yes", "yup": "yes", "nah": "no", "nope": "no", "nvm": "never mind", "nm": "not much", "np": "no problem",
    "rly": "really", "rlly": "really", "totes": "totally", "obvs": "obviously", "obv": "obvious", "def": "definitely", "defs": "definitely", "deffo": "definitely",
}


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFKC", s) if s is not None else None)


def clean_for_models(text: Column, abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    """Compatibility forms, no links, a mark for each emoji, abbreviations (single words, whatever marks stand round them; those after them stay) in full, single spaces."""
    marked = F.regexp_replace(F.regexp_replace(nfkc(text), _ANY_LINK, " "), f"({T.EMOJI})", " __EMOJI__ ")
    table = F.create_map(*[F.lit(x) for kv in abbreviations.items() for x in kv]) if abbreviations else None
    round_ = "".join(f"\\{c}" for c in MARKS)

    def full(word: Column) -> Column:
        core = F.lower(F.regexp_replace(word, rf"^[{round_}]+|[{round_}]+$", ""))
        return F.coalesce(F.concat(F.try_element_at(table, core), F.regexp_extract(word, rf"[{round_}]*$", 0)), word)

    words = F.filter(F.split(F.trim(marked), r"\s+"), lambda w: w != "")
    return F.array_join(words if table is None else F.transform(words, full), " ")


def json_of(answer: Column, schema: str) -> Column:
    """A model's JSON answer, with or without a fence round it; null where it isn't of the shape."""
    return F.from_json(F.regexp_replace(F.trim(answer), r"(?i)^```(?:json)?\s*|\s*```$", ""), schema)


def analysis(m: DataFrame, extract: Callable[[Column], Column] | None = None) -> DataFrame:
    """A JSON text for each conversation: its topics, the topic of each message, and its entities with their mentions."""
    from parlance.operators import entities

    clusters = topic_table(m).groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("topic_id", "label", "keywords", "size"))).alias("topic_clusters"))
    labels = topics(m).groupBy("upload_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("msg_index").cast("string").alias("k"), "topic")))).alias("topic_assignments"))
    found = entities.aggregate(m, extract).groupBy("upload_id", "family").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("display", "mentions")))).alias("e"))
    found = found.groupBy("upload_id").agg(F.struct(*[F.first(F.when(F.col("family") == k, F.col("e")), ignorenulls=True).alias(k) for k in entities.FAMILIES]).alias("entities"))
    rows = m.select("upload_id").distinct().join(clusters, "upload_id", "left").join(labels, "upload_id", "left").join(found, "upload_id", "left")
    return rows.select("upload_id", F.to_json(F.struct("topic_clusters", "topic_assignments", "entities")).alias("ai_analysis"))


def process(m: DataFrame, score: Callable[[Column], Column] = sentiment, feel: Callable[[Column], Column] = emotion, progress: Callable[[str, float], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """The stages over messages: texts are cleaned, then scored by the models; keywords become topics. Gives the messages with those columns, and each conversation's analysis.

    Rows that have a sentiment already keep what they have, so running it again goes on where it stopped. Rows that the
    models don't take (deleted, system, too short) stay as they are. progress hears of each stage as it is planned.
    """
    say = progress or (lambda stage, share: None)
    say("nlp_start", 0.0)
    text = F.coalesce(F.when(F.col("content_english") != "", F.col("content_english")), F.col("content"))
    todo = F.col("sentiment_label").isNull() & ~F.col("is_deleted") & ~F.col("msg_type").isin("deleted", "system") & (F.col("word_count") >= 3)
    rows = m.withColumn("_clean", F.when(todo, clean_for_models(text)))
    say("preprocess", 0.2)
    rows = rows.withColumn("_s", F.when(todo, score(F.col("_clean")))).withColumn("_e", F.when(todo, feel(F.col("_clean"))))
    rows = rows.withColumns({
        "sentiment_label": F.coalesce("sentiment_label", "_s.label"), "sentiment_score": F.coalesce("sentiment_score", "_s.score"),
        "emotion_label": F.coalesce("emotion_label", "_e.label"), "emotion_score": F.coalesce("emotion_score", "_e.score"),
    }).drop("_s", "_e", "_clean")
    say("per_message", 0.6)
    words = keywords(m).groupBy("upload_id", "msg_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("topics"))
    rows = rows.join(words, ["upload_id", "msg_index"], "left")
    say("conversation_topics", 0.85)
    out = analysis(m)
    say("entities", 0.95)
    return rows, out
