"""Kinds of affection: candidates, their first matching kind, and each sender's shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.stats import by_upload, top

# Phrases of each kind, in the order in which the kinds are tried.
KINDS = {
    "words_of_affirmation": ("love you", "i love you", "miss you", "proud of you", "you're amazing", "you are amazing", "you're the best", "thank you for", "appreciate you", "grateful", "you're so", "such a good"),
    "acts_of_service": ("i'll do", "let me", "i'll grab", "i got you", "i got it", "on my way", "i'll pick", "i'll bring", "i'll handle", "i'll cook", "i'll drive", "let me know what i can", "took care of", "i remembered"),
    "quality_time": ("miss you", "wish you were", "can't wait to see", "let's", "tonight", "tomorrow", "this weekend", "spend time", "movie night", "date night", "be there soon", "hang out", "see you"),
    "physical_touch": ("hug", "hugs", "kiss", "kisses", "hold you", "cuddle", "snuggle", "wrap around", "in my arms", "hold your hand"),
    "gift_giving": ("got you", "i bought", "i ordered", "surprise", "i made you", "bringing you", "for you", "i picked up something"),
}
MOST = 200


def kind_of(text: Column) -> Column:
    """The first kind one of whose phrases is in the text; null if none is."""
    low = F.lower(text)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, phrases in KINDS.items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | low.contains(p)
        out = out.when(hit, F.lit(kind))
    return out


def stride_sample(rows: DataFrame, most: int = MOST) -> DataFrame:
    """At most so many rows of each conversation, evenly apart in order: row floor(i n / most) for each i."""
    n = F.count("*").over(Window.partitionBy("upload_id"))
    rows = rows.withColumns({"_rn": F.row_number().over(by_upload("msg_index")) - 1, "_n": n})
    # row r is taken if some i has floor(i n / most) = r: the least i with i n / most >= r gives it
    i = F.ceil(F.col("_rn") * most / F.col("_n"))
    taken = F.floor(i * F.col("_n") / F.lit(float(most))) == F.col("_rn")
    return rows.where((F.col("_n") <= most) | (taken & (i < most))).drop("_rn", "_n")


def candidates(m: DataFrame) -> DataFrame:
    rows = m.where("NOT is_deleted AND content <> '' AND sentiment_score > 0.3 AND emotion_label IN ('joy', 'love')")
    return stride_sample(rows)


def classified(m: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Candidates with their kind: by phrase, else by a model's answers (upload_id, msg_id, category), of which unknown messages and kinds don't count."""
    rows = candidates(m).withColumn("kind", kind_of(F.col("content")))
    if answers is not None:
        told = answers.where(F.col("category").isin(*KINDS)).groupBy("upload_id", "msg_id").agg(F.min("category").alias("_told"))
        rows = rows.join(told, ["upload_id", "msg_id"], "left").withColumn("kind", F.coalesce("kind", "_told")).drop("_told")
    return rows.where("kind IS NOT NULL")


def residual(m: DataFrame) -> DataFrame:
    """Candidates that no phrase tells, for a model to class."""
    c = candidates(m)
    return c.join(classified(m).select("upload_id", "msg_id"), ["upload_id", "msg_id"], "left_anti").select("upload_id", "msg_id", "sender", F.substring("content", 1, 400).alias("prompt"))


def report(m: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Each sender's messages and share of every kind, zeros too."""
    counts = classified(m, answers).groupBy("upload_id", "sender", "kind").agg(F.count("*").alias("n"))
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)])).alias("k")
    spine = m.select("upload_id", "sender").distinct().select("upload_id", "sender", kinds).select("upload_id", "sender", "k.place", "k.kind")
    rows = spine.join(counts, ["upload_id", "sender", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("upload_id", "sender"))
    return rows.withColumn("share", F.round(F.when(total > 0, F.col("n") / total).otherwise(0.0), 4))


def examples(m: DataFrame, k: int = 3) -> DataFrame:
    return top(classified(m), ["upload_id", "sender", "kind"], k, F.desc("emotion_score"), F.desc("timestamp"), "msg_index").select("upload_id", "sender", "kind", "rank", "msg_id")


def summary(m: DataFrame) -> DataFrame:
    """Each sender's first and second kind, in a sentence."""
    r = report(m)
    w = Window.partitionBy("upload_id", "sender").orderBy(F.desc("share"), "place")
    rows = r.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    two = rows.groupBy("upload_id", "sender").agg(*[F.max(F.when(F.col("rank") == i, F.struct("kind", "n", "share"))).alias(f"k{i}") for i in (1, 2)])
    label = lambda c: F.replace(F.col(f"{c}.kind"), F.lit("_"), F.lit(" "))
    percent = lambda c: F.concat(F.lit(" ("), F.round(F.col(f"{c}.share") * 100).cast("int"), F.lit("%)"))
    first = F.concat("sender", F.lit(" primarily expresses love through "), label("k1"), percent("k1"))
    text = F.when(F.col("k1.n") == 0, F.concat("sender", F.lit("'s expressions of love don't lean strongly into any single category yet."))).when(F.col("k2.n") == 0, F.concat(first, F.lit("."))).otherwise(F.concat(first, F.lit(" and "), label("k2"), percent("k2"), F.lit(".")))
    kind = lambda c: F.when(F.col(f"{c}.n") > 0, F.col(f"{c}.kind"))
    return two.select("upload_id", "sender", kind("k1").alias("primary_kind"), kind("k2").alias("secondary_kind"), text.alias("sentence"))
