"""Language of messages by scripts and small word lists, all as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T

# Scripts by code points, word lists of each language, and the thresholds.
SCRIPTS = {
    "devanagari": r"\x{0900}-\x{097F}", "bengali_script": r"\x{0980}-\x{09FF}", "tamil": r"\x{0B80}-\x{0BFF}", "telugu": r"\x{0C00}-\x{0C7F}", "kannada": r"\x{0C80}-\x{0CFF}", "malayalam": r"\x{0D00}-\x{0D7F}",
    "arabic_script": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}", "hangul": r"\x{AC00}-\x{D7AF}", "han_chinese": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}", "cyrillic": r"\x{0400}-\x{04FF}",
}
LATIN = r"\x{0041}-\x{024F}"
TOKEN = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ']*"
LEXICONS = {
    "manglish": "alle aano aanu aarum anu athe athaano athu chetta chechi cheriya edaa eda eduthu ente entha evide ille illa ingane kunje machaane machaa mone ninte nee nokkam okke onnum polayadi polum raksha saare thanne theerthu ungal ungalal vannu veendum venam venda verum ariyam ariyilla undu unde undallo kandu thanikku thaane",
    "hinglish": "kya hai hain nahi nahin mera meri mere tera teri tere tum tumhe tumhare tumko yaar bhai bhaiya didi kar karna karke kiya raha rahi rahe hoga hogi hoge hota bahut bohot achha accha theek thik ho kuch kuchh kabhi abhi bhi sahi matlab samjha samjhi samajh pata pehle phir fir haan haa ji kyun kyu",
    "tanglish": "enna ennada ennama macha machi machaan thambi anna akka irukku iruken iruka irukan vanthuten varen vaa vendam venum puriyala puriyum romba konjam pannitu panren pannu panniten kekkanum kelu sollu solli yenna yethu ennachu amma appa ille illa irukka vada vandiya saaptiya saapdu tholaiya kavala",
    "tenglish": "enti ela evaru neevu neeku nenu naaku raa ra ree kani kaani ledu ledhu undi unde akkada ikkada ekkada vacchanu vasthunna vellanu chudu choodu chustha chustunna chesthe chesinav telusa telusu ardham manchidi kanapadu thondaraga annaya akkaya thammudu naanna amma vadu matlade matladu bagunnav bagunnaru",
    "bengali_roman": "ami tumi tui amar tomar amake tomake kemon achho achi bhalo bhalobasi kothay kothai korbo korchi korechi kore chilo chilam hobe hoye holo ki na kintu shob shei dada didi boudi khub khoob ektu ekta khabo khaichi berate amra tora ora",
    "french": "bonjour bonsoir salut merci oui non comme mais avec pour dans tout rien très bien alors aujourd'hui demain hier voilà toujours jamais beaucoup peu moins encore déjà où c'est j'ai fais",
    "spanish": "hola gracias por qué cómo está muy bien tiene tengo tienes estoy estás vamos voy puedo puede quiero quieres ahora después antes mañana hoy ayer hasta desde porque pero aunque todavía siempre nunca claro",
    "german": "hallo danke bitte ich du ist aber mit das der die den eine einen auch nicht schon schön gut ja nein wir ihr sie geht gehe haben habe hatte wäre würde kann können machen machst machts morgen heute gestern",
}
LEAST_HITS, LEAST_SHARE, SCRIPT_SHARE, MARGIN = 2, 0.15, 0.30, 0.04


def detect(text: Column) -> Column:
    """A struct (category, confidence). Fewer than three Latin words are too short to tell, whatever the script.

    Words, hits and their order are each worked out once; texts of ASCII alone have no letters of other scripts to count.
    """
    words = F.regexp_extract_all(F.lower(F.trim(text)), F.lit(f"({TOKEN})"), F.lit(1))
    result = lambda name, conf: F.struct(name.alias("category"), F.round(conf, 3).alias("confidence"))
    counts = F.array(*[F.struct(F.regexp_count(text, F.lit(f"[{r}]")).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("name")) for i, (k, r) in enumerate(SCRIPTS.items())])

    def of_script(c: Column) -> Column:
        letters = F.aggregate(c, F.regexp_count(text, F.lit(f"[{LATIN}]")), lambda s, x: s + x["n"])
        # the largest script; ties go to the one listed first
        return T.let(F.array_max(c), lambda best: F.when(best["n"] > 0, F.struct((best["n"] / letters).alias("share"), best["name"].alias("name"))))

    plain = F.octet_length(text) == F.length(text)
    script = F.when(~plain, T.let(counts, of_script))

    def of_words(w: Column) -> Column:
        n, distinct = F.size(w), F.array_distinct(w)
        each = T.let(distinct, lambda d: F.array(*[T.let(F.size(F.filter(d, lambda x: x.isin(*known.split()))), lambda h: F.struct((h / n).alias("share"), F.lit(-i).alias("order"), F.lit(k).alias("name"), h.alias("hits"))) for i, (k, known) in enumerate(LEXICONS.items())]))  # noqa: B023
        ranked = F.sort_array(F.filter(each, lambda h: (h["hits"] >= LEAST_HITS) & (h["share"] >= LEAST_SHARE)), False)
        return T.let(ranked, of_ranked)

    def of_ranked(r: Column) -> Column:
        first, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        return (
            F.when(F.size(r) == 0, result(F.lit("english"), F.lit(0.6)))
            .when(second.isNotNull() & (first["share"] - second["share"] <= MARGIN), result(F.lit("mixed_code_switched"), first["share"]))
            .otherwise(result(first["name"], first["share"]))
        )

    def of_text(w: Column) -> Column:
        told = T.let(script, lambda s: F.when(s["share"] >= SCRIPT_SHARE, result(s["name"], s["share"])).otherwise(of_words(w)))
        return F.when(F.size(w) <= 2, result(F.lit("too_short"), F.lit(0.0))).otherwise(told)

    return F.when(text.isNull(), result(F.lit("english"), F.lit(0.0))).otherwise(T.let(words, of_text))


def detected(m: DataFrame, text_col: str = "content") -> DataFrame:
    return m.withColumn("_d", detect(F.col(text_col))).select(*[c for c in ("upload_id", "msg_index", "doc_id") if c in m.columns], "_d.category", "_d.confidence")


def stats(m: DataFrame) -> DataFrame:
    """Messages of each category in each conversation."""
    return detected(m).groupBy("upload_id", "category").agg(F.count("*").alias("messages"))


# Messages of a sample, and the share of English or short ones from which on a conversation counts as English.
SAMPLE, ENGLISH = 200, 0.95
# ISO 639-1 codes of the categories that are one language.
CODES = {"english": "en", "french": "fr", "spanish": "es", "german": "de", "devanagari": "hi", "hinglish": "hi", "bengali_script": "bn", "bengali_roman": "bn", "tamil": "ta", "tanglish": "ta", "telugu": "te", "tenglish": "te", "kannada": "kn", "malayalam": "ml", "manglish": "ml", "arabic_script": "ar", "hangul": "ko", "han_chinese": "zh", "cyrillic": "ru"}


def sample(m: DataFrame, k: int = SAMPLE) -> DataFrame:
    """At most k messages of each conversation, by a hash of their place: the same ones on each run."""
    place = F.md5(F.concat_ws(":", F.col("upload_id").cast("string"), F.col("msg_index").cast("string")))
    w = Window.partitionBy("upload_id").orderBy(place, "msg_index")
    return m.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def english_uploads(m: DataFrame) -> DataFrame:
    """Conversations of whose sampled messages without a translation nearly all are English or too short to tell."""
    pending = sample(m.where("content_english IS NULL AND content IS NOT NULL").select("upload_id", "msg_index", "content"))
    like = F.col("category").isin("english", "too_short")
    return detected(pending).groupBy("upload_id").agg(F.avg(like.cast("int")).alias("share")).where(F.col("share") >= ENGLISH).select("upload_id")


def normalised(m: DataFrame, translate: Callable[[Column], Column] | None = None) -> DataFrame:
    """content_english, original_language and was_translated. Conversations whose sample is English are stamped as such; elsewhere translate turns what isn't English (and long enough to tell)."""
    rows = m.join(english_uploads(m).withColumn("_english", F.lit(True)), "upload_id", "left").withColumn("_english", F.coalesce("_english", F.lit(False)))
    rows = rows.withColumn("_d", F.when(F.col("_english"), F.lit(None)).otherwise(detect(F.col("content"))))
    category = F.coalesce("original_language", "_d.category", F.lit("english"))
    foreign = F.col("content_english").isNull() & ~F.col("_english") & ~F.col("_d.category").isin("english", "too_short") & (F.col("content") != "")
    new = F.when(foreign, translate(F.col("content"))) if translate is not None else F.lit(None).cast("string")
    changed = new.isNotNull() & (F.lower(F.trim(new)) != F.lower(F.trim("content")))
    return rows.withColumns({"original_language": category, "was_translated": F.coalesce(changed, F.lit(False)), "content_english": F.coalesce("content_english", new, "content")}).drop("_d", "_english")


def code(text: Column) -> Column:
    """Two letters for the language; unknown for texts of fewer than three characters and for mixtures."""
    codes = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.when(F.length(F.trim(text)) < 3, "unknown").otherwise(T.let(detect(text)["category"], lambda c: F.coalesce(F.try_element_at(codes, c), F.lit("unknown"))))
