"""Text columns: tokens, emoji, links, counts. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token, link and emoji patterns of the message schema.
WORD = r"[A-Za-z][A-Za-z']{1,}"
LINK_STRIPPED = r"(?i)https?://\S+|www\.\S+"
LINK = r"(?i)\b(?:https?://|www\.)[^\s<>\"'\)]+"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"

# Words that counts of a sender's favourite words leave out.
STOPWORDS = (
    "a an the and or but if so as of to in on at for with from by is am are was were be been being do does did doing have has had having "
    "i me my we us our you your yours he she him her his hers it its they them their this that these those there here where when what who "
    "whom which why how not no yes yeah ok okay k kk lol haha hehe u ur im ill ive id youre youve youll thats well now just still also too "
    "even very really kinda like than then into out up down off over under again more most much many few any some all will would could "
    "should may might can must shall let got get go going went"
).split()

# Words that word statistics, conflict words and the triage of queries leave out beside most of those above.
_MORE = (
    "while without onto done mine myself ours ourselves yourself yourselves himself herself itself theirs themselves whose nor neither either such only own "
    "same ever never always yet though although however therefore above below between through during before after until since about against along among "
    "around behind beside gone say said says tell told tells think thought thinks make made makes see saw seen know knew known come came take took taken "
    "give gave given want wanted wants need needed needs look looked looking find found way ways thing things stuff people person day days today tomorrow "
    "yesterday year years time times good great nice fine okok yea ya yep yup nah nope hmm hmmm uhh uhm uhmm umm ummm hahah hahaha lolol lolz rofl lmao "
    "lmfao hehee hihi omg omfg wtf wth smh uve uhv youd whats whos wheres isnt arent wasnt werent havent hasnt hadnt dont doesnt didnt cant cannot couldnt "
    "wouldnt shouldnt wont shant btw imo idk idc fyi tbh ngl lmk rn asap atm irl tldr msg txt oh ah eh uh huh wow ohh ohhh thx thnx ty tyvm tysm pls plz "
    "please sorry soz bye byebye byee hi hii hiii hey heyy heyyy heyo yo hello helo"
).split()
_STILL_COUNTED = ('really', 'kinda', 'like')
CONTENT_STOPWORDS = [*[w for w in STOPWORDS if w not in _STILL_COUNTED], *_MORE]


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Words of two or more letters and apostrophes, in lower case and in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def tokens_without_links(text: Column) -> Column:
    return tokens(F.regexp_replace(text, LINK_STRIPPED, " "))


def emojis(text: Column) -> Column:
    """One element for each code point of the emoji blocks."""
    return F.regexp_extract_all(text, F.lit(f"({EMOJI})"), F.lit(1))


def has_link(text: Column) -> Column:
    return text.rlike(LINK)


def word_count(text: Column) -> Column:
    """Runs of other characters than Unicode white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def char_count(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def bigrams(words: Column) -> Column:
    """Adjacent pairs of an array's elements as structs (first, second); empty for fewer than two."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(a.alias("first"), b.alias("second")))
    return F.filter(pairs, lambda p: p["second"].isNotNull())


def in_list(word: Column, words: list[str]) -> Column:
    return word.isin(*words)


def is_question(text: Column) -> Column:
    return text.rlike(r"\?\s*$")


def is_exclamation(text: Column) -> Column:
    return text.rlike(r"!\s*$")


def contains_word(text: Column, word: str) -> Column:
    """Whether the whole word is in the text, whatever its case."""
    escaped = "".join(f"\\{c}" if not c.isalnum() and ord(c) < 128 else c for c in word.strip().lower())
    return F.lower(text).rlike(rf"(?<!\w){escaped}(?!\w)")


def preview(text: Column, n: int = 200) -> Column:
    """Trimmed; cut to n characters with an ellipsis if longer."""
    t = F.trim(text)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.left(t, F.lit(n))), F.lit("…"))).otherwise(t)
