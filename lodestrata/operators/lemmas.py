"""Words of texts without the stop words of their language, and lemmas: suffixes are detached by rules, and what remains counts
if a dictionary (a table) has it. A form is looked up once, however often it stands in the texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T

#: Words that carry no topic, by language.
STOP = {
    "en": (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
        "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
        "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
        "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
        "few more most other some such no nor not only own same so than too very can will just should now"
    ).split(),
    "fr": (
        "au aux avec ce ces cet cette dans de des du elle elles en et eux il ils je la le les leur leurs lui ma mais me même mes moi mon ne nos "
        "notre nous on ou où par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y "
        "suis es est sommes êtes sont étais était étions étiez étaient été être ai as avons avez ont avais avait avions aviez avaient eu avoir"
    ).split(),
}
#: Suffixes of plurals and what stands for them in the singular, by language.
RULES = {
    "en": [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "fr": [("s", ""), ("x", ""), ("aux", "al"), ("eaux", "eau"), ("ives", "if"), ("euses", "eux")],
}
#: Words that are more than one in so many of all are few by that alone: at most so many are broadcast.
OFTEN = 1000


def kept_words(text: Column, lang: Column, stop: dict[str, list[str]] = STOP, together: bool = False) -> Column:
    """Words of a text in lower case, ASCII punctuation and digits deleted, without the stop words of its language (together:
    of all languages). A null text has none; a language without a list, or null, keeps every word."""
    bare = T.without_marks(F.coalesce(text, F.lit("")))
    if together:
        return T.tokens(bare, sorted({w for words in stop.values() for w in words}))
    return reduce(lambda rest, l: F.when(lang == l, T.tokens(bare, stop[l])).otherwise(rest), stop, T.tokens(bare, []))


def counted(docs: DataFrame) -> DataFrame:
    """lang, word, n of rows with lang and words."""
    return docs.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def _detached(word: Column, rules: list[tuple[str, str]]) -> Column:
    cut = [F.when(word.endswith(a), F.concat(F.left(word, F.length(word) - len(a)), F.lit(b))) for a, b in rules]
    return F.filter(F.array(*cut), lambda x: x.isNotNull() & (x != ""))


def lemma_table(counts: DataFrame, dictionary: DataFrame, rules: dict = RULES, exceptions: DataFrame | None = None, depth: int = 2) -> DataFrame:
    """lang, word, lemma of the words in counts (lang, word, each pair once) whose lemma is another word.

    Candidates are the word itself and what one detached suffix leaves; where the dictionary (lang, word) has none of these, what
    a second one leaves, and so on to the depth. The shortest candidate it has is the lemma, ties to the earlier rule; a word
    without any, or in a language without rules, stays as it is. Words in exceptions (lang, word, lemma) have themselves
    and the lemmas there as candidates, and no rule holds for them."""
    once = lambda w: F.coalesce(*[F.when(F.col("lang") == l, _detached(w, r)) for l, r in rules.items()], F.array().cast("array<string>"))
    level = F.array(F.col("word"))
    steps = [F.transform(level, lambda w: F.struct(F.lit(0).alias("step"), w.alias("form")))]
    for step in range(depth):
        level = F.flatten(F.transform(level, once))
        steps.append(F.transform(level, lambda w: F.struct(F.lit(step).alias("step"), w.alias("form"))))  # noqa: B023
    forms = counts.select("lang", "word", F.posexplode(F.concat(*steps)).alias("place", "c")).select("lang", "word", "place", "c.step", "c.form")
    if exceptions is not None:
        told = exceptions.join(counts.select("lang", "word"), ["lang", "word"])
        told = told.select("lang", "word", F.explode(F.array("word", "lemma")).alias("form")).select("lang", "word", F.lit(0).alias("place"), F.lit(0).alias("step"), "form")
        forms = forms.join(exceptions.select("lang", "word").distinct(), ["lang", "word"], "left_anti").unionByName(told)
    known = forms.join(dictionary.select("lang", F.col("word").alias("form")).distinct(), ["lang", "form"])
    best = known.groupBy("lang", "word").agg(F.min_by("form", F.struct("step", F.length("form"), "place", "form")).alias("lemma"))
    return best.where("lemma <> word")


def lemmatized(docs: DataFrame, key: str, counts: DataFrame, lemmas: DataFrame) -> DataFrame:
    """key, lang, words of rows with these columns (key: not null, each once): each word replaced by its lemma, in order.

    Words that are over a thousandth of all, so under a thousand, meet their lemmas by broadcast where they stand; the
    others are joined by word, and none of them is a large share. Only the words of one text come together again."""
    rows = docs.select(key, "lang", F.posexplode_outer("words").alias("_pos", "word"))
    often = counts.where(F.col("n") * OFTEN > docs.agg(F.sum(F.size("words")).alias("n")).scalar()).select("lang", "word")
    often = often.join(lemmas, ["lang", "word"], "left").select(F.col("lang").alias("_l"), F.col("word").alias("_w"), F.coalesce("lemma", "word").alias("_to"))
    met = rows.join(F.broadcast(often), F.col("lang").eqNullSafe(F.col("_l")) & (F.col("word") == F.col("_w")), "left").drop("_l", "_w")
    # rows that need no lemma any more are spread over keys that no word has, so that they fill no one task
    spread = F.concat(F.lit(" "), F.pmod(F.xxhash64(key, "_pos"), F.lit(4096)))
    asked = met.withColumn("_w", F.coalesce(F.when(F.col("_to").isNull(), F.col("word")), spread))
    told = asked.join(lemmas.select("lang", F.col("word").alias("_w"), "lemma"), ["lang", "_w"], "left")
    one = F.when(F.col("word").isNotNull(), F.struct("_pos", F.coalesce("_to", "lemma", "word").alias("word")))
    whole = told.groupBy(key, "lang").agg(F.array_sort(F.collect_list(one)).alias("_p"))
    return whole.select(key, "lang", F.transform("_p", lambda p: p["word"]).alias("words"))
