"""Quality rules with risk-controlled thresholds.

Native: text measures are array expressions within each row, and thresholds come from counts. A rule rejects
a text whose measure is above a cutoff. Cutoffs are chosen for each stratum from a fixed ladder with labelled
rows as holdout: the ladder is walked from the laxest cutoff to strict ones, and a cutoff stands as long as
an exact binomial test shows at level DELTA, corrected for the number of strata and rules (Bonferroni; the
walk in fixed order needs no more), that the rule rejects less than ALPHA / rules of good texts. Then, with
confidence 1 - DELTA over all strata, the rules together wrongly reject less than ALPHA of the good texts
of every stratum. Among the cutoffs that stand, the laxest with the most labelled bad texts rejected, less good ones, is taken. A
stratum with too few labels for any proof has no cutoffs, so nothing there is rejected but by base rules.

Edge cases: a null text has no words and fails the base rule; a null stratum is a stratum of its own;
documents without labels only get verdicts; of several labels of a document the worst counts; rows that
share a doc_id are judged each on its own; a text of any length is judged whole; empty tables give no rows, and no labels no cutoffs; other columns
are ignored. Windows are compared by 64-bit hashes of their five words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import keep, text_or_empty, words_of

WINDOW = 5
ALPHA = 0.05
DELTA = 0.05
#: Rules: a measure of a text, and its cutoffs from the laxest to the strictest.
RULES = {
    "symbols": [3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "repeats": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "capitals": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "word_length": [100.0, 60.0, 40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0],
}


def measures(docs: DataFrame) -> DataFrame:
    """docs (with column text) -> the same columns, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals."""
    own = docs.columns
    df = docs.withColumn("_t", text_or_empty()).withColumn("_w", words_of(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    windows = F.when(F.size("_w") >= WINDOW, F.transform(F.slice("_w", 1, F.size("_w") - (WINDOW - 1)), lambda w, i: F.xxhash64(w, *[F.get("_w", i + k) for k in range(1, WINDOW)])))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"), "word_chars": F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long"),
        "n_capitals": (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}+", ""))).cast("long"),
        "_l": lines, "_h": F.coalesce(windows, F.array().cast("array<long>")),
    })
    df = df.withColumns({"n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "_d": F.size(F.array_distinct("_h")) < F.size("_h")})
    # each step below reads a column of the step before: an expression inside a lambda would be made anew for each element
    placed = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_s", F.when(F.col("_d"), F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:long,i:int>>")))
    same = F.filter("_s", lambda x, k: (F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"]))
    df = df.withColumn("_e", same).withColumn("_r", F.sort_array(F.col("_e.i")))
    cover = F.aggregate(F.transform("_r", lambda p, k: F.least(F.coalesce(F.get("_r", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", cover.cast("long")).select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")


def with_rules(measured: DataFrame) -> DataFrame:
    """measures() and base_failed, and the measure of each rule."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    of = {"symbols": F.col("n_symbols") / words, "repeats": F.col("n_repeat_words") / words, "capitals": F.col("n_capitals") / chars, "word_length": F.col("word_chars") / words}
    return measured.withColumns({k: of[k] for k in RULES}).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _log_factorial(n: Column) -> Column:
    """ln n!: a table below 20, Stirling's series from there on."""
    few = F.get(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(20)]), F.least(n, F.lit(19)).cast("int"))
    x = n.cast("double")
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < 20, few).otherwise(x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact but for rounding: the terms from k on away from the mean, as ratios to the first.
    Beyond 40 standard deviations they add nothing to a double, so their number grows with the root of n alone."""
    q = 1 - p
    low = k < n * p  # else 1 - P(Bin >= k + 1)
    i = F.when(low, k).otherwise(k + 1)
    first = _log_factorial(n) - _log_factorial(i) - _log_factorial(n - i) + i * math.log(p) + (n - i) * math.log1p(-p)
    terms = F.least(F.when(low, i).otherwise(n - i), F.ceil(40 * F.sqrt(n * (p * q))).cast("long") + 60)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        down, up = (i - j) * q / ((n - i + j + 1) * p), (n - i - j) * p / ((i + j + 1) * q)
        term = acc["term"] * F.when(low, down).otherwise(up)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(terms > 0, F.sequence(F.lit(0).cast("long"), terms - 1)).otherwise(F.array().cast("array<long>"))
    tail = F.exp(first) * F.aggregate(steps, zero, step, lambda acc: acc["sum"])
    return F.when(k >= n, F.lit(1.0)).otherwise(F.least(F.when(low, tail).otherwise(1 - tail), F.lit(1.0)))


def thresholds(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff, n_good, rejected_good, rejected_bad from rows of stratum, quality and measures
    that passed the base rules; no row for a rule that nothing in its stratum proves safe."""
    # rows are counted by the number of steps each rule rejects them at, before anything is multiplied by steps
    depth = [sum((F.col(r) > c).cast("int") for c in cs).alias(f"d_{r}") for r, cs in RULES.items()]
    good = (F.col("quality") == 1).cast("long")
    counts = keep(labelled.select("stratum", "quality", *depth).groupBy("stratum", *[f"d_{r}" for r in RULES]).agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad")), "counts")
    steps = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), (F.col(f"d_{r}") >= len(cs) - i).alias("hit")) for r, cs in RULES.items() for i, c in enumerate(cs)])
    table = counts.select("stratum", "good", "bad", F.inline(steps)).groupBy("stratum", "rule", "step", "cutoff").agg(F.sum("good").alias("n_good"), F.sum(F.when(F.col("hit"), F.col("good")).otherwise(0)).alias("rejected_good"), F.sum(F.when(F.col("hit"), F.col("bad")).otherwise(0)).alias("rejected_bad"))
    strata = max(1, counts.select("stratum").distinct().count())
    table = table.withColumn("level", F.lit(delta / (strata * len(RULES))))
    walk = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    safe = binomial_tail(F.col("rejected_good"), F.col("n_good"), alpha / len(RULES)) <= F.col("level")
    table = table.withColumn("safe", safe).withColumn("stands", F.min(F.col("safe").cast("int")).over(walk) == 1).where("stands")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc(F.col("rejected_bad") - F.col("rejected_good")), "step")
    return table.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("stratum", "rule", "cutoff", "n_good", "rejected_good", "rejected_bad")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    measured = keep(with_rules(measures(docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text")).drop("text")), "measures")
    truth = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cuts = thresholds(measured.where("not base_failed").join(truth, "doc_id"), alpha, delta)
    cuts = keep(cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts")), "cutoffs")
    joined = measured.join(cuts.withColumnRenamed("stratum", "of"), F.col("stratum").eqNullSafe(F.col("of")), "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.try_element_at("cuts", F.lit(r)), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"))
