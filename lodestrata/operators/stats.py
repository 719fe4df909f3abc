"""Statistics as aggregates and windows: survival, cutoffs, confusion, reliability, TF-IDF, scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kaplan_meier(df: DataFrame, time: str, event: str, by: list[str]) -> DataFrame:
    """by, time, at_risk, events, survival, variance (Greenwood). Rows are counted by time first, so windows run over
    distinct times. Survival is 0 from a time at which all at risk have the event."""
    per = df.groupBy(*by, time).agg(F.count("*").alias("n"), F.sum(event).alias("events"))
    after = Window.partitionBy(*by).orderBy(F.desc(time))
    so_far = Window.partitionBy(*by).orderBy(time)
    per = per.withColumn("at_risk", F.sum("n").over(after))
    left = F.col("at_risk") - F.col("events")
    dead = F.max((left == 0).cast("int")).over(so_far) == 1
    log = F.sum(F.when(left > 0, F.log(left / F.col("at_risk"))).otherwise(0.0)).over(so_far)
    green = F.sum(F.when(left > 0, F.col("events") / (F.col("at_risk") * left)).otherwise(0.0)).over(so_far)
    per = per.withColumn("survival", F.when(dead, 0.0).otherwise(F.exp(log)))
    return per.select(*by, time, "at_risk", "events", "survival", (F.col("survival") * F.col("survival") * green).alias("variance"))


def gain_curve(df: DataFrame, score: str, label: str, hit: float, miss: float) -> DataFrame:
    """score, n, gain: profit of taking all rows at or above each score. Scores are counted first; the running sum is
    over distinct scores."""
    from lodestrata.operators.ranking import running

    per = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(label).alias("good"))
    per = running(per, [F.desc(score)], {"taken": F.col("n"), "hits": F.col("good")})
    return per.select(score, F.col("taken").alias("n"), (F.col("hits") * hit + (F.col("taken") - F.col("hits")) * miss).alias("gain"))


def tiered_cost(n, limit: int = 60_000, low: int = 5, high: int = 25):
    return F.when(n <= limit, n * low).otherwise(limit * low + (n - limit) * high)


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """label, precision, recall, f1, support of each true or predicted class."""
    c = confusion(df, truth, guess)
    a = c.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("tp"))
    b = c.groupBy(F.col(guess).alias("label")).agg(F.sum("n").alias("guessed"))
    j = a.join(b, "label", "full").fillna(0, ["support", "tp", "guessed"])
    p, r = F.coalesce(F.try_divide("tp", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return j.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def cronbach(df: DataFrame, items: list[str], by: list[str]) -> DataFrame:
    total = sum((F.col(i) for i in items[1:]), F.col(items[0]))
    parts = sum((F.var_samp(i) for i in items[1:]), F.var_samp(items[0]))
    k = len(items)
    return df.groupBy(*by).agg((k / (k - 1) * (1 - parts / F.var_samp(total))).alias("alpha"))


def tf_idf(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, term, weight: tf x (ln((1 + n) / (1 + df)) + 1), each document scaled to length 1."""
    n = docs.agg(F.count("*").alias("n")).scalar()  # a subquery: nothing runs while the plan is made
    tf = docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = tf.join(df_, "term").withColumn("raw", F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / norm).alias("weight"))


def min_max(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Columns scaled to 0..1 within groups; 0 where constant or not finite. Groups are aggregated, rows are not shuffled
    by them."""
    x = {c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in columns}
    j = _with_groups(df, by, [a for c in columns for a in (F.min(x[c]).alias(f"_lo_{c}"), F.max(x[c]).alias(f"_hi_{c}"))])
    lo, hi = lambda c: F.col(f"_lo_{c}"), lambda c: F.col(f"_hi_{c}")
    out = j.withColumns({c: F.coalesce(F.when(hi(c) > lo(c), (x[c] - lo(c)) / (hi(c) - lo(c))), F.lit(0.0)) for c in columns})
    return out.select(*df.columns)


def _with_groups(df: DataFrame, by: list[str], aggregates: list) -> DataFrame:
    """df with aggregates of its groups, a null key being a group; a partial aggregate and a join, so that Spark can broadcast the
    groups or split a large one."""
    groups = df.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(*aggregates)
    on = reduce(lambda a, b: a & b, [df[c].eqNullSafe(groups[f"_by_{c}"]) for c in by])
    return df.join(groups, on)


def z_scores(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    j = _with_groups(df, by, [a for c in columns for a in (F.avg(c).alias(f"_avg_{c}"), F.stddev_samp(c).alias(f"_sd_{c}"))])
    return j.withColumns({c: F.try_divide(F.col(c) - F.col(f"_avg_{c}"), F.col(f"_sd_{c}")) for c in columns}).select(*df.columns)


def survival_quartiles(curve: DataFrame, time: str, by: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """by, share, time: the first time of a Kaplan-Meier curve at which survival is 1 - share or less; null if it never is."""
    cols = [F.min(F.when(F.col("survival") <= 1 - s + 1e-12, F.col(time))).alias(f"q{i}") for i, s in enumerate(shares)]
    wide = curve.groupBy(*by).agg(*cols)
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"q{i}").alias("time")) for i, s in enumerate(shares)])))


def survival_bounds(curve: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """A Kaplan-Meier curve with lower and upper: its confidence bounds on the scale of log survival, 1 at most."""
    s = F.col("survival")
    half = z * F.sqrt("variance") / s
    return curve.withColumns({"lower": F.when(s > 0, s * F.exp(-half)), "upper": F.when(s > 0, F.least(F.lit(1.0), s * F.exp(half)))})


def restricted_mean(curve: DataFrame, time: str, by: list[str], upto: float) -> DataFrame:
    """by, mean: the area below each curve from 0 to upto."""
    w = Window.partitionBy(*by).orderBy(time)
    part = curve.where(F.col(time) < upto).select(*by, F.col(time).alias("_t"), "survival", F.coalesce(F.lead(time).over(w), F.lit(upto)).alias("_next"), F.row_number().over(w).alias("_r"))
    area = F.sum((F.least("_next", F.lit(upto)) - F.col("_t")) * F.col("survival")) + F.min("_t")
    return part.groupBy(*by).agg(area.alias("mean"))


def cluster_fit(sse: list[tuple[int, float]], n: int, width: int) -> list[tuple]:
    """k, sse, r2, semi-partial r2 (what the k-th cluster adds) and BIC of each (k, sse), k from 1 on."""
    import math

    total, out, last = sse[0][1], [], None
    for k, s in sse:
        r2 = 1 - s / total if total else 0.0
        out.append((k, s, r2, None if last is None else r2 - last, n * math.log(s / n) + k * (width + 1) * math.log(n) if s > 0 else None))
        last = r2
    return out
