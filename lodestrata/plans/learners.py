"""Queries of the fitted models that go over the data many times: forests, machines, selection, hazards, factors, subsets.

SQL can't express the fits; tests hold each against NumPy, enumeration or planted values. Labels are those of the table of labels,
features twelve measures of the texts of all documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import factoring, forest, hazards, kernels, selection, subsets
from lodestrata.plans.registry import query

MEASURES = ["log_chars", "word_length", "digits", "letters", "signs", "capitals", "distinct", "line_length", "bars", "stops", "shouts", "last_word"]


def measured(docs, *carry: str):
    """The columns carried, and MEASURES of each text; a null text counts as empty. Persisted: texts are measured once, and no
    filter on a measure is moved before it, where each mention would measure the text again."""
    d = docs.select(*carry, F.coalesce("text", F.lit("")).alias("_t")).withColumn("_w", F.split("_t", r"\s+"))
    words, chars = F.size("_w"), F.greatest(F.length("_t"), F.lit(1))
    parts = lambda c: F.length("_t") - F.length(F.replace(F.col("_t"), F.lit(c), F.lit(""))) + 1
    of = {
        "log_chars": F.log1p(F.length("_t")), "word_length": F.length("_t") / words, "digits": X.digit_ratio(F.col("_t")), "letters": X.alpha_ratio(F.col("_t")), "signs": X.non_alnum_ratio(F.col("_t")),
        "capitals": (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}", ""))) / chars, "distinct": F.size(F.array_distinct("_w")) / words, "line_length": F.log1p(F.length("_t") / parts("\n")),
        "bars": parts("|") / words, "stops": parts(".") / words, "shouts": parts("!") / words, "last_word": F.log1p(F.length(F.element_at("_w", -1))),
    }
    return d.select(*carry, *[F.coalesce(F.nanvl(of[c].cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in MEASURES]).persist()


def labelled(t, label: str):
    """Measures of all documents, with the worst label of those that have one."""
    worst = (F.min if label == "quality" else F.max)(label)
    y = t("labels").where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(worst.cast("double").alias("label"))
    m = measured(t("documents"), "doc_id")
    return m.join(y, F.col("doc_id") == F.col("_id"), "left").drop("_id")


@query("ml8_forest_by_leaves")
def forest_by_leaves(t):
    """Trees of 30 leaves, best leaf first, with the probability of a good document."""
    d = labelled(t, "quality")
    m = forest.fit(d, MEASURES, "label", "doc_id", trees=60, leaves=30, tried=4)
    return m.predict(d).select("doc_id", F.round(F.try_element_at("probability", F.lit(-1)), 9).alias("p"), "prediction")


@query("ml7_forest_balanced")
def forest_balanced(t):
    """Trees of depth 20 and any number of leaves, classes weighing alike."""
    d = labelled(t, "toxic")
    m = forest.fit(d, MEASURES, "label", "doc_id", trees=60, leaves=None, depth=20, balanced=True, tried=4, splits=256)
    return m.predict(d).select("doc_id", F.round(F.try_element_at("probability", F.lit(-1)), 9).alias("p"), "prediction")


@query("ml6_svm_search")
def svm_search(t):
    """The accuracy of each kernel and C on a third of the labelled documents, and the predictions of the best."""
    d = labelled(t, "quality").withColumn("valid", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    m = kernels.search(d, MEASURES, "label", "valid", gammas=(0.02, 0.1, 0.5), cs=(0.01, 0.1, 1.0))
    best = max(a for *_, a in m.tried)
    return m.predict(d).select("doc_id", F.lit(m.kernel.name).alias("kernel"), F.lit(m.c).alias("c"), F.lit(round(best, 6)).alias("accuracy"), "prediction")


@query("ml13_subset_search")
def subset_search(t):
    """The best subset of the twelve measures for good documents, generation by generation."""
    history, _ = subsets.genetic(labelled(t, "quality").where("label is not null"), MEASURES, "label", population=30, patience=4)
    return t("labels").sparkSession.createDataFrame([(g, ",".join(c), float(v)) for g, c, v in history], "generation int, columns string, bic double")


@query("ml16_selection")
def heckman(t):
    """Whether a customer ordered in 1995, and for how much: both equations by their joint likelihood, applied to every customer."""
    spent = t("orders").where("year(o_orderdate) = 1995").groupBy(F.col("o_custkey").alias("_k")).agg(F.sum("o_totalprice").alias("spent"))
    segment = [F.coalesce(F.col("c_mktsegment") == s, F.lit(False)).cast("double").alias(f"s{i}") for i, s in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"))]
    c = t("customer").join(spent, F.col("c_custkey") == F.col("_k"), "left").select("c_custkey", (F.col("c_acctbal") / 1e4).alias("balance"), *segment, F.col("_k").isNotNull().cast("int").alias("chosen"), (F.col("spent") / 1e5).alias("spent"))
    m = selection.Heckman(c, ["balance", "s0", "s1", "s2", "s3"], ["balance"], "chosen", "spent").likelihood()
    return m.predict(c).select("c_custkey", *[F.round(n, 6).alias(n) for n in ("probability", "outcome", "expected")], F.lit(round(m.rho, 6)).alias("rho"))


def _lives(t):
    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    j = j.select(F.date_diff("l_shipdate", "o_orderdate").alias("time"), (F.col("l_linestatus") == "F").cast("int").alias("event"), (F.col("l_discount") > 0.05).cast("double").alias("discounted"), F.col("l_returnflag").alias("plan")).where("time > 0")
    held = j.groupBy(*j.columns).agg(F.count("*").alias("rows")).persist()  # joined once
    return held, *hazards.dummies(held, "plan", "R")


@query("ml22_ml23_cox_covariates")
def cox(t):
    """Coefficients with Wald bounds, the likelihood ratio, and for each covariate and all together the test of proportional hazards."""
    held, d, plans = _lives(t)
    names = [*plans, "discounted"]
    m = hazards.Cox(d, "time", "event", names, weight="rows")
    held.unpersist()
    (lr, _, p), tests = m.likelihood_ratio(), m.schoenfeld()
    rows = [(n, float(b), float(s), float(np.exp(b - 1.959963984540054 * s)), float(np.exp(b + 1.959963984540054 * s)), x, q) for n, b, s, (x, _, q) in zip(names, m.beta, m.se, tests, strict=False)]
    rows.append(("all", None, None, None, None, tests[-1][0], tests[-1][2]))
    found = t("nation").sparkSession.createDataFrame(rows, "covariate string, beta double, se double, ratio_low double, ratio_high double, schoenfeld double, schoenfeld_p double")
    return found.withColumns({"likelihood_ratio": F.lit(lr), "p": F.lit(p)})


@query("ml19_factors_ml")
def factors(t):
    """Three to six factors of the measures: their criteria, and loadings turned by promax."""
    m = measured(t("documents"))
    r, n = factoring.correlations(m, MEASURES)
    m.unpersist()
    rows = []
    for k in range(3, 7):
        f = factoring.Factors(r, n, k)
        rows += [(k, c, i + 1, float(f.oblique[j, i]), float(f.uniquenesses[j]), float(f.aic), float(f.bic)) for j, c in enumerate(MEASURES) for i in range(k)]
    return t("documents").sparkSession.createDataFrame(rows, "factors int, measure string, factor int, loading double, uniqueness double, aic double, bic double")
