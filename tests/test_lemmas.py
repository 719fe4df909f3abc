"""Stop words and lemmas against plain Python, on hand-made and random words."""

import random

from pyspark.sql import functions as F

from lodestrata.operators import lemmas as L

DOCS = "doc_id long, lang string, text string"


def plain_lemma(word, rules, known, depth=2):
    found, level = [word] if word in known else [], [word]
    for step in range(depth):
        level = [x for w in level for a, b in rules if w.endswith(a) and (x := w[: len(w) - len(a)] + b)]
        found += [x for x in level if x in known]
        if found:
            return min(found, key=len)
    return word


def lemmas_of(spark, words, known, exceptions=None):
    counts = spark.createDataFrame([(l, w, 1) for l, w in words], "lang string, word string, n long")
    told = exceptions and spark.createDataFrame(exceptions, "lang string, word string, lemma string")
    return {(r.lang, r.word): r.lemma for r in L.lemma_table(counts, spark.createDataFrame(known, "lang string, word string"), exceptions=told or None).collect()}


def test_rules_by_language(spark):
    known = [("en", w) for w in "box church man lady glass bus child wolf axe ax".split()] + [("fr", "cheval"), ("fr", "gâteau"), ("de", "haus")]
    words = [("en", w) for w in "boxes churches men ladies glass bus children wolves axes oxes s".split()] + [("fr", "chevaux"), ("fr", "gâteaux"), ("fr", "boxes"), ("de", "hauss"), (None, "boxes")]
    got = lemmas_of(spark, words, known)
    assert got == {("en", "boxes"): "box", ("en", "churches"): "church", ("en", "men"): "man", ("en", "ladies"): "lady", ("en", "wolves"): "wolf", ("en", "axes"): "ax", ("fr", "chevaux"): "cheval", ("fr", "gâteaux"): "gâteau"}
    # an exception takes the place of the rules, for its language alone
    got = lemmas_of(spark, [*words, ("fr", "children")], known, [("en", "children", "child"), ("en", "axes", "axe"), ("en", "boxes", "nothing")])
    assert got[("en", "children")] == "child" and got[("en", "axes")] == "axe" and ("en", "boxes") not in got and ("fr", "children") not in got


def test_second_suffix_only_where_the_first_finds_nothing(spark):
    assert lemmas_of(spark, [("en", "boxess")], [("en", "box")]) == {("en", "boxess"): "box"} == {("en", "boxess"): plain_lemma("boxess", L.RULES["en"], {"box"})}
    assert lemmas_of(spark, [("en", "boxess")], [("en", "box"), ("en", "boxes")]) == {("en", "boxess"): "boxes"}


def test_random_words_as_in_python_with_a_hot_word(spark):
    r = random.Random(5)
    made = ["".join(r.choice(["s", "es", "xe", "ch", "ie", "ma", "men", "v", "aux", "e"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    texts = [(i, r.choice(["en", "fr", "de", None]), " ".join(r.choice(["hotses", r.choice(made)]) for _ in range(r.randint(0, 60)))) for i in range(150)]
    docs = spark.createDataFrame(texts, DOCS).withColumn("words", F.filter(F.split("text", " "), lambda w: w != "")).drop("text").repartition(7)
    known = {l: {w for w in made if r.random() < 0.5} | {"hots"} for l in ("en", "fr", "de")}
    counts = L.counted(docs)
    table = L.lemma_table(counts, spark.createDataFrame([(l, w) for l, ws in known.items() for w in ws], "lang string, word string"))
    got = {x.doc_id: x.words for x in L.lemmatized(docs, "doc_id", counts, table).collect()}
    assert got == {i: [plain_lemma(w, L.RULES.get(l, []), known.get(l, set())) for w in t.split()] for i, l, t in texts}
    assert counts.where("word = 'hotses'").agg(F.sum("n")).first()[0] * 3 > counts.agg(F.sum("n")).first()[0]


def test_stop_words_empty_texts_and_tables(spark):
    rows = [(1, "en", "The CATS, and\tthe dogs2 of les"), (2, "fr", "Les chats et the des été"), (3, "de", "the und"), (4, None, "the a"), (5, "en", None), (6, "fr", " \n "), (7, "en", "of the")]
    docs = spark.createDataFrame(rows, DOCS)
    kept = lambda **k: {r.doc_id: r.w for r in docs.select("doc_id", L.kept_words(F.col("text"), F.col("lang"), **k).alias("w")).collect()}
    assert kept() == {1: ["cats", "dogs", "les"], 2: ["chats", "the"], 3: ["the", "und"], 4: ["the", "a"], 5: [], 6: [], 7: []}
    assert kept(together=True) == {1: ["cats", "dogs"], 2: ["chats"], 3: ["und"], 4: [], 5: [], 6: [], 7: []}
    words = docs.select("doc_id", "lang", L.kept_words(F.col("text"), F.col("lang")).alias("words"))
    for d in (words, words.limit(0)):
        c = L.counted(d)
        out = L.lemmatized(d, "doc_id", c, L.lemma_table(c, c))
        assert {r.doc_id: r.words for r in out.collect()} == {r.doc_id: r.words for r in d.collect()}
