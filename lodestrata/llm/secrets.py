"""Secret scan: patterns, and character Markov models of random strings against ordinary identifiers.

Native: regular expressions, higher-order functions over arrays, and one aggregate that trains the models;
documents are not shuffled. Base spans follow three patterns, leftmost and non-overlapping for each kind. The
method takes runs of MIN_RUN or more token characters, cuts the base spans out of them, and adds the pieces of
MIN_RUN or more whose log-likelihood ratio between two first-order character models is above a threshold. Of
other pieces it adds every stretch whose own ratio is above it, out to the next character that joins words, so
that ordinary words in a run do not outweigh a secret. The models count the character pairs of
labelled samples (1: random string, 0: ordinary identifier); their size is the square of the alphabet.

Edge cases: a null text counts as empty; a text without spans gets empty strings and the hash of the empty
string; positions are code points, ends exclusive; rows that share a doc_id are each scanned; no samples of a
label leave its model uniform; an empty table gives no rows; a text of any length is scanned whole; other columns are
carried as they are, whatever their names (but for secret_base and secret_spans, which are added).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.shared import text_or_empty

#: Fixed values of the contract: kind, pattern, the group that is measured, its least length.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
MARKOV = "markov"
MIN_RUN = 20
#: Least log-likelihood ratio (nats): secrets are rare, so evidence must outweigh odds of e^12 against.
THRESHOLD = 12.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(ALPHABET)
_CHUNK = 256

#: Ordinary words from which identifiers are made.
WORDS = """account action active address admin alpha amount answer array author balance batch before begin block body border
bottom branch bucket buffer build button cache call cancel card case category center change channel chapter check child city class
client close cloud cluster code column command comment common company complete config connect content context control cookie copy count
country create current customer data date day default delete delivery description design detail device dialog direct display document
domain download driver edit element email empty enable encode end engine enter entry error event example execute export factory feature
field file filter final find first folder footer form format forward frame function gateway general global graph group handle hash header
height help hidden history home host icon image import index info inner input insert instance invoice item job join key label language
last layer layout left length level library limit line link list load local location log login loop machine main manager map master max
media member memory menu message method middle mobile mode model module monitor month mouse name native network next node note notice
number object offset old open option order origin output owner package page panel parent parse part password path pattern payment people
phone photo picture place plan player point policy port position post power prefix press previous price print private process product
profile project property public query queue quick random range rate read record reference region register remote remove render report
request reset resource response result return right role root route row rule sample save scale schedule schema school scope score screen
script search second section security select sender sequence serial server service session setting shadow shape share shop show side
signal simple single size small sort source space special stack staff standard start state station status step stock stop storage store
stream string student style submit success summary support switch symbol system table target task team template test text theme thread
ticket time title token tool top total track transaction transfer tree trigger type update upload user valid value vector version video
view visible visit volume wait warning watch water weather web week weight welcome width window word work world write year zone""".split()


def labelled_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """token, label: random strings out of SHA-2 digests in usual encodings, and identifiers in usual styles."""
    i = F.col("id")
    words = F.split(F.lit(" ".join(WORDS)), " ")
    word = lambda k: F.element_at(words, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(WORDS))).cast("int") + 1)
    digest = F.unhex(F.sha2(i.cast("string"), 256))
    base64 = F.base64(digest)
    turned = [F.hex(digest), F.lower(F.hex(digest)), base64, F.translate(base64, "+/=", "-_"), F.translate(base64, "+/=", "Qk"), F.translate(F.upper(base64), "+/=", "2Z")]
    four = F.array(*[word(k) for k in range(4)])
    styles = [
        F.array_join(four, "_"), F.array_join(four, "-"), F.upper(F.array_join(four, "_")), F.array_join(four, "/"), F.array_join(four, ""),
        F.concat(word(0), *[F.initcap(word(k)) for k in range(1, 4)]), F.concat(*[F.initcap(word(k)) for k in range(4)]),
        F.concat_ws("_", word(0), word(1), F.pmod(i, F.lit(100)).cast("string")), F.concat_ws("-", word(0), F.lit("20") , word(2), F.lpad(F.pmod(i, F.lit(31)).cast("string"), 2, "0")),
        F.repeat(F.substring(F.lit(ALPHABET), F.pmod(F.xxhash64(i), F.lit(_SIZE)).cast("int") + 1, F.lit(1)), F.lit(24)),  # a line of one character
    ]
    pick = lambda xs: F.element_at(F.array(*xs), F.pmod(i, F.lit(len(xs))).cast("int") + 1)
    ids = spark.range(n)
    return ids.select(pick(turned).alias("token"), F.lit(1).alias("label")).unionByName(ids.select(pick(styles).alias("token"), F.lit(0).alias("label")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios, random to ordinary, of each pair of characters: row = first, column = second;
    the last row is for the first character of a token. Samples are token, label; other characters are skipped."""
    chars = F.filter(F.split(F.coalesce("token", F.lit("")), ""), lambda c: F.instr(F.lit(ALPHABET), c) > 0)
    numbers = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(F.concat(F.array(F.lit(_SIZE)), F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0)))), F.col("c"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counts = samples.where("label in (0, 1)").select("label", numbers.alias("c")).where("size(c) > 0").select("label", F.inline(pairs)).groupBy("label", "a", "b").count()
    seen = [[[smoothing] * _SIZE for _ in range(_SIZE + 1)] for _ in range(2)]
    for r in counts.collect():  # at most two tables of the alphabet's pairs
        seen[r.label][r.a][r.b] += r["count"]
    return [round(math.log(seen[1][a][b] / sum(seen[1][a])) - math.log(seen[0][a][b] / sum(seen[0][a])), 4) for a in range(_SIZE + 1) for b in range(_SIZE)]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Sum of the model's ratios over a token of the alphabet, in time linear in its length."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    zero = F.struct(F.lit(_SIZE).alias("at"), F.lit(0.0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        to = F.instr(F.lit(ALPHABET), c) - 1
        return F.struct(to.alias("at"), (acc["sum"] + F.get(table, acc["at"] * _SIZE + to)).alias("sum"))

    return F.aggregate(F.split(token, ""), zero, step, lambda acc: acc["sum"])


def random_stretches(token: Column, model: list[float], threshold: float, least: int) -> Column:
    """array<struct<start, end>> in a token of the alphabet, in time linear in its length: the whole if its ratio is
    above threshold, else stretches of at least least characters around sums above it; a sum ends where it is
    used up, or has lost more than threshold."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    spans = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(_SIZE).alias("at"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("now"), F.lit(0.0).alias("best"), F.lit(0).alias("start"), F.lit(0).alias("end"), spans.alias("out"))
    added = lambda acc, when: F.when(when & (acc["best"] > threshold), F.array_append(acc["out"], F.struct(acc["start"].alias("start"), acc["end"].alias("end")))).otherwise(acc["out"])

    def step(acc: Column, c: Column) -> Column:
        to = F.instr(F.lit(ALPHABET), c) - 1
        ratio = F.get(table, acc["at"] * _SIZE + to)
        now, n = acc["now"] + ratio, acc["n"] + 1
        over = (now <= 0) | (acc["best"] - now > threshold)
        best = F.when(over, 0.0).otherwise(F.greatest(acc["best"], now))
        end = F.when(now > acc["best"], n).otherwise(acc["end"])
        return F.struct(to.alias("at"), n.alias("n"), (acc["sum"] + ratio).alias("sum"), F.when(over, 0.0).otherwise(now).alias("now"), best.alias("best"), F.when(over, n).otherwise(acc["start"]).alias("start"), end.alias("end"), added(acc, over).alias("out"))

    def widened(s: Column) -> Column:
        word = lambda x: F.length(F.regexp_extract(x, "^[A-Za-z0-9]*", 0))
        before, after = F.reverse(F.substring(token, F.lit(1), s["start"])), F.substring(token, s["end"] + 1, F.lit(2**31 - 1))
        return F.struct((s["start"] - word(before)).alias("start"), (s["end"] + word(after)).alias("end"))

    def found(acc: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("start"), acc["n"].alias("end")))
        parts = F.array_distinct(F.transform(added(acc, F.lit(True)), widened))
        return F.when(acc["sum"] > threshold, whole).otherwise(F.filter(parts, lambda s: s["end"] - s["start"] >= least))

    return F.aggregate(F.split(token, ""), zero, step, found)


def _replaced(text: Column, spans: Column, mark) -> Column:
    """text with what the spans cover replaced: mark gives the text that stands for a span, of its struct and of the place up to
    which others before it reach. Spans are sorted and taken _CHUNK at a time, each time from the part of the text that
    they lie in, so neither the text nor the output is copied for each."""
    ordered = F.array_sort(spans)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _CHUNK)), lambda k: F.slice(ordered, (k * _CHUNK + 1).cast("int"), _CHUNK))
    reach = F.aggregate(chunks, F.array(F.lit(0).cast("long")), lambda acc, c: F.array_append(acc, F.greatest(F.element_at(acc, -1), F.array_max(F.transform(c, lambda s: s["end"])))))
    piece = lambda of, lo, hi: F.substring(of, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))

    def written(chunk: Column, at: Column) -> Column:
        part = piece(text, at, F.array_max(F.transform(chunk, lambda s: s["end"])))  # of what no chunk before it covers
        zero = F.struct(F.lit("").alias("out"), at.alias("at"), part.alias("part"))

        def step(acc: Column, s: Column) -> Column:
            kept = piece(acc["part"], acc["at"] - at, s["start"] - at)
            return F.struct(F.concat(acc["out"], kept, mark(s, acc["at"])).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"), acc["part"].alias("part"))

        return F.aggregate(chunk, zero, step, lambda acc: acc["out"])

    tail = piece(text, F.element_at(reach, -1), F.lit(2**31 - 1).cast("long"))
    done = F.concat(F.array_join(F.zip_with(chunks, F.slice(reach, 1, F.size(reach) - 1), written), ""), tail)
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _ends(lengths: Column) -> Column:
    """Running sums of an array, chunk by chunk so that appending stays cheap."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK)), lambda k: F.slice(lengths, (k * _CHUNK + 1).cast("int"), _CHUNK))

    def running(xs: Column, first: Column) -> Column:
        return F.aggregate(xs, F.array(first), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    sums = F.transform(chunks, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x))
    bases = running(sums, F.lit(0).cast("long"))
    return F.flatten(F.zip_with(chunks, F.slice(bases, 1, F.size(bases) - 1), lambda xs, b: F.slice(running(xs, b), 2, F.size(xs))))


def _spans(text: str, kind: int, pattern: str, group: int, least: int) -> tuple[dict[str, Column], ...]:
    """Columns in steps: matches and gaps, their ends, then array<struct<start, kind, end, token>>."""
    none, m, g, v, e = F.array().cast("array<string>"), f"m{kind}", f"g{kind}", f"v{kind}", f"e{kind}"
    has = F.col(text).rlike(pattern)
    first = {m: F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), g: F.when(has, F.split(text, pattern, -1)).otherwise(none)}
    if group:
        first[v] = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)
    step = F.zip_with(F.slice(g, 1, F.size(m)), F.col(m), lambda a, b: (F.length(a) + F.length(b)).cast("long"))
    second = {e: F.when(F.size(m) > 0, _ends(step)).otherwise(F.array().cast("array<long>"))}
    both = F.zip_with(F.col(m), F.col(e), lambda a, b: F.struct((b - F.length(a)).alias("start"), F.lit(kind).alias("kind"), b.alias("end"), a.alias("token")))
    measured = F.zip_with(both, F.col(v if group else m), lambda s, x: F.when(F.length(x) >= least, s))
    return first, second, {f"s{kind}": F.filter(measured, lambda s: s.isNotNull())}


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit(MARKOV))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, least: int = MIN_RUN) -> DataFrame:
    """docs (with column text) -> the same columns, and secret_base and secret_spans:
    array<struct<start, kind, end, token>>, the kind an index of assign, access, hex, markov, by start and kind."""
    steps = [_spans("_t", k, p, g, n) for k, (_, p, g, n) in enumerate(KINDS)]
    df = docs.select(F.struct("*").alias("_row"), text_or_empty().alias("_t"))  # so that no column clashes
    for k in range(3):
        df = df.withColumns({name: col for s in steps for name, col in s[k].items()})
    markov = f"s{len(KINDS)}"
    base = F.array_sort(F.concat(*[F.col(f"s{k}") for k in range(len(KINDS))]))
    df = df.withColumn("secret_base", base)
    # runs are sought in what the base spans leave: the text with blanks in their place
    blank = lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)).cast("int"))
    df = df.withColumn("_free", _replaced(F.col("_t"), F.col("secret_base"), blank))
    for columns in _spans("_free", len(KINDS), f"[A-Za-z0-9+/_=-]{{{least},}}", 0, least):
        df = df.withColumns(columns)

    def random(s: Column) -> Column:
        part = lambda r: F.struct((s["start"] + r["start"]).alias("start"), s["kind"].alias("kind"), (s["start"] + r["end"]).alias("end"), F.substring(s["token"], r["start"] + 1, r["end"] - r["start"]).alias("token"))
        return F.transform(random_stretches(s["token"], model, threshold, least), part)

    added = F.when(F.size(markov) > 0, F.flatten(F.transform(markov, random))).otherwise(F.col(markov))
    return df.withColumn("secret_spans", F.array_sort(F.concat("secret_base", added))).select("_row.*", "secret_base", "secret_spans")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with what the spans cover, overlaps merged, replaced by mark."""
    return _replaced(text, spans, lambda s, at: F.when(s["end"] > at, F.lit(mark)).otherwise(""))


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of scan()'s rows."""
    kinds = F.col("secret_base.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)]
    return scanned.select("doc_id", *counts, F.sha2(_written(F.col("secret_base")), 256).alias("base_sha256"), _written(F.col("secret_spans")).alias("spans"))
