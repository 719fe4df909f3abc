"""Very long texts with very many spans, and vectors of several lengths."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import ann, secrets


def by_hand(text, spans, mark="[secret]"):
    out, at = "", 0
    for s in sorted(spans):
        out += text[at : max(at, s[0])] + (mark if s[2] > at else "")
        at = max(at, s[2])
    return out + text[at:]


def test_spans_are_struck_out(spark):
    """Overlapping, nested, touching and repeated spans, more of them than a chunk, against plain slicing."""
    rng = random.Random(4)
    rows = []
    for n in (0, 1, 3, 255, 256, 257, 1500):
        text = "".join(rng.choice("abé😀 \n日z") for _ in range(2000))
        spans = [(a, rng.randrange(4), min(2000, a + rng.choice([0, 1, 3, 40, 300]))) for a in (rng.randrange(2000) for _ in range(n))]
        rows.append((text, spans))
    rows += [("abc", [(0, 0, 3)]), ("abc", [(0, 0, 2), (2, 0, 3)]), ("", [])]
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:long,kind:int,end:long>>")
    got = [r[0] for r in df.select(secrets.redacted(F.col("text"), F.col("spans"))).collect()]
    assert got == [by_hand(t, s) for t, s in rows]


def test_a_text_of_many_secrets(spark):
    rng = random.Random(5)
    model = secrets.train(secrets.labelled_samples(spark))
    value = lambda: "".join(rng.choices("abcdefghijkABC0123456789", k=24))
    text = " ".join(f"é words here token={value()} and {value()}/path" for _ in range(16_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = secrets.scan(df, model).select(F.size("secret_base").alias("n"), "secret_spans", secrets.redacted(F.col("text"), F.col("secret_spans")).alias("clean")).first()
    assert row.n == 16_000 and len(row.secret_spans) > 30_000 and time.time() - began < 60
    assert row.clean == by_hand(text, [(s.start, s.kind, s.end) for s in row.secret_spans])


def test_vectors_of_every_length_are_answered(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=[8, 8, 5, 3][i % 4]).tolist()) for i in range(400)] + [(1000, [1.0, 2.0]), (1050, [1.0])]
    got = {}
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, key string").repartition(3)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for i, v in rows:
        if i % 50:
            continue
        cos = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
        v32 = np.array(v, dtype=np.float32).astype(float)
        best = sorted((-cos(v32, np.array(w, dtype=np.float32).astype(float)), j) for j, w in rows if j != i and len(w) == len(v))[:5]
        found = sorted(got.get(i, []))
        assert [r for r, *_ in found] == list(range(1, len(best) + 1))
        hit, total = hit + len({j for _, j in best} & {j for _, j, _ in found}), total + len(best)
    assert hit >= 0.9 * total and 1000 not in got and 1050 not in got
