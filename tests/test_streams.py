"""Micro-batches merged into versions, and workflow states over a stream, against plain folds; also after restarts and replays."""

import random

from lodestrata.streaming import states, windows

MOVES = {"waiting": ["admitted", "closed"], "admitted": ["treated", "closed"], "treated": ["admitted", "closed"], "closed": []}


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_merging_is_idempotent(spark, tmp_path):
    schema, source, table = "id long, value string, n int", tmp_path / "in", str(tmp_path / "table")
    batches = [[(1, "a", 1), (2, "b", 1), (None, "none", 1)], [(1, "a2", 2), (3, "c", 2), (3, "c", 3)], [(2, "b3", 3), (None, None, 3)]]

    def run(checkpoint):
        q = states.merging(windows.landed(spark, str(source), schema, 1), table).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    def now():
        return sorted(((r.id, r.value, r.n, r.batch, r.versions) for r in states.merged(spark.read.parquet(table), ["id"]).collect()), key=repr)

    for rows in batches:
        land(spark, source, rows, schema)
        run("one")
    want = sorted([(1, "a2", 2, 1, 2), (2, "b3", 3, 2, 2), (3, "c", 3, 1, 1), (None, None, 3, 2, 2)], key=repr)
    assert now() == want
    run("one")  # nothing new
    assert now() == want
    run("two")  # a lost checkpoint: all batches run again, by the same numbers
    assert now() == want and spark.read.parquet(table).count() == sum(map(len, batches))
    assert states.merged(spark.read.parquet(table).where("false"), ["id"]).count() == 0


def test_states_over_a_stream(spark, tmp_path):
    schema, source, out, checkpoint = "user long, status string, at int, extra string", tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*MOVES, None, "unknown"] if rng.random() < 0.9 else ["admitted"]), i, "x") for i in range(120)]
    for lo in (0, 40, 80):  # the query ends after each and starts again from its checkpoint
        part = rows[lo : lo + 40]
        rng.shuffle(part)
        land(spark, source, part, schema)
        found = states.enforced(windows.landed(spark, str(source), schema, 1), "user", "status", ["at"], "waiting", MOVES)
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    now, want = {}, []
    for user, status, at, _ in rows:
        state = now.get(user, "waiting")
        fine = status in MOVES[state]
        now[user] = status if fine else state
        want.append((user, at, status, fine, now[user]))
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=lambda r: r[1]) == want and any(w[3] for w in want) and not all(w[3] for w in want)
