"""Chat formatting by quotation linking.

A line that starts with one or more ">" is quoted, its level their number; consecutive quoted lines of a level
are a passage. Passages are normalised (lower case, white space collapsed, blank ones skipped) and hashed; so
are the lines and the whole of what each message says itself. A message replies to the message of its
conversation, said before it, that holds the text of its first linked passage of the lowest level; deeper
levels are what that message quoted in turn. A message whose quotes link nowhere, or that has none, starts a
thread. Quotes are then dropped, and messages are ordered as replies: every message follows the one it
replies to, threads and siblings in the order of turns.

Scale: quoted passages meet what was said by (conversation, hash), each side reduced first to one row, the
earliest, for each hash; nothing is paired within a conversation. The lines of a text are read in linear time. Replies
are put in order by ranking a list: every message of a thread has an enter and an exit, in the order of a walk through
the replies, and each points to the next; pointers are doubled until they reach the end of the thread, so a row stays
small however long the chain, after as many rounds as the logarithm of the longest thread, each written to the shared
folder. No two rows point to the same row, so no key is hot; siblings are found over ranges of the sorted replies.

Edge cases: null and blank texts say nothing and are kept; a null role is kept; rows without conv_id or turn
are kept and linked to nothing (depth 0); rows that share conv_id and turn are one message for links, with the
quotes and words of all, and all are kept; empty tables give no rows; a text of any length is one message; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import forget, keep, text_or_empty

QUOTED = r"^[ \t]*>"
MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def _normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, said (the text without quotes), quotes: array<struct<at, level, hash>>, and
    own: array<long>, the hashes of what it says."""
    lines = F.transform(F.split(text_or_empty(), "\r?\n"), lambda x: F.struct(
        F.when(x.rlike(QUOTED), F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), r"[^>]", ""))).otherwise(0).alias("level"),
        F.when(x.rlike(QUOTED), F.regexp_replace(x, MARKS, "")).otherwise(x).alias("line")))
    df = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("lines", lines)
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    plain = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    df = df.withColumn("said", F.when(quoted, F.btrim(plain, F.lit("\n"))).otherwise(text_or_empty()))
    # lines at which the level changes, the first and one past the last among them; passages run from one to the next
    changes = F.filter(F.transform("lines", lambda x, i: F.when((i == 0) | (F.get("lines", i - 1)["level"] != x["level"]), i)), lambda i: i.isNotNull())
    df = df.withColumn("changes", F.when(quoted, F.concat(changes, F.array(F.size("lines")))).otherwise(F.array().cast("array<int>")))
    spans = F.zip_with(F.slice("changes", 1, F.greatest(F.size("changes") - 1, F.lit(0))), F.slice("changes", 2, F.size("changes")), lambda s, e: F.struct(s.alias("at"), e.alias("end"), F.get("lines", s)["level"].alias("level")))
    df = df.withColumn("spans", F.filter(spans, lambda p: p["level"] > 0))
    passages = F.transform("spans", lambda p: F.struct(p["at"].alias("at"), p["level"].alias("level"), F.array_join(F.transform(F.slice("lines", p["at"] + 1, p["end"] - p["at"]), lambda x: x["line"]), "\n").alias("text")))
    df = df.withColumn("passages", passages)
    hashes = F.flatten(F.transform("passages", lambda p: F.transform(F.array_distinct(F.concat(F.array(p["text"]), F.split(p["text"], "\n"))), lambda x: F.struct(p["level"].alias("level"), p["at"].alias("at"), F.xxhash64(_normal(x)).alias("hash"), (_normal(x) != "").alias("full")))))
    own = F.transform(F.filter(F.array_distinct(F.concat(F.array("said"), F.split("said", "\n"))), lambda x: _normal(x) != ""), lambda x: F.xxhash64(_normal(x)))
    return df.select("conv_id", "turn", "role", "text", "said", F.filter(hashes, lambda q: q["full"]).alias("quotes"), own.alias("own"), F.size("passages").cast("long").alias("n_quotes"))


def link(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent: the turn that each turn replies to by its quotes, where one is found."""
    asks = parsed.where("size(quotes) > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.inline("quotes"))
    wanted = asks.select("conv_id", "hash").distinct()
    said = parsed.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").alias("parent"), F.explode("own").alias("hash")).join(wanted, ["conv_id", "hash"], "left_semi")
    first = said.groupBy("conv_id", "hash").agg(F.min("parent").alias("parent"))
    found = asks.join(first, ["conv_id", "hash"]).where("parent < turn")
    return found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "at", "parent"))["parent"].alias("parent"))


def next_in_order(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with column `name`, a struct of the keys of the row after it in the order of its keys (null at the last). Rows are
    cut into ranges of the sorted keys, so that no task gets all rows of one key; a range's last row is followed by the
    first of the next range, found among one row for each."""
    ranged = keep(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranged")
    after = F.lead(F.struct(*keys)).over(Window.partitionBy("_range").orderBy(*keys))
    heads = ranged.groupBy("_range").agg(F.min(F.struct(*keys)).alias("_head"))
    heads = heads.select("_range", F.lead("_head").over(Window.orderBy("_range")).alias("_head"))  # one row a range
    return ranged.withColumn(name, after).join(F.broadcast(heads), "_range").withColumn(name, F.coalesce(name, "_head")).drop("_range", "_head")


def walk(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread, depth, place of every turn that replies or is replied to (links: conv_id, turn, parent).
    Sorted by place, the turns of a thread stand in the order of replies."""
    of = next_in_order(links.select("conv_id", "parent", "turn").distinct(), ["conv_id", "parent", "turn"], "after")
    same = (F.col("after.conv_id") == F.col("conv_id")) & (F.col("after.parent") == F.col("parent"))
    child = keep(of.select("conv_id", "turn", "parent", F.when(same, F.col("after.turn")).alias("sibling")), "siblings")
    first = child.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("first"))
    node = child.join(first, ["conv_id", "turn"], "full")
    at = lambda turn, out: F.struct(turn.cast("long").alias("turn"), F.lit(out).alias("out"))
    into = F.struct(F.lit(False).alias("out"), F.when(F.col("first").isNotNull(), at(F.col("first"), False)).otherwise(at(F.col("turn"), True)).alias("to"))
    done = F.struct(F.lit(True).alias("out"), F.when(F.col("sibling").isNotNull(), at(F.col("sibling"), False)).when(F.col("parent").isNotNull(), at(F.col("parent"), True)).alias("to"))
    steps = node.select("conv_id", "turn", F.inline(F.array(into, done)))
    # steps: so many to `to`, of which `rise` more enters than exits; the exit of a thread's first turn is its end
    end = F.col("to").isNull()
    now = keep(steps.withColumns({"steps": F.when(end, 0).otherwise(1).cast("long"), "rise": F.when(F.col("out"), -1).otherwise(1).cast("long"), "thread": F.when(end, F.col("turn"))}), "walk")
    while now.where("thread is null").limit(1).count():
        ahead = now.select("conv_id", F.struct("turn", "out").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("rise").alias("higher"), F.col("thread").alias("found"))
        moved = now.where("thread is null").join(ahead.hint("merge"), ["conv_id", "to"])
        moved = moved.select("conv_id", "turn", "out", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("rise") + F.col("higher")).alias("rise"), F.col("found").alias("thread"))
        before, now = now, keep(now.where("thread is not null").unionByName(moved), "walk")
        forget(before)
    return now.where("not out").select("conv_id", "turn", "thread", (-F.col("rise")).alias("depth"), (-F.col("steps")).alias("place"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, said, n_quotes, parent (null: starts a thread), thread (its first turn), depth and place
    (within the thread: the sort key of the reply order), one row for each row of turns (conv_id, turn, role, text)."""
    parsed = keep(parse(turns), "parsed")
    links = keep(link(parsed), "links")
    joined = parsed.join(links, ["conv_id", "turn"], "left").join(keep(walk(links), "replies"), ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    return joined.select("conv_id", "turn", "role", "said", "n_quotes", "parent", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", zero).alias("depth"), F.coalesce("place", zero).alias("place"))


def in_reply_order(formatted: DataFrame) -> DataFrame:
    """conversations() sorted as replies: each conversation stands together, over any number of partitions."""
    keys = ["conv_id", "thread", "place", "turn", "role", "said"]
    return formatted.repartitionByRange(*keys).sortWithinPartitions(*keys)
