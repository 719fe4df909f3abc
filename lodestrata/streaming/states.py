"""Streams that change tables: micro-batches merged into versions, and a workflow's states enforced row by row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter


def merging(stream: DataFrame, path: str) -> DataStreamWriter:
    """A writer that lands each micro-batch as the partition batch=<its number> of a Parquet table. The number names the partition
    and a batch replaces what stands there, so a batch that runs again, after a failure or from an older checkpoint, changes
    nothing; other batches are never touched. An empty batch leaves nothing."""

    def land(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(land)


def merged(table: DataFrame, keys: list[str]) -> DataFrame:
    """Of what merging() wrote, the row of the last batch for each key, and the number of its versions; of rows of one key in a batch
    the greatest by its other columns. Null keys are keys like others. Aggregated before the shuffle, so a hot key is one row a task."""
    rest = [c for c in table.columns if c not in keys and c != "batch"]
    last = F.max(F.struct("batch", *rest)).alias("_last")
    return table.groupBy(*keys).agg(last, F.count_distinct("batch").alias("versions")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest], "_last.batch", "versions")


def enforced(events: DataFrame, entity: str, status: str, order: list[str], start: str, moves: dict[str, list[str]]) -> DataFrame:
    """entity, the columns of order, status, allowed, state (after the row) of each row of a stream.

    The state of an entity starts at `start` and goes on to the status of a row if moves names it; else the row is refused and the state stays.
    Only the state is kept between batches; within a batch an entity's rows are taken by `order`, batches as they come. A null
    status is refused; a null entity is one. A task holds the rows that one entity has in a batch, which the stream's own limits bound."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    types = {f.name: f.dataType for f in events.schema}
    out = T.StructType([T.StructField(entity, types[entity]), *[T.StructField(c, types[c]) for c in order], T.StructField(status, T.StringType()), T.StructField("allowed", T.BooleanType()), T.StructField("state", T.StringType())])
    kept = T.StructType([T.StructField("state", T.StringType())])

    def run(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        now = state.get[0] if state.exists else start
        parts = list(batches)
        rows = pd.concat(parts).sort_values(order, kind="stable") if parts else pd.DataFrame(columns=out.names)
        allowed, after = [], []
        for wanted in rows[status]:
            fine = isinstance(wanted, str) and wanted in moves.get(now, ())
            now = wanted if fine else now
            allowed.append(fine)
            after.append(now)
        state.update((now,))
        yield rows[[entity, *order, status]].assign(allowed=allowed, state=after)

    return events.select(entity, *order, status).groupBy(entity).applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)
