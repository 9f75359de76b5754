"""Pipelines over streams: each micro-batch is the input rows of a pipeline that starts with `given`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from knotwork.session import Database, query


def read_batches(rows: DataFrame, catalog, store, text: str, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs a read pipeline for every micro-batch of a streaming DataFrame and hands its rows and the batch's number to sink."""

    def batch(df: DataFrame, n: int) -> None:
        sink(query(df.sparkSession, catalog, store, text, df), n)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_batches(rows: DataFrame, database: Database, text: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs a write pipeline for every micro-batch, one transaction each. A batch that is repeated after a failure is written again, so pipelines that must not repeat use put."""

    def batch(df: DataFrame, _: int) -> None:
        with database.transaction("write") as tx:
            tx.query(text, df)
            tx.commit()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
