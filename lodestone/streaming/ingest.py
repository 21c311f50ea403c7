"""Continuous indexing: every micro-batch becomes a segment and a commit."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.reader import Commit
from lodestone.schema import IndexSchema
from lodestone.sources.storage import Storage
from lodestone.writer import IndexWriter, WriterConfig

DONE = "streams"


def ingest(stream: DataFrame, path: str, schema: IndexSchema, checkpoint: str, config: WriterConfig | None = None, key: str | None = None, order_by: Iterable[str] = (), trigger: dict | None = None, name: str = "ingest") -> StreamingQuery:
    """Starts to add the rows of ``stream`` to the index at ``path``.

    With ``key``, a row replaces the documents that have its value in that
    exact-match field. A batch that was committed before a failure is not added
    again: each commit leaves a mark with the batch's number.
    """
    spark = stream.sparkSession
    order_by = list(order_by)

    def add(batch: DataFrame, number: int) -> None:
        storage = Storage(spark, path)
        with IndexWriter.open(spark, path, config, schema) as writer:
            mark = f"{DONE}/{name}-{number}.json"
            if storage.exists(mark):
                return
            known = Commit.generations(storage)
            pending = f"{DONE}/{name}-{number}-begun.json"
            if storage.exists(pending) and known and storage.read_json(pending)["generation"] < known[-1]:
                storage.publish_json(mark, {"generation": known[-1]})  # it failed between its commit and its mark
                return
            storage.delete(pending)
            storage.publish_json(pending, {"generation": known[-1] if known else 0})
            if not batch.isEmpty():
                if key is None:
                    writer.add_documents(batch, order_by=order_by)
                else:
                    writer.update_documents(batch, key, order_by)
            writer.commit()
            storage.publish_json(mark, {"generation": writer.state.generation})

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
