"""Files that arrive in a folder, ingested batch by batch with the same code."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from ..client import Client
from ..sources.files import from_binary


def ingest_stream(client: Client, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each micro-batch is one commit; a repeated batch finds its texts unchanged and writes nothing new."""
    stream = client.store.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    writer = stream.writeStream.foreachBatch(lambda df, _: client._ingest(from_binary(df))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
