"""Periodic re-synchronisation, driven by a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seekwell.functions.names import EngineError
from seekwell.jobs.config import Config
from seekwell.jobs.sync import Models, sync
from seekwell.sources.snapshots import Workspace


def resync(workspace: Workspace, projects: Config | dict[str, str], checkpoint: str, every: str | None = None, models: Models | None = None) -> StreamingQuery:
    """Sync, by the same configuration and models as by hand, whenever the stream of the projects' folders has new files; once if ``every`` is none.

    A file stream doesn't see deletions, so each batch lists the folders anew. A round that
    finds another writer is left out, as the next one sees the same files.
    """

    def batch(files: DataFrame, number: int) -> None:
        try:
            sync(workspace, projects, models)
        except EngineError as e:
            if e.code != "BUSY":
                raise

    spark = workspace.spark
    roots = [p.root for p in projects.projects] if isinstance(projects, Config) else list(projects.values())
    schema = "path string, modificationTime timestamp, length long, content binary"
    streams = [
        spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root).select("path")
        for root in roots
    ]
    stream = streams[0]
    for s in streams[1:]:
        stream = stream.unionByName(s)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
