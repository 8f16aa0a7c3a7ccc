"""Incremental ingest of raw station files with Structured Streaming (ST1).

New CSV files in a directory are picked up once each (the file source keeps
the list of processed files in the checkpoint). A micro-batch carries only
the paths of its new files; they are read grouped by header, so files whose
columns stand in different orders are combined by name, cleaned by the same
expressions as the batch path, and appended through the table store. A
micro-batch that is replayed after a failure lands once (``append_batch``),
so the table can be appended to, purged and rebuilt like any other.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import clean_observations, missing_required
from ..session import scratch_path
from ..sources import csv as CSV
from ..sources import store

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
#: Files of one micro-batch: their paths (not their rows) reach the driver.
MAX_FILES = 10_000


@dataclass
class IngestResult:
    """What one run took in, counted over all of its micro-batches."""
    batches: int = 0
    files: int = 0
    rows: int = 0


def new_files(spark: SparkSession, raw_dir: str, max_files_per_trigger: int = MAX_FILES) -> DataFrame:
    """Stream of the paths of CSV files in ``raw_dir`` (contents are not read)."""
    return (spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
            .option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", str(max_files_per_trigger))
            .load(raw_dir).select("path"))


def ingest(spark: SparkSession, raw_dir: str, table_path: str, checkpoint: str | None = None,
           floor=None, timeout_s: float | None = None,
           max_files_per_trigger: int = MAX_FILES) -> IngestResult:
    """Process every file not yet ingested, then stop (``availableNow``).

    ``checkpoint`` defaults to a folder under the shared checkpoint folder;
    pass the same one on every run so each file is taken once.
    ``max_files_per_trigger`` splits a large backlog into bounded
    micro-batches. A file without a required column fails the run. Raises
    ``TimeoutError`` when the run takes longer than ``timeout_s``; the next
    run goes on where it stopped.
    """
    checkpoint = checkpoint or scratch_path(spark, "ingest-ckpt")
    source = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    result = IngestResult()

    def land(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.collect()]
        raw = CSV.read_raw_files(batch.sparkSession, paths)
        if raw is not None:
            if missing_required(raw):
                raise ValueError(f"missing required columns: {sorted(missing_required(raw))}")
            written = store.append_batch(clean_observations(raw, floor), table_path, f"{source}-{batch_id}")
            result.rows += written.rows
        result.batches += 1
        result.files += len(paths)

    query = (new_files(spark, raw_dir, max_files_per_trigger).writeStream.foreachBatch(land)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the ingest did not finish within {timeout_s} s")
    return result
