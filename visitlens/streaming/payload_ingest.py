"""Stream the uploader's JSON batches into a table (A10 + A7 as a stream).

The source application receives ``{"headers": [...], "rows": [[...]]}``
batches over HTTP and appends them to a sheet.  Here the batches land as
JSON-lines files in a folder; a Structured Streaming query parses each new
file (``payload_to_rows``) and appends the rows to a table.

Every payload is accounted for.  A micro-batch has two outputs, the rows and a log
with one line per payload (``<table>_log``: status, error, number of rows, the payload
itself where it was rejected), each written with *overwrite* to a folder of its own,
``_batch=<query>-<number>``: a micro-batch replayed after a failure replaces both of
its earlier outputs.  The query's id lives in the checkpoint.  If that is lost, a new
query reads all files again under a new id; files that the log of another query names
are then left out, so nothing is overwritten and nothing comes in twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visitlens.session import path_exists
from visitlens.sources.payload import payload_status, payload_to_rows

SOURCE = "_source"


def log_path(table_path: str) -> str:
    return f"{table_path.rstrip('/')}_log"


def payload_stream(spark: SparkSession, source_dir: str, payload_col: str = "payload",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of payloads with the file each came in (``_source``)."""
    reader = spark.readStream.schema(f"`{payload_col}` string")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.json(source_dir).select(F.col(payload_col), F.col("_metadata.file_path").alias(SOURCE))


def _unseen(batch: DataFrame, log: str, query: str) -> DataFrame:
    """The payloads of files that no other query has logged."""
    spark = batch.sparkSession
    if not path_exists(spark, log):
        return batch
    seen = spark.read.parquet(log).where(~F.col("_batch").startswith(f"{query}-")).select(SOURCE).distinct()
    return batch.join(seen, SOURCE, "left_anti")


def start_payload_ingest(spark: SparkSession, source_dir: str, table_path: str, columns: list[str],
                         checkpoint_location: str, available_now: bool = True, fmt: str = "parquet",
                         payload_col: str = "payload", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest; with ``available_now`` it processes what is there and stops."""
    payloads = payload_stream(spark, source_dir, payload_col, max_files_per_trigger)
    log = log_path(table_path)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        fresh, folder = _unseen(batch, log, query), f"_batch={query}-{batch_id}"
        rows = payload_to_rows(fresh, columns, payload_col, keep=[SOURCE])
        rows.write.mode("overwrite").format(fmt).save(f"{table_path.rstrip('/')}/{folder}")
        status = payload_status(fresh, payload_col, keep=[SOURCE, payload_col], columns=columns)
        told = F.when(F.col("status") != "ok", F.col(payload_col)).alias(payload_col)
        # last: a file counts as read only once its rows are there
        status.select(SOURCE, "status", "error", "rows", told).write.mode("overwrite").parquet(f"{log}/{folder}")

    w = payloads.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
