"""Incremental ingestion of payload batches (Structured Streaming)."""

from visitlens.streaming.payload_ingest import start_payload_ingest

__all__ = ["start_payload_ingest"]
