"""Streaming ingestion of the daily source feeds."""

from ledgerline.streaming.ingest import ingest_daily

__all__ = ["ingest_daily"]
