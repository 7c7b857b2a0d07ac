"""Incremental ingestion with Structured Streaming: an extension beyond batch parity."""
