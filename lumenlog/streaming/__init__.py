"""Structured Streaming: ingest, cross-batch reassembly, alert states and score feeds."""
