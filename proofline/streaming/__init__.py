"""Structured Streaming forms of append logs, leases and blob deduplication."""
