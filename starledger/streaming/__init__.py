"""Incremental maintenance on Structured Streaming: act-vs-estimate upserts, log purge."""
