"""Incremental processing: change streams, idempotent micro-batches, cursors and windows."""
