"""Incremental, resumable chat-message export as set-based Spark jobs."""
