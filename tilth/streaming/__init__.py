"""Structured Streaming: once-only intake, windows and sessions, conversations, incremental upserts."""
