"""Relational operators over episodes, shards, captions and metrics."""
