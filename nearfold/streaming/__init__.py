"""Incremental runs over a stream of mapped images."""
