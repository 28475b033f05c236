"""Incremental versions for streams."""
