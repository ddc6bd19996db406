"""Structured Streaming import of uploaded files."""

from .importer import import_stream, merge_batch

__all__ = ["import_stream", "merge_batch"]
