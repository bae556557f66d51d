"""Chunk-fed parsing: documents that arrive in pieces."""

from .chunks import parse_chunks, parse_stream, split_chunks

__all__ = ["parse_chunks", "parse_stream", "split_chunks"]
