"""Parsers: content -> facts, one pure function for each file type."""

from codestrata.parsers.registry import parse_source, register_parser

__all__ = ["parse_source", "register_parser"]
