"""Queries registered over the given tables."""

from passages.queries import (  # noqa: F401
    books, chat, concepts, contents, metas, search, streams, texts,
)
from passages.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
