"""Named queries over the given tables."""

from .registry import QUERIES, SQL
from . import (  # noqa: F401
    label_queries, shaping_queries, stream_queries, task_queries, text_queries, timeline_queries, usage_queries, voice_queries,
)

__all__ = ["QUERIES", "SQL"]
