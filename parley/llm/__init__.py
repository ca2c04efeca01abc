"""Operators for training-data pipelines: classification, scans, deduplication, formatting, search, packing.

Nothing outside this package imports it. ``QUERIES`` and ``SQL`` hold the named queries and their SQL.
"""

from .registry import QUERIES, SQL
from . import (  # noqa: F401
    bpe, chat_format, decontaminate, fill_middle, line_templates, licences, packing, quality, secrets, simhash, topk, urls, vector_codes,
)

__all__ = ["QUERIES", "SQL"]
