"""Regex functions. An invalid pattern matches nothing. Leading ``(?i)``-style flags are native to the JVM regex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .attempt import regex_groups
from .base import as_text


def regexp_match(s, pattern: str) -> Column:
    if regex_groups(pattern) is None:
        return F.when(as_text(s).isNotNull(), False)
    return as_text(s).rlike(pattern)


def regexp_extract(s, pattern: str, group: int = 0) -> Column:
    """The first match's group; null (not ``''``) when nothing matches."""
    if (groups := regex_groups(pattern)) is None or not 0 <= group <= groups:
        return F.lit(None).cast("string")
    s = as_text(s)
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def regexp_replace(s, pattern: str, replacement: str | None) -> Column:
    """All matches; ``$1`` refers to a group; a missing replacement deletes."""
    if regex_groups(pattern) is None:
        return as_text(s)
    return F.regexp_replace(as_text(s), pattern, replacement or "")
