"""Readers, writers and synthetic tables."""

from .files import detect_delimiter, flatten, read_csv, read_json, serialize_nested, write_csv, write_json
from .generate import (
    DateSequence, NumberSequence, RandomBoolean, RandomCategory, RandomDate, RandomNumber, generate, row_count,
)
