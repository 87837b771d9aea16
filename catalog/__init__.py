"""Queries that exercise every operator on the driver tables, with their SQL."""

from . import aggregates, cells, failures, files, functions, joins, profiles, projections, reshapes, rows, windows
from . import large_groups  # repeats queries of the others
from .registry import QUERIES, SQL
