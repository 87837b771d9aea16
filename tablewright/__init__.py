"""Table wrangling on Spark: cleaning, reshaping, combining and profiling DataFrames.

``operators`` take and return DataFrames, ``functions`` build Columns, ``sources``
read and write, ``plans.jobs`` runs pipelines from a configuration.
"""

from . import functions, operators, sources, streaming
from .plans import jobs
from .plans.names import UniqueOrder

__all__ = ["UniqueOrder", "functions", "jobs", "operators", "sources", "streaming"]
