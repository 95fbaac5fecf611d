"""Results engine for structured extraction, on Spark DataFrames.

Subjects are scored against a declared trait schema, one request per subject and
schema shard.  The package turns the raw answers into merged records, gap
reports, typed wide tables, run comparisons and operations reports.
"""

from .session import configure

__all__ = ["configure"]
