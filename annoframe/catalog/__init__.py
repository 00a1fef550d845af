"""Every operator as a query over the given tables, next to the SQL that must give the same rows."""

from . import bins, frames, joins, order, streams, text
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "bins", "frames", "joins", "order", "streams", "text"]
