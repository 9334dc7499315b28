"""All queries, registered by importing their modules."""

from ..registry import ORACLES, QUERIES
from . import aggregates, connectors, filters, functions, joins, pipelines, sources, streams

__all__ = ["ORACLES", "QUERIES", "aggregates", "connectors", "filters", "functions", "joins", "pipelines", "sources", "streams"]
