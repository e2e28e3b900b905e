"""Every query over the test tables."""

from convfeat.catalog import features, jobs, metrics, pooling, selection  # noqa: F401
from convfeat.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
