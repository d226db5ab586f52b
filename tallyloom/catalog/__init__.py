"""All named queries; importing the package registers them."""

from . import columns, distributions, folds, intervals, joins, mixtures, reports, rollups, sections, tables
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "columns", "distributions", "folds", "intervals", "joins", "mixtures", "reports", "rollups", "sections", "tables"]
