"""All registered queries: importing a module registers what it holds."""

from tidemark.catalogue import aggregates, joins, models, reports, scalars, tables, warehouse  # noqa: F401
from tidemark.catalogue.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
