"""Registered queries over the driver's tables, each beside its DuckDB SQL."""

from panelworks.queries import encoded, extras, flows, models, rollups, scored  # noqa: F401
from panelworks.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
