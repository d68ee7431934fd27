"""All queries of the package with the SQL that checks them."""

from __future__ import annotations

from . import bunchings, detectings, digits, dispersions, distortions, flows, percents, rankings, registries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
