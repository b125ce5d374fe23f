"""All queries over the driver's tables, with the SQL they are checked against."""

from __future__ import annotations

from bough.plans.oracles import ORACLES
from bough.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
