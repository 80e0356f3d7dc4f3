"""Every operator run over the driver's tables, with its SQL counterpart."""

from unisource.plans.queries.registry import ORACLES, QUERIES
from unisource.plans.queries import (  # noqa: F401  (importing registers)
    changing, reading, discovering, inferring, scalars, sqltext, unwrapping,
)

__all__ = ["ORACLES", "QUERIES"]
