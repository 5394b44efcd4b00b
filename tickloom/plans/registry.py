"""Imports every plan module, in the order their shared CTEs build on each other."""

from . import base
from . import inputs, trading, reports, dashboard, search, streams  # noqa: F401,I001

QUERIES, ORACLES = base.QUERIES, base.ORACLES
