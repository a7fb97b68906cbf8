"""Whole jobs put together from the operators, and the checks that go with them."""

from . import records, compression, scores, chat  # noqa: F401  (each registers its queries)
from .catalog import ORACLES, QUERIES  # noqa: F401
