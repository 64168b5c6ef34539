"""Imports every module that registers queries."""

from lodestone.plans import learning, relational, scalar, scores  # noqa: F401
from lodestone.plans.catalog import ORACLES, QUERIES  # noqa: F401
