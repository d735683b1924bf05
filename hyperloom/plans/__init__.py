"""The registered queries; importing the modules registers them."""

from hyperloom.plans import centroids, models, signals, streams  # noqa: F401
from hyperloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
