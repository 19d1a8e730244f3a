"""All queries; importing a plan module registers its entries."""

from moothall.plans import archive, auditing, corpus, draws, learning, matching  # noqa: F401
from moothall.plans.registry import ORACLES, QUERIES  # noqa: F401
