"""All registered queries."""

from labweave.suite import cleaning, designs, joins, models, plans, profiles, searches, sources, trees  # noqa: F401
from labweave.suite.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
