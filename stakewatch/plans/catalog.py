"""All registered queries, by importing the modules that register them."""

from stakewatch.plans import core, normal, streams, web  # noqa: F401
from stakewatch.plans.registry import ORACLES, QUERIES  # noqa: F401
