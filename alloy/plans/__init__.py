"""Registered showcase queries (one per operator) and their oracle SQL twins."""

from alloy.plans import (flagship, q_docs, q_gold, q_history, q_profile, q_readback, q_relational,  # noqa: F401
                         q_silver, q_streaming)
from alloy.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
