"""tallyjoin: exact fact-to-dimension join averages on Spark DataFrames."""

from tallyjoin.plans.averages import q1, q2
from tallyjoin.operators.joins import STRATEGIES, join_orders

__all__ = ["STRATEGIES", "join_orders", "q1", "q2"]
