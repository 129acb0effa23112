"""Property graphs as two Spark tables, nodes and edges."""

from .frame import GraphTable
from .operators.grouping import NodeGroups
from .operators.khop import aggregate_over_pairs

__all__ = ["GraphTable", "NodeGroups", "aggregate_over_pairs"]
