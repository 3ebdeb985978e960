"""Plans that hold model kernels, rules that rewrite them, a cost model, and a search for the cheapest plan."""

from gridloom.plans.cost import cost
from gridloom.plans.join_order import join_in_order
from gridloom.plans.nodes import Aggregate, Call, Filter, Join, Project, Source
from gridloom.plans.rules import RULES
from gridloom.plans.search import optimise
from gridloom.plans.substrait import from_substrait

__all__ = ["RULES", "Aggregate", "Call", "Filter", "Join", "Project", "Source", "cost", "from_substrait", "join_in_order", "optimise"]
