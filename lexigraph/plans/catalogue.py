"""All queries of the engine."""

from lexigraph.plans import queries_functions, queries_graph, queries_ingest, queries_lift, queries_more, queries_rules, queries_shapes  # noqa: F401
from lexigraph.plans.registry import QUERIES, SQL  # noqa: F401
