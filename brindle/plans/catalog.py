"""All queries of the library: importing this module registers them."""

from brindle.plans import climate_queries, fleet_queries, flow_queries, join_queries, map_queries, quality_queries, source_queries, stream_queries  # noqa: F401
from brindle.plans.registry import ORACLE, QUERIES  # noqa: F401
