"""Every registered query; importing the modules fills the registry."""

from querylight.plans import (  # noqa: F401
    catalog_queries,
    encode_queries,
    eval_queries,
    routing_queries,
    source_queries,
    stream_queries,
    text_queries,
    token_queries,
    workload_queries,
)
from querylight.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
