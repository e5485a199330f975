"""Imports every module of queries, which registers them."""

from checks import q_graph, q_links, q_names, q_search, q_sources  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
