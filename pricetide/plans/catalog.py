"""All registered queries."""

from .registry import ITEMS, QUERIES, oracle_sql  # noqa: F401
from . import q_alerts, q_history, q_identity, q_matching, q_prices, q_runs, q_sources, q_streaming, q_text  # noqa: F401
