"""All registered queries."""

from duelbook.plans import feature_queries, history_queries, model_queries, rating_queries, source_queries  # noqa: F401
from duelbook.plans.catalog import ORACLES, QUERIES  # noqa: F401
