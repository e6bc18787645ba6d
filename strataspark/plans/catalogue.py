"""All registered queries: importing a query module fills the registry."""
from . import audit_queries, ledger_queries, metric_queries, pair_queries, prepare_queries, resample_queries, scalar_queries, window_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
