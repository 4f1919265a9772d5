"""Registered queries: each one is a DataFrame job over the given tables with, where SQL can say it,
an independent SQL text giving the same rows."""

from tidewatch.plans.registry import ORACLES, QUERIES  # noqa: F401


def load_all() -> None:
    """Import every module that registers queries."""
    from tidewatch.plans import audits, calibration, checks, graph, inference, resampling, runs, series, states, streams, survival, visibility  # noqa: F401
