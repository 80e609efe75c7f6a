from stintwise.plans import catalog, pace, season, signals, streams, telemetry, text  # noqa: F401
from stintwise.plans.registry import ORACLES, QUERIES, bind

__all__ = ["ORACLES", "QUERIES", "bind"]
