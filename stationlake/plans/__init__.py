"""The registered queries."""

from . import decisions, display, expressions, farm, forecasts, health, ingest, models, observed, outlook, refits, regions, relations, replays, sensors, service, streams, windows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
