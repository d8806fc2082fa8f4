"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from . import consensus, extras, matching, pictures, search, stats, streams, sync, verdicts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "consensus", "extras", "matching", "pictures", "search", "stats", "streams", "sync", "verdicts"]
