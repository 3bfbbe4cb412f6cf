"""All registered queries; importing the modules registers them."""

from quarry.plans import analytics, corpus, files, frames, learning, models, relational, streams, surface
from quarry.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analytics", "corpus", "files", "frames", "learning", "models", "relational", "streams", "surface"]
