"""Queries of the core by name, with the SQL that gives the same rows."""

from quern.plans import banding, choosing, cleaning, completing, corpus, duplicates, exchanging, measuring, moving, telemetry
from quern.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "banding", "choosing", "cleaning", "completing", "corpus", "duplicates", "exchanging", "measuring", "moving", "telemetry"]
