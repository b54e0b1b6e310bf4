"""Registered queries: each a Spark plan over the test tables and, where SQL can say it, an oracle.

The test tables hold no weather data, so operators run on stand-ins: ``events`` is the
many-site series (user_id is the site), with missing values and sentinels placed by
expression; ``lineitem`` and ``orders`` serve profiles, joins and duplicates.
"""

from pvseries.queries import cleaning, frames, modelling, profiling, sequences, sites, storage  # noqa: F401
from pvseries.queries.base import QUERIES, Query, Tables

__all__ = ["QUERIES", "Query", "Tables"]
