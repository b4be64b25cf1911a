"""All queries of the corpus operators, with their check; of two with one name the library's job counts."""

from __future__ import annotations

from . import find_queries, jobs  # isort: skip  (find_queries adds views that every check begins with)
from ..plans.bindings import define
from ..streaming import filings
from ..streaming.ledgers import CATALOGUE as LEDGERS
from .measure import CATALOGUE as MEASURE
from .retrieval import CATALOGUE as RETRIEVAL
from .text import CATALOGUE as TEXT

QUERIES, ORACLES = define({k: v for part in (RETRIEVAL, MEASURE, TEXT, LEDGERS) for k, v in part.items()})
QUERIES, ORACLES = QUERIES | jobs.QUERIES | find_queries.QUERIES | filings.QUERIES, ORACLES | jobs.ORACLES | find_queries.ORACLES | filings.ORACLES
