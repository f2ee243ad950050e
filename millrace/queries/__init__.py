"""Registered queries, by the part of the algebra that they exercise."""

from . import aggregates, corpora, entities, filters, follow, indexes, joins, ledger, plans, records, retrieval, scalars, windows  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
