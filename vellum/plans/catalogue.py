"""All catalogue queries and their oracles, by name."""

from __future__ import annotations

from .oracles import ORACLES as _ORACLES
from .page_queries import PAGE_ORACLES, PAGE_QUERIES
from .queries import QUERIES as _QUERIES

QUERIES = {**_QUERIES, **PAGE_QUERIES}
ORACLES = {**_ORACLES, **PAGE_ORACLES}
