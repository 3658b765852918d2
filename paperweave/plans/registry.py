"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import queries_documents, queries_filings, queries_keyed, queries_packets, queries_rounds, queries_search

QUERIES: dict = queries_search.QUERIES | queries_documents.QUERIES | queries_keyed.QUERIES | queries_filings.QUERIES | queries_packets.QUERIES | queries_rounds.QUERIES
ORACLE: dict[str, str] = queries_search.ORACLE | queries_documents.ORACLE | queries_keyed.ORACLE | queries_filings.ORACLE | queries_packets.ORACLE | queries_rounds.ORACLE
