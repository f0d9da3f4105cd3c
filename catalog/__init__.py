"""Registered queries: each operator over the given tables, with its SQL."""

from catalog import documents, indexing, requests, retrieval, statistics

MODULES = (documents, indexing, statistics, retrieval, requests)
