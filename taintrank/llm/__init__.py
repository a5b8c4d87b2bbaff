"""Training-data operators: quality, PII, language, mixing, encoding, search, chat and near-duplicates.

Nothing outside this folder imports it. ``queries.py`` holds the registered
queries and their DuckDB twins.
"""
