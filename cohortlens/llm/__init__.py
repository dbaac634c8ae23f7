"""Training-data operators: mixing, tokenizing, extraction, filtering and deduplication.

Nothing outside this subpackage imports it; see ``queries`` for the registered queries.
"""
