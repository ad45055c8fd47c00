"""Operators for preparing training text: rules, deduplication, secrets, mixing, tokens, search."""
