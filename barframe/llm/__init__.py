"""Operators of a training-data pipeline: quality, toxicity, tokens, archives, mixing, duplicates, leaks, rules, licences."""
