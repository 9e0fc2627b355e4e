"""Training-data operators: archives, deduplication, language, tokens, search, mixing, shards.

Nothing outside this package imports it. ``queries`` registers one query per operator.
"""
