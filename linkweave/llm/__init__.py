"""Operators for preparing training text: joins, search, mixing, archives, shards, classifiers, tokens."""
