"""Operators for preparing training data: mixing, search, token files, quality, secrets, archives, joins, tokens."""
