"""Readers, writers, file layouts and the mapping of test tables."""
