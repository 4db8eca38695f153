"""Inputs derived from the test tables, and the named queries on them."""
