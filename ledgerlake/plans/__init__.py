"""Analytical plans and the registry of queries."""
