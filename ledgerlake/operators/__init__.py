"""Operators on tables: cleaning recipes, quality, retrieval, governance, warehouse."""
