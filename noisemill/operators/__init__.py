"""Operators on tables: counts, evaluation, key hierarchies, annotations."""
