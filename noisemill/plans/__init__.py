"""Whole jobs: measure a table, fit its dependency tree, draw a synthetic one."""
