"""Counts kept up to date over a stream."""
