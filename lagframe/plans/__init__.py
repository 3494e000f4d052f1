"""Assembled pipelines and the named queries with their SQL twins."""
