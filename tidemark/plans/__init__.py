"""Pipelines made of operators, table access and the query catalogue."""
