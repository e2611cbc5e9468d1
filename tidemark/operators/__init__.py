"""Relational operators over points, intervals and step functions."""
