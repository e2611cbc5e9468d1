"""Corpus operators. Nothing outside this subpackage imports it."""
