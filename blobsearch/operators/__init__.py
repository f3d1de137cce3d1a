"""Operators over catalogs, vectors and captions."""
