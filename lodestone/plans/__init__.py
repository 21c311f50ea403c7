"""Queries: trees, their simplification, query strings, and compilation to one DataFrame plan."""
